"""Reports over the store's tables: health of sources, verdict, statistics, coverage, reviews that no longer hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import fold

from .schedule import coverage_state, unregistered

STALE_DAYS, REVIEW_DAYS, HISTORY = 14, 30, 20
FACETS = ("source", "location", "role", "term", "language", "degree_requirement")
# Reasons of rejection that still tell of internships.
EVIDENCE = ("out-of-scope-degree", "not-a-cs-role", "unknown-cs-role")


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.select("run_id").orderBy(F.col("run_id").desc()).limit(n)


def volume(run_sources: DataFrame, runs: DataFrame, n: int = HISTORY, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """(source, latest, baseline, samples, verdict, detail) over the newest ``n`` runs: the newest that counts against
    the median of those before. A run counts if it stored a known number, deferred nothing and was not blocked.

    Where too few count, ``detail`` says why: no runs, blocks, deferrals, or nothing recorded, in that order.
    """
    seen = run_sources.join(newest_runs(runs, n), "run_id", "left_semi")
    counts = (F.col("stored") > -1) & (F.col("deferred") == 0) & ~F.col("blocked")
    marked = seen.withColumn("counts", counts)
    newest = W.partitionBy("source", "counts").orderBy(F.col("run_id").desc())
    placed = marked.withColumn("place", F.when(F.col("counts"), F.row_number().over(newest)))
    one = placed.groupBy("source").agg(
        F.max(F.when(F.col("place") == 1, F.col("stored"))).alias("latest"), F.median(F.when(F.col("place") > 1, F.col("stored"))).alias("median"),
        F.count("place").alias("n"), F.bool_or("blocked").alias("any_blocked"), F.bool_or(F.col("deferred") > 0).alias("any_deferred"),
    )
    samples = F.greatest(F.col("n") - 1, F.lit(0))
    base = F.when(samples >= least, F.col("median")).otherwise(0.0).cast("double")
    out = one.select("source", F.coalesce("latest", F.lit(-1)).alias("latest"), base.alias("baseline"), samples.alias("samples"), "n", "any_blocked", "any_deferred")
    proven = F.col("samples") >= least
    verdict = (
        F.when(~proven, "unproven").when(F.col("baseline") <= 0, "healthy").when(F.col("latest") == 0, "collapsed")
        .when(F.col("latest") < F.col("baseline") * ratio, "dropped").otherwise("healthy")
    )
    whole = F.round("baseline", 0).cast("long").cast("string")
    detail = (
        F.when(F.col("n") == 0, unproven_reason(F.col("any_blocked"), F.col("any_deferred")))
        .when(~proven, F.concat(F.col("samples").cast("string"), F.lit(f" comparable run(s), {least} needed")))
        .when(F.col("baseline") <= 0, "has never stored anything")
        .when(F.col("latest") == 0, F.concat(F.lit("stores nothing after a median of "), whole, F.lit(" across "), F.col("samples").cast("string"), F.lit(" runs")))
        .when(F.col("latest") < F.col("baseline") * ratio, F.concat(F.lit("stores "), F.col("latest").cast("string"), F.lit(" against a median of "), whole)).otherwise("")
    )
    return out.select("source", "latest", "baseline", "samples", verdict.alias("verdict"), detail.alias("detail"))


def unproven_reason(any_blocked: Column, any_deferred: Column) -> Column:
    """Why no run counts; null flags mean that there was none."""
    return (
        F.when(any_blocked.isNull(), "no runs on record").when(any_blocked, "every run was blocked, which is a throttle not a drop")
        .when(any_deferred, "every run deferred members, so rotation explains it").otherwise("no run has recorded a stored count yet")
    )


def visit_state(last_success: Column, failures: Column, now: Column, stale_days: int = STALE_DAYS) -> Column:
    return F.when(last_success.isNull() | (failures > 0), "failing").when(last_success < now - F.make_dt_interval(F.lit(stale_days)), "stale").otherwise("healthy")


def board_health(visits: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """One row for each visited board, its label the board itself where it has none."""
    state = visit_state(F.col("last_success_at"), F.col("consecutive_failures"), now, stale_days)
    return visits.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "board")).withColumn("state", state)


LATEST = ("requests", "not_modified", "latency_p50_ms", "latency_p95_ms", "errors", "tightenings", "deferred", "blocked")


def source_health(jobs: DataFrame, visits: DataFrame, runs: DataFrame, run_sources: DataFrame, now: Column, stale_days: int = STALE_DAYS, history: int = HISTORY) -> DataFrame:
    """One row for each source that any of the tables names: what it stores, its volume, its last run, its boards, the
    share of requests that the cache answered and of boards that answer. What is not known is 0 or false."""
    stored = jobs.filter("status = 'open'").groupBy("source").agg(F.count("*").alias("stored"))
    recent = run_sources.join(newest_runs(runs, history), "run_id", "left_semi")
    last = recent.groupBy("source").agg(F.max_by(F.struct(*LATEST), "run_id").alias("l")).select("source", "l.*")
    boards = board_health(visits, now, stale_days).groupBy("source").agg(F.count("*").alias("boards"), F.count_if(F.col("state") == "failing").alias("failing"), F.count_if(F.col("state") == "stale").alias("stale"))
    every = volume(run_sources, runs, history).join(stored, "source", "full_outer").join(last, "source", "full_outer").join(boards, "source", "full_outer")
    numbers = ["stored", "boards", "failing", "stale", "samples", *LATEST[:2], *LATEST[4:7]]
    filled = every.fillna(0, numbers).fillna(0.0, ["baseline", "latency_p50_ms", "latency_p95_ms"]).fillna(False, ["blocked"]).fillna({"latest": -1, "verdict": "unproven", "detail": "no runs on record"})
    return filled.withColumn("cache_hit_ratio", F.when(F.col("requests") > 0, F.col("not_modified") / F.col("requests"))).withColumn("success_rate", F.when(F.col("boards") > 0, (F.col("boards") - F.col("failing")) / F.col("boards")))


def verdict(health: DataFrame, findings: DataFrame, rate_state: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """One row: problems of integrity, volume alerts, active blocks, warnings (boards that fail or are stale, companies
    due for another look), and healthy, which warnings do not take away."""
    a = findings.agg(F.count_if(F.col("count") > 0).alias("problems"))
    b = health.agg(F.count_if(F.col("verdict").isin("dropped", "collapsed")).alias("alerts"), F.coalesce(F.sum(F.col("failing") + F.col("stale")), F.lit(0)).alias("boards"))
    c = rate_state.agg(F.count_if(now < F.col("blocked_until")).alias("blocks"))
    d = companies.agg(F.count_if(due_for_recheck(F.col("enabled"), F.col("recheck_after"), now)).alias("due"))
    one = [x.withColumn("one", F.lit(1)) for x in (a, b, c, d)]
    met = one[0].join(one[1], "one").join(one[2], "one").join(one[3], "one")
    healthy = (F.col("problems") == 0) & (F.col("alerts") == 0) & (F.col("blocks") == 0)
    return met.select("problems", "alerts", "blocks", (F.col("boards") + F.col("due")).alias("warnings"), healthy.alias("healthy"))


def due_for_recheck(enabled: Column, after: Column, now: Column) -> Column:
    """A company that was switched off until a date that has come."""
    return F.coalesce(~enabled & (after <= F.to_date(now)), F.lit(False))


def statistics(jobs: DataFrame, quarantine: DataFrame, tombstones: DataFrame, validators: DataFrame) -> DataFrame:
    """(facet, value, n): canonical rows by each facet in one pass, the quarantine by reason, and totals."""
    from .filters import bucket

    live = jobs.filter("duplicate_of is null").withColumn("location", bucket(F.col("location")))
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in FACETS]))
    composed = live.select(facets.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    reasons = quarantine.groupBy(F.lit("quarantined").alias("facet"), F.col("reason").alias("value")).agg(F.count("*").alias("n"))
    both = jobs.agg(F.count_if(F.col("duplicate_of").isNull()).alias("jobs"), F.count("duplicate_of").alias("duplicates"))
    total = both.select(F.explode(F.array(*[F.struct(F.lit("total").alias("facet"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in both.columns])).alias("x")).select("x.*")
    for name, df in (("tombstones", tombstones), ("cached urls", validators)):
        total = total.unionByName(df.agg(F.lit("total").alias("facet"), F.lit(name).alias("value"), F.count("*").alias("n")))
    return composed.unionByName(reasons).unionByName(total)


def coverage_rows(companies: DataFrame, jobs: DataFrame, visits: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """One row for each enabled company (name, platform, board; a null board has no adapter), by state, then name."""
    counts = jobs.filter("status = 'open'").groupBy(F.col("board_key").alias("board")).agg(F.count("*").alias("postings"))
    seen = visits.select("board", "last_attempt_at", "last_success_at", "consecutive_failures")
    met = companies.filter("enabled").join(counts, "board", "left").join(seen, "board", "left").fillna(0, ["postings", "consecutive_failures"])
    state = coverage_state(F.col("board").isNotNull(), F.col("postings"), F.col("last_attempt_at"), F.when(F.col("last_success_at").isNull(), 1).otherwise(F.col("consecutive_failures")), F.col("last_success_at"), now, stale_days)
    out = met.select(F.col("name").alias("company"), "platform", "board", state.alias("state"), "postings", "consecutive_failures")
    return out.orderBy("state", F.lower("company"), "company", "board")


def unregistered_companies(jobs: DataFrame, quarantine: DataFrame, names: DataFrame) -> DataFrame:
    """Companies of postings or of the quarantine that match none of ``names`` (reg_toks), those with most postings
    first, then those that seem to offer internships, then by rows put away."""
    live = jobs.filter("duplicate_of is null and status = 'open'").groupBy("company").agg(F.count("*").alias("postings"))
    put = quarantine.groupBy("company").agg(F.count("*").alias("quarantined"), F.bool_or(F.col("reason").isin(*EVIDENCE)).alias("posts_internships"))
    seen = live.join(put, "company", "full_outer").fillna(0, ["postings", "quarantined"]).fillna(False, ["posts_internships"])
    from gristmill.functions.text import name_tokens

    new = unregistered(seen.withColumn("name", F.col("company")).withColumn("toks", name_tokens(F.col("company"))), names)
    return new.drop("toks", "name").orderBy(F.col("postings").desc(), F.col("posts_internships").desc(), F.col("quarantined").desc(), F.lower("company"), "company")


def contradicted(reviews: DataFrame, companies: DataFrame, now: Column, days: int = REVIEW_DAYS) -> DataFrame:
    """(company, disposition, contradiction): reviews that a registry row, live or not, or their age speaks against, in
    this order; of several rows of one name the last by (platform) counts."""
    rows = companies.withColumn("key", fold(F.col("name"))).groupBy("key").agg(F.max_by(F.struct("enabled", "platform"), "platform").alias("row"))
    met = reviews.withColumn("key", fold(F.col("company"))).join(rows, "key", "left")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("checked_on")) / 86400)
    said = (
        F.when(F.col("row.enabled"), F.concat(F.lit("the registry now polls it on "), F.col("row.platform")))
        .when(F.col("row").isNotNull(), F.concat(F.lit("a disabled "), F.col("row.platform"), F.lit(" row exists for it")))
        .when(age >= days, F.concat(F.lit("the verdict is "), age.cast("string"), F.lit(" days old and nothing has re-derived it")))
    )
    return met.select("company", "disposition", said.alias("contradiction")).filter("contradiction is not null").orderBy(F.lower("company"), "company")


DISPOSITIONS = ("feed-only", "unavailable", "custom-json-candidate", "adapter-candidate", "deferred")


def record_reviews(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """Reviews after ``new`` ones by folded name, which replace; names that fold to nothing, unknown dispositions and
    empty notes are an error."""
    from .merge import replace_by

    keyed = new.withColumn("company_fold", fold(F.col("company")))
    wrong = keyed.filter((F.col("company_fold") == "") | ~F.col("disposition").isin(*DISPOSITIONS) | (F.trim("note") == "") | F.col("checked_on").isNull())
    if wrong.limit(1).count():
        raise ValueError("a review needs a company with letters, a known disposition, a note and a date")
    return replace_by(reviews, keyed, "company_fold")


def clear_review(reviews: DataFrame, company: str) -> DataFrame:
    return reviews.filter(F.col("company_fold") != fold(F.lit(company)))


def duplicates_of(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("duplicate_of") == job_id).orderBy("source", "id")


def posting(jobs: DataFrame, job_id: str) -> DataFrame:
    """One row at most: the posting, its canonical row, and its duplicates by source and id."""
    own = jobs.filter(F.col("id") == job_id)
    up = jobs.select(F.col("id").alias("duplicate_of"), F.struct(*jobs.columns).alias("canonical"))
    down = duplicates_of(jobs, job_id).groupBy(F.lit(job_id).alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "id"))).alias("duplicates"))
    return own.join(up, "duplicate_of", "left").join(down, "id", "left").withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<struct<source:string,id:string>>")))


def run_totals(run_sources: DataFrame) -> DataFrame:
    """One row for each run: sums over its sources, and how it went: nothing succeeded, part of it, all."""
    ok = (F.col("errors") == 0) & ~F.col("blocked") & (F.col("deferred") == 0)
    sums = [F.sum(c).alias(c) for c in ("fetched", "added", "updated", "closed", "quarantined", "requests", "not_modified")]
    bad = run_sources.groupBy("run_id").agg(
        *sums, F.count_if(ok).alias("good"), F.count_if(F.col("errors") > 0).alias("failed"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("deferred") > 0).alias("deferred")
    )
    outcome = F.when((F.col("good") == 0) & (F.col("failed") + F.col("blocked") > 0), "failure").when(F.col("failed") + F.col("blocked") + F.col("deferred") > 0, "partial").otherwise("success")
    why = lambda n, said: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(said)))
    reason = F.concat_ws("; ", why("failed", " source(s) failed"), why("blocked", " source(s) blocked"), why("deferred", " source(s) stopped on their host budget"))
    return bad.withColumn("outcome", outcome).withColumn("partial_reason", reason).drop("good")


def volume_history(run_sources: DataFrame, runs: DataFrame, n: int = HISTORY) -> DataFrame:
    """(source, history): what each source stored in the newest ``n`` runs, newest first."""
    seen = run_sources.join(newest_runs(runs, n), "run_id", "left_semi")
    points = F.transform(F.sort_array(F.collect_list(F.struct("run_id", "stored", "deferred", "blocked")), asc=False), lambda x: F.struct(x["stored"].alias("stored"), x["deferred"].alias("deferred"), x["blocked"].alias("blocked")))
    return seen.groupBy("source").agg(points.alias("history"))


def spent_since(run_sources: DataFrame, runs: DataFrame, since: Column, last: int = 16) -> DataFrame:
    """(source, spent): requests of the last runs that began at ``since`` or later."""
    recent = runs.orderBy(F.col("run_id").desc()).limit(last).filter(F.col("started_at") >= since)
    return run_sources.join(recent.select("run_id"), "run_id", "left_semi").groupBy("source").agg(F.sum("requests").alias("spent"))


def apply_urls(jobs: DataFrame, quarantine: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """(company, place, url): up to ``most`` different URLs of each wanted company, those of live postings before those
    of rejected ones, the last seen first, ties by URL."""
    pick = lambda df, prio: df.select(F.lit(prio).alias("prio"), fold(F.col("company")).alias("key"), F.trim("apply_url_raw").alias("url"), "last_seen").filter("url <> ''")
    both = pick(jobs.filter("duplicate_of is null and status = 'open'"), 0).unionByName(pick(quarantine, 1))
    named = wanted.select("company", fold(F.col("company")).alias("key"))
    best = both.join(named, "key").groupBy("company", "url").agg(F.min(F.struct("prio", (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("age"), "url")).alias("turn"))
    place = F.row_number().over(W.partitionBy("company").orderBy("turn"))
    return best.withColumn("place", place).filter(F.col("place") <= most).select("company", "place", "url")
