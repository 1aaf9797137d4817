"""Control plane of the connectors as transforms of tables: postures, plans, validators, settlements, probes, facets."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.control import block_seconds, decayed

# Postures by name: requests at once, seconds between, requests a run, hours until a refresh, requests a board.
PROFILES = {
    "standard": (3, 0.25, 300, 4.0, 2),
    "broad": (3, 0.25, 450, 4.0, 2),
    "moderate": (2, 0.4, 150, 4.0, 2),
    "paginated": (2, 0.4, 250, 4.0, 3),
    "conservative": (1, 1.0, 80, 10.0, 1),
    "workday": (2, 1.5, 500, 4.0, 2),
    "feeds": (2, 0.5, 20, 0.0, 2),
    "jobbank": (1, 5.0, 120, 0.0, 1),
    "discovery": (1, 1.0, 60, 0.0, 2),
}
BACKSTOP, DAILY_RUNS, MOST_BYTES = 2000, 4, 64 << 20


def profiles(spark) -> DataFrame:
    rows = [(k, *v) for k, v in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, concurrency int, min_interval_s double, max_requests int, refresh_h double, per_board int")


def strictest(claims: DataFrame, *by: str) -> DataFrame:
    """The strictest of all postures by ``by``: the least concurrency, ceiling and requests a board, the greatest
    interval and refresh time."""
    return claims.groupBy(*by).agg(
        F.min("concurrency").alias("concurrency"), F.max("min_interval_s").alias("min_interval_s"), F.min("max_requests").alias("max_requests"),
        F.max("refresh_h").alias("refresh_h"), F.min("per_board").alias("per_board"),
    )


def source_postures(members: DataFrame) -> DataFrame:
    """(source, bucket, posture): the strictest of a source's default and its members' own profiles, its ceiling raised
    to what its members need, then the strictest of all sources of a bucket.

    members: source, bucket, board, default_profile, profile (null: none), reserve. A profile that nobody
    knows is an error.
    """
    known = profiles(members.sparkSession)
    asked = members.select("source", F.explode(F.array_compact(F.array("default_profile", "profile"))).alias("profile")).distinct()
    unknown = [r["profile"] for r in asked.join(known, "profile", "left_anti").select("profile").distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown rate profile(s): {', '.join(sorted(unknown))}")
    own = strictest(asked.join(F.broadcast(known), "profile"), "source")  # nine profiles
    sized = members.groupBy("source").agg(F.count_distinct("board").alias("boards"), F.max("reserve").alias("reserve"))
    raised = F.least(F.lit(BACKSTOP), F.greatest("max_requests", F.col("boards") * F.col("per_board") + F.col("reserve"))).cast("int")
    claims = own.join(sized, "source").withColumn("max_requests", F.when(F.col("boards") < 1, F.col("max_requests")).otherwise(raised))
    return strictest(claims.join(members.select("source", "bucket").distinct(), "source"), "bucket")


def bucket_plans(members: DataFrame, postures: DataFrame) -> DataFrame:
    """(bucket, sources, planned, worst_case, ceiling, exceeded): boards that will be asked and the most requests that
    they may take, pages and details included, against the bucket's ceiling."""
    sums = members.groupBy("bucket").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("planned"), F.sum("page_budget").alias("pages"))
    detail = members.groupBy("source").agg(F.min("bucket").alias("bucket"), F.max("detail_budget").alias("detail")).groupBy("bucket").agg(F.sum("detail").alias("detail"))
    met = sums.join(detail, "bucket", "left").join(postures.select("bucket", F.col("max_requests").alias("ceiling")), "bucket", "left")
    worst = F.col("pages") + F.coalesce("detail", F.lit(0))
    ceiling = F.coalesce("ceiling", F.lit(PROFILES["standard"][2]))
    return met.select("bucket", "sources", "planned", worst.alias("worst_case"), ceiling.alias("ceiling"), (worst > ceiling).alias("exceeded"))


def daily_allowance(ceiling: Column, spent: Column, has_history: Column, buckets: Column) -> Column:
    """Requests that a run may make: its ceiling, less once four runs' worth is spent on all its buckets."""
    cap = F.least(F.lit(2 * BACKSTOP), ceiling * DAILY_RUNS) * F.greatest(F.lit(1), buckets)
    return F.when(has_history, F.greatest(F.lit(0), F.least(ceiling, cap - spent))).otherwise(ceiling)


def dry_run(planned: DataFrame, validators: DataFrame) -> DataFrame:
    """Planned URLs with what to expect: ``unchanged`` where a validator is known, else ``full``."""
    met = planned.join(validators.select("url", F.coalesce("etag", "last_modified").isNotNull().alias("known")), "url", "left")
    return met.withColumn("expected", F.when(F.coalesce("known", F.lit(False)), "unchanged").otherwise("full")).drop("known")


def keep_validators(fetched: DataFrame, skip: DataFrame) -> DataFrame:
    """Validators of answers that may be stored: those that carry one, and whose board neither failed nor was cut short."""
    return fetched.filter("etag is not null or last_modified is not null").join(skip.select("url").distinct(), "url", "left_anti")


def allowed(url: Column, hosts: list[str], hops: Column | None = None, most_hops: int = 3) -> Column:
    """True for https without credentials to one of ``hosts``, within so many redirects."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    ok = host.isin(hosts) & ~url.rlike("^[^/]*//[^/?#]*@")
    return ok if hops is None else ok & (hops <= most_hops)


def within_size(announced: Column, length: Column) -> Column:
    return (F.coalesce(announced, F.lit(0)) <= MOST_BYTES) & (length <= MOST_BYTES)


def retry(status: Column, attempt: Column, retry_after_s: Column, most: int = 3) -> Column:
    """Seconds to wait before another try, or null: for 429, 5xx and no answer at all (null status), the server's own
    wait or 1, 2, 4 s."""
    again = status.isNull() | (status == 429) | status.between(500, 599)
    return F.when(again & (attempt < most), F.coalesce(retry_after_s, F.pow(F.lit(2.0), attempt - 1)))


def denied(answers: DataFrame) -> DataFrame:
    """Buckets to put off for half an hour: those that answered 401 or 403 from their only host, or from two."""
    by = answers.groupBy("bucket").agg(F.count_distinct("host").alias("hosts"), F.count_distinct(F.when(F.col("status").isin(401, 403), F.col("host"))).alias("refusing"))
    return by.filter((F.col("refusing") >= 2) | ((F.col("hosts") == 1) & (F.col("refusing") == 1))).select("bucket", F.lit(1800).alias("defer_s"))


def settle(state: DataFrame, run: DataFrame, now: Column) -> DataFrame:
    """Rate states after a run (bucket, base_interval_s, ended_interval_s, failures, reason): failures in a row block
    from the fifth on; an interval that a run had to widen is kept, one that it did not relaxes."""
    met = state.alias("s").join(run.alias("r"), "bucket", "full_outer")
    failures = F.coalesce("r.failures", F.col("s.consecutive_failures"), F.lit(0))
    came = F.col("r.bucket").isNotNull()
    blocked = F.when(came & (failures >= 5), now + F.make_dt_interval(secs=block_seconds(failures)))
    widened = F.col("r.ended_interval_s") > F.coalesce("s.min_interval_override", F.col("r.base_interval_s"))
    interval = F.when(~came, F.col("s.min_interval_override")).when(widened, F.col("r.ended_interval_s")).otherwise(decayed(F.col("s.min_interval_override"), F.col("r.base_interval_s")))
    return met.select("bucket", F.coalesce(blocked, F.when(~came, F.col("s.blocked_until"))).alias("blocked_until"), interval.alias("min_interval_override"), failures.alias("consecutive_failures"), F.coalesce(F.when(came & (failures >= 5), F.col("r.reason")), F.lit("")).alias("reason"))


def clear_rate_state(state: DataFrame, bucket: str | None = None) -> DataFrame:
    """States without blocks and intervals; the place of a rotation stays."""
    hit = F.lit(True) if bucket is None else F.col("bucket") == bucket
    empty = {"blocked_until": None, "min_interval_override": None, "consecutive_failures": 0, "last_failure_at": None, "reason": ""}
    return state.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in empty.items() if c in state.columns})


def probes(companies: DataFrame, left_out: tuple[str, ...] = ("workday",)) -> DataFrame:
    """One enabled company for each platform and, of configured boards, each format: the first by key."""
    live = companies.filter("enabled").filter(~F.col("platform").isin(*left_out)).withColumn("fmt", F.when(F.col("platform") == "custom_json", F.col("fmt")).otherwise(""))
    return live.groupBy("platform", "fmt").agg(F.min("registry_key").alias("registry_key")).orderBy("platform", "fmt")


def probe_outcome(results: DataFrame) -> DataFrame:
    """One row: probes that failed, that were empty, and whether all passed. Unchanged boards are not empty."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    empty = ~failed & ~F.col("unchanged") & (F.col("fetched") == 0)
    return results.agg(F.count_if(failed).alias("failures"), F.count_if(empty).alias("empties")).withColumn("passed", (F.col("failures") == 0) & (F.col("empties") == 0))


def resolve_facets(offered: DataFrame, phrases: list[str], parameters: list[str], not_phrases: list[str]) -> DataFrame:
    """(tenant, site, parameter, facet_ids, descriptor): of the facet values that name internships, those of the first
    parameter in order that has any.

    offered: tenant, site, parameter, facet_id, descriptor. A descriptor with one of ``not_phrases`` is none.
    """
    from gristmill.functions.text import first_phrase, fold

    said = fold(F.col("descriptor"))
    turn = F.array_position(F.array(*[F.lit(p) for p in parameters]), F.col("parameter"))
    named = offered.withColumn("turn", turn).filter((F.col("turn") > 0) & first_phrase(said, phrases).isNotNull() & first_phrase(said, not_phrases).isNull())
    by = named.groupBy("tenant", "site", "turn", "parameter").agg(F.array_sort(F.collect_list("facet_id")).alias("facet_ids"), F.min("descriptor").alias("descriptor"))
    first = F.row_number().over(W.partitionBy("tenant", "site").orderBy("turn"))
    return by.withColumn("n", first).filter("n = 1").drop("n", "turn")


def stale_facets(facets: DataFrame, offered: DataFrame) -> DataFrame:
    """Stored facets (tenant, site, parameter, facet_ids) of which a board no longer offers some value."""
    now = offered.groupBy("tenant", "site", "parameter").agg(F.collect_set("facet_id").alias("now"))
    return facets.join(now, ["tenant", "site", "parameter"], "left").filter(F.col("now").isNull() | (F.size(F.array_except("facet_ids", "now")) > 0)).select(*facets.columns)


@contextmanager
def run_lock(spark, path: str, owner: str):
    """One run at a time over a store: a folder that only one can make, in the file system of the store, named after
    its owner; it goes when the run ends."""
    jvm = spark._jvm  # the file system that holds the store, whatever it is
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    note = jvm.org.apache.hadoop.fs.Path(f"{path}/{owner}")
    try:
        made = fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{path}.lock"))
    except Exception as e:
        raise RuntimeError(f"{path} cannot be locked") from e
    if not made:
        raise RuntimeError(f"{path} is held by another run")
    try:
        fs.mkdirs(note)
        yield
    finally:
        fs.delete(note, True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.lock"), False)
