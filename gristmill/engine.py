"""The engine: lists, searches, reports and maintenance over the tables of one store."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import classify, urls
from gristmill.operators import dedup, filters, merge, planning, registry, reports, search
from gristmill.operators.filters import WINDOW_DAYS, JobFilters, QuarantineFilters
from gristmill.operators.index import LENGTHS, POSTINGS, REPLACED, Index
from gristmill.operators.store import Store
from gristmill.session import cut
from gristmill.sources import export

JOBS = (
    "id string, source string, board_key string, rank int, company string, company_fold string, title_raw string, title_normalized string, title_canonical string, title_key string, "
    "apply_url_raw string, url string, description string, location_raw string, location string, remote_scope string, term string, role string, language string, "
    "degree_requirement string, work_auth_flag boolean, status string, first_seen timestamp, last_seen timestamp, duplicate_of string"
)
TABLES = {
    "jobs": JOBS,
    "quarantine": "id string, source string, company string, title_raw string, reason string, first_seen timestamp, last_seen timestamp, apply_url_raw string, location_raw string, location string, remote_scope string, matched_phrase string",
    "tombstones": "id string, source string, first_seen timestamp, purged_at timestamp",
    "validators": "url string, source string, etag string, last_modified string, fetched_at timestamp",
    "rate_state": "bucket string, blocked_until timestamp, min_interval_override double, consecutive_failures int, last_failure_at timestamp, reason string, rotation_cursor string",
    "visits": "source string, board string, label string, last_attempt_at timestamp, last_success_at timestamp, consecutive_failures int, last_error string",
    "reviews": "company string, company_fold string, disposition string, note string, checked_on timestamp, url string",
    "runs": "run_id long, started_at timestamp, finished_at timestamp, outcome string",
    "run_sources": "run_id long, source string, fetched long, added long, updated long, closed long, quarantined long, errors long, requests long, not_modified long, retries long, tightenings long, latency_p50_ms double, latency_p95_ms double, elapsed_ms double, deferred long, blocked boolean, stored long",
    "detail_fetches": "id string, source string, fetched_at timestamp, resolved boolean, attempts int, failed boolean",
    "facets": "tenant string, site string, parameter string, facet_ids array<string>, descriptor string, resolved_at timestamp",
    "crawls": "board string, next_offset long, total long, facet_parameter string, facet_ids array<string>",
    "companies": registry.COMPANY + ", registry_key string, board string",
}


def posting_rows(normalized: DataFrame) -> DataFrame:
    """Kept rows of ``classify.normalize`` with what duplicates are found by."""
    title = F.col("title_raw")
    facts = {
        "board_key": classify_board(), "rank": dedup.source_rank(F.col("source")), "company_fold": classify.fold(F.col("company")), "title_normalized": F.lower(title),
        "title_canonical": classify.title_canonical(title), "title_key": merge.title_key(title), "url": F.col("apply_url_canonical"), "status": F.lit("open"), "duplicate_of": F.lit(None).cast("string"),
    }
    have = normalized.withColumns(facts)
    names = [x.strip().split(" ")[0] for x in JOBS.split(",")]
    return have.select(*[F.col(c) if c in have.columns else F.lit("").alias(c) for c in names])


def classify_board() -> Column:
    from gristmill.functions.text import board_of

    return board_of(F.col("id"), F.col("source"))


@dataclass(frozen=True)
class Answers:
    """What a run learnt beside its rows; what is left out stays as it is stored.

    visits: source, board, label, at, succeeded, error, a row for each board that was asked. fetched: url,
    source, etag, last_modified, fetched_at; degraded: url of boards that failed or were cut short, whose
    validators are not kept. details: id, source, fetched_at, resolved, failed. facets: tenant, site,
    parameter, facet_ids, descriptor, resolved_at, pinned; forgotten: tenant, site. crawls: board, next_offset,
    total, facet_parameter, facet_ids of crawls that go on; ended: board. rate: rows of ``rate_state``. run:
    started_at, finished_at, outcome; sources: rows of ``run_sources`` without run_id.
    """

    visits: DataFrame | None = None
    fetched: DataFrame | None = None
    degraded: DataFrame | None = None
    details: DataFrame | None = None
    facets: DataFrame | None = None
    forgotten: DataFrame | None = None
    crawls: DataFrame | None = None
    ended: DataFrame | None = None
    rate: DataFrame | None = None
    run: DataFrame | None = None
    sources: DataFrame | None = None

    def tables(self, read) -> dict[str, DataFrame]:
        """The tables that change, by ``read`` of the old ones."""
        out: dict[str, DataFrame] = {}
        if self.visits is not None:
            out["visits"] = merge.visits(read("visits"), self.visits)
        if self.fetched is not None:
            known = planning.keep_validators(self.fetched, self.degraded if self.degraded is not None else self.fetched.limit(0))
            out["validators"] = merge.replace_by(read("validators"), known, "url")
        if self.details is not None:
            out["detail_fetches"] = merge.detail_fetches(read("detail_fetches"), self.details)
        if self.facets is not None or self.forgotten is not None:
            before = read("facets")
            found = self.facets if self.facets is not None else before.withColumn("pinned", F.lit(False)).limit(0)
            out["facets"] = merge.facets(before, self.forgotten if self.forgotten is not None else before.limit(0), found)
        if self.crawls is not None or self.ended is not None:
            before = read("crawls")
            left = before if self.ended is None else before.join(self.ended.select("board").distinct(), "board", "left_anti").select(*before.columns)
            out["crawls"] = left if self.crawls is None else merge.replace_by(left, self.crawls, "board")
        if self.rate is not None:
            out["rate_state"] = merge.rate_states(read("rate_state"), self.rate)
        if self.run is not None:
            runs, before = read("runs"), read("run_sources")
            number = (runs.agg(F.max("run_id")).first()[0] or 0) + 1
            add = lambda old, new: old.unionByName(new.withColumn("run_id", F.lit(number).cast("long")).select(*old.columns))
            out["runs"] = add(runs, self.run)
            if self.sources is not None:
                out["run_sources"] = add(before, self.sources)
        return out


def changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` that ``old`` lacks or has otherwise, ids that ``new`` lacks); ids are unique in both."""
    said = F.xxhash64(*[F.col(c) for c in new.columns], *[F.col(c).isNull() for c in new.columns])
    new = cut(new)
    known = old.select("id", said.alias("_said"))
    changed = new.withColumn("_said", said).join(known, ["id", "_said"], "left_anti").select(*new.columns)
    return cut(changed), old.select("id").join(new.select("id"), "id", "left_anti")


class Engine:
    """All reads of one call see one commit; every change is one commit of all tables it touches.

    A commit fails if another one came since its reads (``store.Conflict``). Postings, the quarantine and
    tombstones are dealt out by id, so that a commit writes only the buckets that hold a changed row; the
    search index takes the changed postings in the same commit.
    """

    #: Tables with a unique id, which are written bucket by bucket.
    BY_ID = ("jobs", "quarantine", "tombstones")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.index = Index(self.store)
        if not self.store.last():
            tables = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
            self.store.commit(0, upsert={t: (tables.pop(t), None, "id") for t in self.BY_ID}, **tables)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    @contextmanager
    def exclusive(self, owner: str):
        """One run at a time: a lock beside the tables that other runs meet before they ask a single board."""
        with planning.run_lock(self.spark, f"{self.store.root}/_run", owner):
            yield self

    def _snapshot(self):
        """(commit, its versions, a reader of its tables)."""
        base = self.store.last()
        now = self.store.versions(base)
        return base, now, lambda t: self.store.read(t, now)

    def _commit(self, base: int, now: dict, **tables: DataFrame) -> int:
        """One commit of new states of tables, of which only what differs from ``base`` is written."""
        by_id = {t: (*changes(self.store.read(t, now), tables.pop(t)), "id") for t in self.BY_ID if t in tables}
        if "jobs" not in by_id:
            return self.store.commit(base, upsert=by_id, **tables)
        changed, gone, _ = by_id["jobs"]
        d = self.index.delta(changed, gone, now)
        number = self.store.commit(base, append=d.append, upsert=by_id | d.upsert, meta=d.meta, **tables)
        return self.index.compact() if self.index.crowded() else number

    def reindex(self) -> int:
        """The search index made anew from the postings."""
        base, now, read = self._snapshot()
        bare = {t: e for t, e in now.items() if t not in (POSTINGS, REPLACED, LENGTHS, "_meta")}
        d = self.index.delta(read("jobs"), None, bare)
        empty = {t: {"schema": now[t]["schema"], "parts": []} for t in (POSTINGS, REPLACED, LENGTHS) if t in now}
        return self.store.commit(base, append=d.append, upsert=d.upsert, meta=d.meta, emptied=empty)

    def expire(self, keep: int = 2) -> int:
        """Removes what only older commits than the last ``keep`` need."""
        return self.store.expire(keep)

    # Reads

    def list_jobs(self, wanted: JobFilters | None = None, window_days: int | None = WINDOW_DAYS, now: datetime | None = None) -> tuple[DataFrame, int]:
        """(page, total): the newest postings that match, looking back two weeks unless told otherwise."""
        jobs, f = self.table("jobs"), (wanted or JobFilters()).within(window_days, now or datetime.now(UTC))
        return filters.list_jobs(jobs, f), filters.matching(jobs, f).count()

    def search(self, query: str, wanted: JobFilters | None = None, window_days: int | None = None, now: datetime | None = None) -> tuple[DataFrame, int]:
        """(page, total) of postings by rank; without a window unless asked for, and nothing for a query without a term.

        Ranks come from the index; of the postings only the columns that ``wanted`` asks about are read, and whole
        rows only for the page, whose ids (``wanted.limit`` at most) are looked up in their buckets.
        """
        _, versions, read = self._snapshot()
        jobs, f = read("jobs"), (wanted or JobFilters()).within(window_days, now or datetime.now(UTC))
        ranked = self.index.scores(search.query_terms(self.spark, query), versions)
        scored = cut(ranked.join(jobs.filter(reduce(and_, f.predicates())).select("id", "first_seen"), "id"))
        order = ["score", F.col("first_seen").desc(), "id"]
        best = scored.orderBy(*order).limit(f.limit).select("id", "score").collect()  # a page
        ids = [r["id"] for r in best]
        page = self.store.read("jobs", versions, self.store.buckets_of(ids)).filter(F.col("id").isin(ids))
        return page.join(F.broadcast(self.spark.createDataFrame([(r["id"], r["score"]) for r in best], "id string, score double")), "id").orderBy(*order), scored.count()

    def get_posting(self, job_id: str) -> DataFrame:
        return reports.posting(self.table("jobs"), job_id)

    def list_quarantined(self, wanted: QuarantineFilters | None = None) -> tuple[DataFrame, int]:
        q, f = self.table("quarantine"), wanted or QuarantineFilters()
        return filters.list_quarantined(q, f), filters.quarantined(q, f).count()

    def export(self, path: str, fmt: str = "csv", wanted: JobFilters | None = None, force: bool = False) -> None:
        export.write(export.projection(filters.list_jobs(self.table("jobs"), wanted or JobFilters(limit=5000))), path, fmt, force)

    def stats(self) -> DataFrame:
        return reports.statistics(*self.store.read_all("jobs", "quarantine", "tombstones", "validators"))

    def run_history(self, n: int = reports.HISTORY) -> DataFrame:
        """The newest runs with their sources nested."""
        runs, sources = self.store.read_all("runs", "run_sources")
        newest = runs.join(reports.newest_runs(runs, n), "run_id", "left_semi")
        nested = sources.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("source", *[c for c in sources.columns if c not in ("run_id", "source")]))).alias("sources"))
        return newest.join(nested, "run_id", "left").orderBy(F.col("run_id").desc())

    def last_sync_at(self) -> datetime | None:
        return self.table("runs").agg(F.max("finished_at")).first()[0]

    def doctor(self, now: Column, stale_days: int = reports.STALE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(health by source, findings, verdict)."""
        jobs, quarantine, tombstones, visits, runs, sources, rate, companies = self.store.read_all("jobs", "quarantine", "tombstones", "visits", "runs", "run_sources", "rate_state", "companies")
        health = cut(reports.source_health(jobs, visits, runs, sources, now, stale_days))
        findings = cut(merge.integrity_findings(jobs, quarantine, tombstones))
        return health, findings, reports.verdict(health, findings, rate, companies, now)

    def coverage(self, now: Column, stale_days: int = reports.STALE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows of the register, employers it lacks, reviews that no longer hold)."""
        from gristmill.functions.text import name_tokens

        companies, jobs, visits, quarantine, reviews = self.store.read_all("companies", "jobs", "visits", "quarantine", "reviews")
        names = companies.select(name_tokens(F.col("name")).alias("reg_toks")).union(reviews.select(name_tokens(F.col("company"))))
        return reports.coverage_rows(companies, jobs, visits, now, stale_days), reports.unregistered_companies(jobs, quarantine, names), reports.contradicted(reviews, companies, now)

    def discover(self, links: DataFrame) -> DataFrame:
        """``links`` (url) with the board that each belongs to."""
        return links.withColumn("board", urls.identify(F.col("url")))

    def load_facets(self, tenant: str, site: str) -> DataFrame:
        """What was resolved for a tenant's site: parameter, facet_ids, descriptor."""
        return self.table("facets").filter((F.col("tenant") == tenant) & (F.col("site") == site)).select("parameter", "facet_ids", "descriptor", "resolved_at")

    def load_crawls(self) -> DataFrame:
        """Crawls that go on where they stopped, and how many open rows their boards have."""
        kept = self.table("jobs").filter("status = 'open'").groupBy(F.col("board_key").alias("board")).agg(F.count("*").alias("stored"))
        return self.table("crawls").join(kept, "board", "left").fillna(0, ["stored"])

    def canary(self) -> DataFrame:
        return planning.probes(self.table("companies"))

    # Changes

    def sync(self, source: str, postings: DataFrame, stamp: Column, unchanged: DataFrame | None = None, closable: DataFrame | None = None, closes_source: bool = False, dry_run: bool = False, answers: Answers | None = None) -> DataFrame:
        """Counts of one source's run: its rows read, screened and merged, and what its answers tell, in one commit."""
        kept, bad = classify.split_screened(cut(classify.normalize(postings)))
        base, now, read = self._snapshot()
        batch = merge.Batch(source, stamp, posting_rows(kept), bad, unchanged, closable, closes_source)
        jobs, quarantine, counts = merge.apply_batch(read("jobs"), read("quarantine"), read("tombstones"), batch)
        counts = cut(counts)
        if not dry_run:
            self._commit(base, now, jobs=jobs, quarantine=quarantine, **(answers.tables(read) if answers else {}))
        return counts

    def record(self, answers: Answers) -> None:
        """What a run learnt without rows: of boards that failed or were put off."""
        base, now, read = self._snapshot()
        self._commit(base, now, **answers.tables(read))

    def record_run(self, run: DataFrame, sources: DataFrame) -> None:
        """Appends a run (started_at, finished_at, outcome) and its sources."""
        self.record(Answers(run=run, sources=sources))

    def purge(self, now: Column, dry_run: bool = False) -> dict[str, int]:
        base, versions, read = self._snapshot()
        n = merge.purge_preview(read("jobs"), now).first()["purged"]
        if not dry_run:
            jobs, tombstones = merge.purge(read("jobs"), read("tombstones"), now)
            self._commit(base, versions, jobs=jobs, tombstones=tombstones)
        return {"purged": n, "tombstoned": n}

    def rescreen(self, stamp: Column, dry_run: bool = False) -> dict[str, int]:
        base, now, read = self._snapshot()
        jobs, quarantine, done = merge.rescreen(read("jobs"), read("quarantine"), read("tombstones"), stamp)
        if not dry_run:
            self._commit(base, now, jobs=jobs, quarantine=quarantine)
        return done

    def repair(self) -> DataFrame:
        """Findings before and after the repairs."""
        base, now, read = self._snapshot()
        before = cut(merge.integrity_findings(read("jobs"), read("quarantine"), read("tombstones")))
        self._commit(base, now, jobs=merge.repair(read("jobs"), read("tombstones")))
        after = merge.integrity_findings(self.table("jobs"), read("quarantine"), read("tombstones")).withColumnRenamed("count", "left")
        return before.join(after, "check")

    def classify(self, reviews: DataFrame) -> None:
        base, now, read = self._snapshot()
        self._commit(base, now, reviews=reports.record_reviews(read("reviews"), reviews))

    def clear(self, rate_bucket: str | None = None, rate: bool = False, validators_of: str | None = None, validators: bool = False) -> dict[str, int]:
        """Rows whose rate state, and validators that, were cleared."""
        base, now, read = self._snapshot()
        states, cache = read("rate_state"), read("validators")
        hit = states.filter(F.lit(True) if rate else F.col("bucket") == F.lit(rate_bucket)) if rate or rate_bucket else states.limit(0)
        gone = cache.filter(F.lit(True) if validators else F.col("source") == F.lit(validators_of)) if validators or validators_of else cache.limit(0)
        done = {"rate_state": hit.count(), "validators": gone.count()}
        self._commit(base, now, rate_state=planning.clear_rate_state(states, None if rate else rate_bucket or ""), validators=cache.join(gone.select("url"), "url", "left_anti").select(*cache.columns))
        return done

