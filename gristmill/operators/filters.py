"""Filters over postings and quarantine as lists of predicates, and gates over boards."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.control import rested_until

#: Days that a list looks back, and rows that a list of the quarantine shows, where nothing else is asked for.
WINDOW_DAYS, QUARANTINE_LIMIT = 14, 50
# Buckets as older rows have them, by their present name.
LEGACY = {"international": "other", "unknown": "remote"}


def bucket(location: Column) -> Column:
    """A location's present name."""
    old = F.create_map(*[F.lit(x) for new, was in LEGACY.items() for x in (was, new)])
    return F.coalesce(F.try_element_at(old, location), location)


@dataclass(frozen=True)
class JobFilters:
    """What a list of postings is narrowed to; None asks for nothing. ``status`` is open unless told otherwise."""

    location: str | None = None
    term: str | None = None
    role: str | None = None
    degree: str | None = None
    language: str | None = None
    source: str | None = None
    company: str | None = None
    status: str | None = "open"
    first_seen_after: datetime | None = None
    limit: int = 50

    def predicates(self) -> list[Column]:
        """All must hold. Duplicates are never listed; English and French rows include bilingual ones; a location
        includes its older name."""
        out = [F.col("duplicate_of").isNull()]
        for column, value in (("status", self.status), ("term", self.term), ("degree_requirement", self.degree), ("role", self.role), ("source", self.source), ("company", self.company)):
            if value is not None:
                out.append(F.col(column) == value)
        if self.location is not None:
            out.append(F.col("location").isin([self.location, *([LEGACY[self.location]] if self.location in LEGACY else [])]))
        if self.language is not None:
            out.append(F.col("language").isin([self.language, *(["bilingual"] if self.language in ("EN", "FR") else [])]))
        if self.first_seen_after is not None:
            out.append(F.col("first_seen") >= F.lit(self.first_seen_after))
        return out

    def within(self, days: int | None, now: datetime) -> JobFilters:
        """Looking back ``days`` at most, unless a date is given or no window is wanted."""
        if days is None or self.first_seen_after is not None:
            return self
        return replace(self, first_seen_after=now - timedelta(days=days))


def matching(jobs: DataFrame, filters: JobFilters) -> DataFrame:
    return jobs.filter(reduce(and_, filters.predicates()))


def list_jobs(jobs: DataFrame, filters: JobFilters) -> DataFrame:
    """The newest postings, ties by id."""
    return matching(jobs, filters).orderBy(F.col("first_seen").desc(), "id").limit(filters.limit)


@dataclass(frozen=True)
class QuarantineFilters:
    reason: str | None = None
    source: str | None = None
    company: str | None = None
    limit: int = QUARANTINE_LIMIT


def quarantined(quarantine: DataFrame, filters: QuarantineFilters) -> DataFrame:
    wanted = {"reason": filters.reason, "source": filters.source, "company": filters.company}
    return reduce(lambda df, x: df.filter(F.col(x[0]) == x[1]) if x[1] is not None else df, wanted.items(), quarantine)


def list_quarantined(quarantine: DataFrame, filters: QuarantineFilters) -> DataFrame:
    return quarantined(quarantine, filters).orderBy(F.col("first_seen").desc(), "id").limit(filters.limit)


def of_board(board: str) -> Column:
    """Ids of one board."""
    return F.col("id").startswith(board + ":")


def due(boards: DataFrame, visits: DataFrame, now: Column, refresh_hours: float, crawls: DataFrame | None = None) -> DataFrame:
    """Boards whose last success is older than the refresh interval, that never had one, or whose crawl is open;
    those that rest after failures are left out whatever their age."""
    seen = visits.select("board", "last_success_at", "last_attempt_at", "consecutive_failures")
    met = boards.join(seen, "board", "left")
    if crawls is None:
        met = met.withColumn("open_crawl", F.lit(False))
    else:
        met = met.join(crawls.select("board").distinct().withColumn("open_crawl", F.lit(True)), "board", "left")
    since = now - F.make_dt_interval(secs=F.lit(refresh_hours * 3600))
    fresh = F.lit(False) if refresh_hours <= 0 else F.coalesce(F.col("last_success_at") >= since, F.lit(False)) & ~F.coalesce("open_crawl", F.lit(False))
    resting = F.coalesce(now < rested_until(F.col("last_attempt_at"), F.col("consecutive_failures")), F.lit(False))
    return met.filter(~fresh & ~resting).select(*boards.columns)


def select_sources(companies: DataFrame, adapters: DataFrame, only: Iterable[str] | None = None, without: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(selected, unroutable): enabled companies with the source of their platform's adapter (platform, source), and
    those whose platform has none. Names that no adapter has are an error, and so is a choice of nothing."""
    known = {r["source"] for r in adapters.select("source").distinct().collect()}  # one row an adapter
    for names, said in ((only or (), "no enabled companies for source(s)"), (without, "unknown source(s) to exclude")):
        wrong = sorted(set(names) - known)
        if wrong:
            raise ValueError(f"{said}: {', '.join(wrong)}")
    live = companies.filter("enabled")
    routed = live.join(adapters, "platform")
    if only is not None:
        routed = routed.filter(F.col("source").isin(list(only)))
    if without:
        routed = routed.filter(~F.col("source").isin(list(without)))
    if not routed.limit(1).count():
        raise ValueError("the registry has no enabled companies with a matching adapter")
    return routed, live.join(adapters, "platform", "left_anti")


def detail_queue(jobs: DataFrame, fetched: DataFrame, source: str, limit: int, attempts: int = 3) -> DataFrame:
    """Ids of a source whose description is still wanted, newest first, ties by id: those of unknown term or role that
    were never fetched, or failed fewer than ``attempts`` times."""
    tried = fetched.select("id", "failed", "attempts")
    wanted = jobs.filter((F.col("source") == source) & (F.col("description") == "") & ((F.col("term") == "unknown") | (F.col("role") == "unknown")))
    again = F.col("attempts").isNull() | (F.col("failed") & (F.col("attempts") < attempts))
    return wanted.join(tried, "id", "left").filter(again).orderBy(F.col("first_seen").desc(), "id").limit(limit).select("id")
