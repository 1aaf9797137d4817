"""Streaming jobs: batches into the store, event logs, and what a complete crawl has seen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.merge import Batch, apply_batch, purge, upsert
from gristmill.operators.store import Store
from gristmill.session import cut


def into_store(stream: DataFrame, store: Store, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, greatest: str | None = None):
    """A query that upserts each micro-batch of postings into the store's ``jobs``; running a batch again changes nothing.

    Of rows with one id in a batch the greatest by all columns stays. greatest: a column by which a stored
    row stays that is not exceeded, so that batches may come in any order.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = prepare(batch) if prepare else batch
        order = F.struct(*([greatest] if greatest else []), *[c for c in rows.columns if c not in ("id", greatest)])
        rows = rows.groupBy("id").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*").select(*rows.columns)
        now = store.versions()
        old = store.read("jobs", now) if "jobs" in now else rows.limit(0)
        if greatest:
            known = old.select("id", F.col(greatest).alias("known"))
            rows = rows.join(known, "id", "left").filter(F.col("known").isNull() | (F.col(greatest) > F.col("known"))).drop("known")
        store.commit(jobs=upsert(old, rows))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def sync_stream(stream: DataFrame, store: Store, checkpoint: str, batch_of: Callable[[DataFrame], Batch], now: Column, retain: bool = True):
    """A query that applies each micro-batch of one source to the store's jobs, quarantine and tombstones in one commit:
    first_seen as it is known, whatever was purged before; expired rows go after each batch. ``counts`` has a row for each
    batch id: a batch that is run again, after a crash, replaces its own."""

    def apply(rows: DataFrame, number: int) -> None:
        jobs, quarantine, tombstones = store.read_all("jobs", "quarantine", "tombstones")
        jobs, quarantine, counts = apply_batch(jobs, quarantine, tombstones, batch_of(rows))
        if retain:
            jobs, tombstones = purge(cut(jobs), tombstones, now)
        tables = {"jobs": jobs, "quarantine": quarantine, "tombstones": tombstones}
        counts = counts.withColumn("batch", F.lit(number).cast("long"))
        if "counts" in store.versions():
            counts = store.read("counts").filter(F.col("batch") != number).unionByName(counts)
        store.commit(**tables, counts=counts)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def event_log(streams: dict[str, DataFrame], path: str, checkpoint: str):
    """One append-only log of what several sources tell (source, at, kind, payload), in folders by source."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sorted(streams.items())]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return one.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("source").trigger(availableNow=True)


def changed_only(fetched: DataFrame, validators: DataFrame) -> DataFrame:
    """Answers (url, etag, last_modified) that are not what a known validator says; works on streams too. An answer
    without a validator always counts as changed."""
    known = validators.select("url", F.col("etag").alias("was_etag"), F.col("last_modified").alias("was_modified"))
    met = fetched.join(known, "url", "left")
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("was_etag")).otherwise(F.col("last_modified") == F.col("was_modified"))
    return met.filter(~F.coalesce(same, F.lit(False))).drop("was_etag", "was_modified")


def bump_seen(jobs: DataFrame, done: DataFrame, stamp: Column) -> DataFrame:
    """Open rows whose ids a complete crawl (rows of ``state.crawls``) saw are seen at ``stamp``."""
    ids = done.filter("state = 'complete' and id is not null").select("id").distinct().withColumn("hit", F.lit(True))
    return jobs.join(ids, "id", "left").withColumn("last_seen", F.when(F.col("hit") & (F.col("status") == "open"), stamp).otherwise(F.col("last_seen"))).drop("hit")
