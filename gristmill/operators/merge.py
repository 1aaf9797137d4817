"""Batch merge of postings as pure functions of DataFrames: each returns the next version of a table.

Spark's own tables have no MERGE, so a merge is a join on the id that writes a new snapshot; ``store``
swaps snapshots. All joins are equi-joins on ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import classify
from gristmill.functions.text import board_of, fold, tokens
from gristmill.session import cut

from . import dedup

#: Boards that are sent to every task at most.
MOST_BOARDS = 100_000


def first_seen_known(batch: DataFrame, jobs: DataFrame, quarantine: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``batch`` with first_seen as it is known: from jobs, else quarantine, else tombstones, else its own."""
    known = [t.select("id", F.lit(i).alias("prio"), F.col("first_seen").alias("seen")) for i, t in enumerate((jobs, quarantine, tombstones))]
    best = known[0].unionByName(known[1]).unionByName(known[2]).groupBy("id").agg(F.min_by("seen", "prio").alias("seen"))
    return batch.join(best, "id", "left").withColumn("first_seen", F.coalesce("seen", "first_seen")).drop("seen")


def of_boards(jobs: DataFrame, boards: DataFrame, name: str) -> DataFrame:
    """``jobs`` with a mark ``name`` on rows of ``boards`` (board_key), else null. A board may hold a large part of
    the rows, so up to MOST_BOARDS boards, which are counted, are sent to the rows."""
    listed = cut(boards.select(F.col("board_key").alias("_board")).distinct())
    few = F.broadcast(listed) if listed.count() <= MOST_BOARDS else listed
    return jobs.join(few, F.col("board_key") == F.col("_board"), "left").withColumn(name, F.when(F.col("_board").isNotNull(), True)).drop("_board")


def upsert(jobs: DataFrame, batch: DataFrame, keep: tuple[str, ...] = ("first_seen", "duplicate_of")) -> DataFrame:
    """Rows of ``jobs`` replaced by those of ``batch`` with the same id, but for the columns in ``keep``; new rows added."""
    old, new = jobs.alias("o"), batch.alias("n")
    there, comes = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    cols = [F.coalesce("o.id", "n.id").alias("id")]
    for c in jobs.columns:
        if c != "id":
            value = F.when(comes & ~(there if c in keep else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
            cols.append(value.alias(c))
    return old.join(new, F.col("o.id") == F.col("n.id"), "full_outer").select(*cols)


def touch(jobs: DataFrame, unchanged: DataFrame, stamp: Column) -> DataFrame:
    """Open rows of unchanged boards (board_key) are seen at ``stamp``."""
    hit = of_boards(jobs, unchanged, "hit")
    return hit.withColumn("last_seen", F.when(F.col("hit") & (F.col("status") == "open"), stamp).otherwise(F.col("last_seen"))).drop("hit")


def close_missing(jobs: DataFrame, closable: DataFrame, stamp: Column) -> DataFrame:
    """Open rows of the boards in ``closable`` that were not seen in this run are closed."""
    hit = of_boards(jobs, closable, "hit")
    gone = F.col("hit") & (F.col("status") == "open") & (F.col("last_seen") < stamp)
    return hit.withColumn("status", F.when(gone, "closed").otherwise(F.col("status"))).drop("hit")


def close_source(jobs: DataFrame, source: str, stamp: Column) -> DataFrame:
    """Open rows of a whole source, a feed, that were not seen in this run are closed."""
    gone = (F.col("source") == source) & (F.col("status") == "open") & (F.col("last_seen") < stamp)
    return jobs.withColumn("status", F.when(gone, "closed").otherwise(F.col("status")))


def move_to_quarantine(jobs: DataFrame, quarantine: DataFrame, rejected: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, quarantine): rejected ids leave the first for the second, and duplicates of theirs elect a new canonical
    row, where jobs have links; accepted ones leave the second."""
    left = jobs.join(rejected.select("id"), "id", "left_anti")
    stay = quarantine.join(accepted.select("id").union(rejected.select("id")).distinct(), "id", "left_anti")
    linked = {"duplicate_of", "rank"} <= set(jobs.columns)
    return promote_orphans(left) if linked else left, stay.unionByName(rejected.select(*quarantine.columns))


def expired(now: Column, open_days: int = 14, closed_days: int = 3) -> Column:
    age = lambda d: F.col("first_seen") < now - F.make_dt_interval(F.lit(d))
    return ((F.col("status") == "open") & age(open_days)) | ((F.col("status") == "closed") & age(closed_days))


def purge(jobs: DataFrame, tombstones: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, tombstones): expired rows become tombstones; one that is there keeps its first_seen. Links that a better
    ranked duplicate turns round are turned first; then duplicates of purged rows elect the best ranked of them."""
    jobs = reseat(jobs)
    gone = jobs.filter(expired(now))
    dead = gone.select("id", "source", "first_seen", now.alias("purged_at"))
    known = tombstones.select("id", F.col("first_seen").alias("was"))
    fresh = dead.join(known, "id", "left").withColumn("first_seen", F.coalesce("was", "first_seen")).drop("was")
    rest = tombstones.join(dead.select("id"), "id", "left_anti").unionByName(fresh.select(*tombstones.columns))
    return promote_orphans(jobs.filter(~expired(now))), rest


def purge_preview(jobs: DataFrame, now: Column) -> DataFrame:
    """One row: what a purge would take."""
    return jobs.agg(F.count_if(expired(now)).alias("purged")).withColumn("tombstoned", F.col("purged"))


def promote_orphans(jobs: DataFrame) -> DataFrame:
    """Duplicates whose canonical row is gone follow the first of them by (rank, id), which becomes canonical."""
    ids = jobs.select(F.col("id").alias("canon"))
    orphan = jobs.filter("duplicate_of is not null").join(ids, F.col("duplicate_of") == F.col("canon"), "left_anti")
    heirs = orphan.groupBy("duplicate_of").agg(F.min(F.struct("rank", "id"))["id"].alias("heir"))
    moved = jobs.join(heirs.withColumnRenamed("duplicate_of", "led"), dedup.lead("duplicate_of", "led"), "left").drop("led")
    return moved.withColumn("duplicate_of", F.when(F.col("heir").isNull(), F.col("duplicate_of")).when(F.col("heir") != F.col("id"), F.col("heir"))).drop("heir").select(*jobs.columns)


def reseat(jobs: DataFrame) -> DataFrame:
    """Where a duplicate out-ranks its canonical row, the best of the cluster becomes canonical. Rows that lead nobody
    and follow nobody are only passed on."""
    own = jobs.withColumn("cluster", F.coalesce("duplicate_of", "id"))
    best = own.groupBy("cluster").agg(F.min(F.struct("rank", "id"))["id"].alias("best"))
    return own.join(best, "cluster").withColumn("duplicate_of", F.when(F.col("best") != F.col("id"), F.col("best"))).select(*jobs.columns)


def flatten_chains(links: DataFrame, passes: int = 40) -> DataFrame:
    """(id, duplicate_of) with every chain pointing at its end. Each pass halves what is left of a chain, so 40 serve
    any; a ring of links has no end and is an error."""
    for _ in range(passes):
        up = links.select(F.col("id").alias("mid"), F.col("duplicate_of").alias("end"))
        step = cut(links.join(up, F.col("duplicate_of") == F.col("mid"), "left").select("id", F.coalesce("end", "duplicate_of").alias("duplicate_of"), F.col("end").isNotNull().alias("moved")))
        links = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return links
    raise RuntimeError(f"links did not end in {passes} passes; some run in a ring")


def visits(before: DataFrame, now: DataFrame) -> DataFrame:
    """Visits after a run: failures keep the last success and count up, successes reset the count.

    Where ``before`` has a label and a last error, ``now`` has label and error; a success clears the error.
    """
    o, n = before.alias("o"), now.alias("n")
    ok = F.col("n.succeeded")
    came = F.col("n.board").isNotNull()
    return o.join(n, (F.col("o.source") == F.col("n.source")) & (F.col("o.board") == F.col("n.board")), "full_outer").select(
        F.coalesce("n.source", "o.source").alias("source"), F.coalesce("n.board", "o.board").alias("board"), F.coalesce("n.at", "o.last_attempt_at").alias("last_attempt_at"),
        F.when(came & ok, F.col("n.at")).otherwise(F.col("o.last_success_at")).alias("last_success_at"),
        F.when(~came, F.col("o.consecutive_failures")).when(ok, 0).otherwise(F.coalesce("o.consecutive_failures", F.lit(0)) + 1).alias("consecutive_failures"),
        *([F.coalesce("n.label", "o.label").alias("label")] if "label" in before.columns else []),
        *([F.when(~came, F.col("o.last_error")).when(~ok, F.col("n.error")).alias("last_error")] if "last_error" in before.columns else []),
    )


def change_counts(before: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: ids added and updated by a batch."""
    known = before.select("id", F.lit(True).alias("known"))
    return batch.select("id").join(known, "id", "left").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("updated"))


def carry_forward(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``value`` where empty, from the last row before that has one."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(w))


@dataclass(frozen=True)
class Batch:
    """What one run of a source brings: its rows, those it rejected, boards that answered that nothing changed, and
    boards, or the whole source, whose listing was complete."""

    source: str
    stamp: Column
    jobs: DataFrame
    quarantined: DataFrame | None = None
    unchanged: DataFrame | None = None
    closable: DataFrame | None = None
    closes_source: bool = False
    resolve: bool = True


def apply_batch(jobs: DataFrame, quarantine: DataFrame, tombstones: DataFrame, batch: Batch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, quarantine, counts) after a batch; running it again changes nothing but what it counts as added.

    In order: first_seen as it is known, upsert, the move to quarantine and back, touched boards, closed
    rows, duplicate links. Rows of a repeated id count once, the last seen, then the least by all columns.
    counts: fetched, added, updated, closed, touched, quarantined, duplicates, stored, in one row.
    """
    new = cut(first_seen_known(_one_each(batch.jobs), jobs, quarantine, tombstones).select(*jobs.columns))
    bad = _one_each(batch.quarantined) if batch.quarantined is not None else quarantine.limit(0)
    bad = cut(first_seen_known(bad, jobs, quarantine, tombstones).select(*quarantine.columns))
    counts = change_counts(jobs, new).first()
    merged = upsert(jobs, new)
    merged, held = move_to_quarantine(merged, quarantine, bad, new)
    own = F.col("source") == batch.source
    if batch.unchanged is not None:
        merged = of_boards(merged, batch.unchanged, "same")
        hit = F.col("same") & own & (F.col("status") == "open")
        merged = merged.withColumn("touched", F.coalesce(hit, F.lit(False))).withColumn("last_seen", F.when(hit, batch.stamp).otherwise(F.col("last_seen"))).drop("same")
    else:
        merged = merged.withColumn("touched", F.lit(False))
    late = own & (F.col("status") == "open") & (F.col("last_seen") < batch.stamp)
    if batch.closes_source:
        merged = merged.withColumn("gone", late)
    elif batch.closable is not None:
        merged = of_boards(merged, batch.closable, "whole").withColumn("gone", F.coalesce(F.col("whole") & late, F.lit(False))).drop("whole")
    else:
        merged = merged.withColumn("gone", F.lit(False))
    merged = cut(merged.withColumn("status", F.when(F.col("gone"), "closed").otherwise(F.col("status"))))
    said = merged.agg(F.count_if("touched").alias("touched"), F.count_if("gone").alias("closed"), F.count_if(own & (F.col("status") == "open")).alias("stored")).first()
    merged, linked = merged.select(*jobs.columns), 0
    if batch.resolve and counts["added"] + counts["updated"]:
        near = dedup.pool(new, merged)
        links = cut(dedup.clusters(near.withColumnRenamed("board_key", "board"), new))
        linked = links.count()
        merged = dedup.write_links(merged, new, links)
    n_bad = bad.count()
    row = (batch.source, counts["added"] + counts["updated"] + n_bad, counts["added"], counts["updated"], said["closed"], said["touched"], n_bad, linked, said["stored"])
    names = "source string, fetched long, added long, updated long, closed long, touched long, quarantined long, duplicates long, stored long"
    return merged, held, jobs.sparkSession.createDataFrame([row], names)


def _one_each(rows: DataFrame) -> DataFrame:
    every = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(["last_seen", *[c for c in rows.columns if c not in ("last_seen", "id")]])])
    return rows.groupBy("id").agg(F.max(every).alias("best")).select("id", *[F.col(f"best._{i}").alias(c) for i, c in enumerate(["last_seen", *[c for c in rows.columns if c not in ("last_seen", "id")]])]).select(*rows.columns)


def rate_states(before: DataFrame, now: DataFrame) -> DataFrame:
    """Rate states after a run: of two blocks of a bucket the later stays, with its reason; the rest is the new one's."""
    o, n = before.alias("o"), now.alias("n")
    came = F.col("n.bucket").isNotNull()
    later = F.coalesce(F.col("n.blocked_until") >= F.col("o.blocked_until"), F.col("o.blocked_until").isNull())
    value = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    out = [F.coalesce("n.bucket", "o.bucket").alias("bucket")]
    for c in before.columns:
        if c == "blocked_until":
            out.append(F.when(came, F.greatest("n.blocked_until", "o.blocked_until")).otherwise(F.col("o.blocked_until")).alias(c))
        elif c == "reason":
            out.append(F.when(came & later, F.col("n.reason")).otherwise(F.coalesce("o.reason", "n.reason")).alias(c))
        elif c != "bucket":
            out.append(value(c).alias(c))
    return o.join(n, F.col("o.bucket") == F.col("n.bucket"), "full_outer").select(*out)


def detail_fetches(before: DataFrame, now: DataFrame) -> DataFrame:
    """Fetched details after a run: a row that was tried again counts one attempt more."""
    o, n = before.alias("o"), now.alias("n")
    came = F.col("n.id").isNotNull()
    value = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    tried = (F.coalesce("o.attempts", F.lit(0)) + came.cast("int")).alias("attempts")
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(F.coalesce("n.id", "o.id").alias("id"), value("source"), value("fetched_at"), value("resolved"), tried, value("failed"))


def replace_by(before: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``before`` with those of ``now`` in place of rows with equal keys: validators, facets, reviews."""
    return before.join(now.select(*keys).distinct(), list(keys), "left_anti").unionByName(now.select(*before.columns))


def facets(before: DataFrame, forgotten: DataFrame, found: DataFrame) -> DataFrame:
    """Resolved facets by (tenant, site): forgotten ones go, found ones are set, pinned ones are never stored."""
    left = before.join(forgotten.select("tenant", "site").distinct(), ["tenant", "site"], "left_anti")
    return replace_by(left, found.filter("not pinned").drop("pinned"), "tenant", "site")


def integrity_findings(jobs: DataFrame, quarantine: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(check, count): the six ways in which the tables may contradict each other."""
    up = jobs.select(F.col("id").alias("c_id"), F.col("source").alias("c_source"), F.col("duplicate_of").alias("c_dup"))
    met = jobs.filter("duplicate_of is not null").join(up, F.col("duplicate_of") == F.col("c_id"), "left")
    links = met.agg(F.count_if(F.col("c_id").isNull()).alias("dangling duplicate links"), F.count_if(F.col("c_dup").isNotNull()).alias("duplicate chains"), F.count_if(F.col("source") == F.col("c_source")).alias("same-source merges"))
    late = jobs.join(tombstones.select("id", F.col("first_seen").alias("was")), "id").agg(F.count_if(F.col("first_seen") > F.col("was")).alias("tombstoned rows re-ingested as new"))
    both = jobs.join(quarantine.select("id"), "id").agg(F.count("*").alias("postings in both tables"))
    bare = jobs.agg(F.count_if(F.col("first_seen").isNull()).alias("open postings with no first_seen"))
    rows = [F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("count")) for c in one.columns])).alias("x") for one in (links, late, both, bare)]
    said = [one.select(r).select("x.*") for one, r in zip((links, late, both, bare), rows, strict=True)]
    return said[0].unionByName(said[1]).unionByName(said[2]).unionByName(said[3])


def repair(jobs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``jobs`` with dangling links and links within one source cut, chains flattened, and first_seen as the tombstone
    has it where a purged row came back as new."""
    up = jobs.select(F.col("id").alias("c_id"), F.col("source").alias("c_source"))
    met = jobs.join(up, dedup.lead("duplicate_of", "c_id"), "left")
    sound = F.when(F.col("c_id").isNotNull() & (F.col("source") != F.col("c_source")), F.col("duplicate_of"))
    cleared = cut(met.withColumn("duplicate_of", sound).drop("c_id", "c_source"))
    flat = flatten_chains(cleared.filter("duplicate_of is not null").select("id", "duplicate_of"))
    linked = cleared.drop("duplicate_of").join(flat, "id", "left")
    told = linked.join(tombstones.select("id", F.col("first_seen").alias("was")), "id", "left")
    return told.withColumn("first_seen", F.when(F.col("first_seen") > F.col("was"), F.col("was")).otherwise(F.col("first_seen"))).select(*jobs.columns)


def rescreen(jobs: DataFrame, quarantine: DataFrame, tombstones: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(jobs, quarantine, counts): place, role and screens of every canonical row again, until a pass changes nothing,
    as a row that goes may leave its place to a duplicate; then quarantined rows that now pass come back.

    Rows put away for the role or the place are tried again, by title and place alone. counts: examined,
    updated, quarantined, released. Passes end by themselves: each puts rows away for good, or corrects rows that the
    next one finds right.
    """
    done = {"examined": 0, "updated": 0, "quarantined": 0, "released": 0}
    for turn in count():
        live = jobs.filter("duplicate_of is null")
        again = classify.normalize(live.select("id", "title_raw", "description", "location_raw"))
        role = F.when(F.col("n.role") != "unknown", F.col("n.role")).otherwise(F.col("j.role"))
        met = live.alias("j").join(again.alias("n"), "id").select(*[F.col(f"j.{c}") for c in jobs.columns if c not in ("id", "location", "remote_scope", "role")], "id", F.col("n.location"), F.col("n.remote_scope"), role.alias("role"), F.struct(F.col("j.location"), F.col("j.remote_scope"), F.col("j.role")).alias("was"))
        judged = cut(met.withColumn("rejection", classify.screen(F.col("title_raw"), F.col("description"), F.lit(""), F.lit(""))))
        moved = judged.filter("rejection is null").filter(~F.struct("location", "remote_scope", "role").eqNullSafe(F.col("was")))
        bad = judged.filter("rejection is not null")
        n, n_moved, n_bad = judged.count(), moved.count(), bad.count()
        done["examined"] = n if turn == 0 else done["examined"]
        if not n_moved + n_bad:
            break
        batch = Batch("", stamp, moved.select(*jobs.columns), classify.to_quarantined(bad).select(*quarantine.columns), resolve=False)
        jobs, quarantine, _ = apply_batch(jobs, quarantine, tombstones, batch)
        jobs, quarantine = cut(jobs), cut(quarantine)
        done["updated"] += n_moved
        done["quarantined"] += n_bad
    tried = quarantine.filter(F.col("reason").isin("unknown-cs-role", "not-a-cs-role", "out-of-scope-location", "unknown-location")).drop("reason", "matched_phrase")
    kept = classify.normalize(tried.withColumn("description", F.lit(""))).filter("rejection is null").drop("rejection")
    facts = {"title_normalized": fold(F.col("title_raw")), "status": F.lit("open"), "board_key": board_of(F.col("id"), F.col("source")), "rank": dedup.source_rank(F.col("source")), "company_fold": fold(F.col("company")), "url": F.col("apply_url_canonical"), "title_key": title_key(F.col("title_raw")), "title_canonical": classify.title_canonical(F.col("title_raw"))}
    back = kept.withColumns({k: v for k, v in facts.items() if k in jobs.columns})
    full = back.select(*[F.col(c) if c in back.columns else F.lit(None).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns])
    released = cut(full)
    done["released"] = released.count()
    if done["released"]:
        jobs, quarantine, _ = apply_batch(jobs, quarantine, tombstones, Batch("", stamp, released))
    return jobs, quarantine, done


def title_key(title: Column) -> Column:
    """The title's words as a set, in order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(fold(title)))), " ")
