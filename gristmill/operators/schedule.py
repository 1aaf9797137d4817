"""Scheduling and health as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.session import cut


def rotate(members: DataFrame, key: str, cursor: str, budget: int) -> DataFrame:
    """The ``budget`` members after ``cursor`` in key order, from the start again past the end; all if there is no
    budget. Members after the cursor come first, so the slice is a top-k, not a numbering of all members."""
    after = F.when(F.col(key) > F.lit(cursor), 0).otherwise(1) if cursor else F.lit(0)
    placed = members.withColumn("lap", after)
    return (placed.orderBy("lap", key).limit(budget) if budget > 0 else placed).drop("lap")


def volume_verdicts(history: DataFrame, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """(source, latest, baseline, samples, verdict) from (source, run, stored): the newest run that stored anything
    known against the median of those before. Fewer than ``least`` before: unproven."""
    newest = W.partitionBy("source").orderBy(F.col("run").desc())
    seen = history.filter("stored is not null").withColumn("rn", F.row_number().over(newest))
    out = seen.groupBy("source").agg(
        F.max(F.when(F.col("rn") == 1, F.col("stored"))).alias("latest"), F.median(F.when(F.col("rn") > 1, F.col("stored"))).alias("median"), (F.count("*") - 1).alias("samples")
    )
    base = F.when(F.col("samples") >= least, F.col("median")).otherwise(0.0)
    verdict = (
        F.when(F.col("samples") < least, "unproven").when(F.col("baseline") <= 0, "healthy").when(F.col("latest") == 0, "collapsed")
        .when(F.col("latest") < F.col("baseline") * ratio, "dropped").otherwise("healthy")
    )
    return out.withColumn("baseline", base).withColumn("verdict", verdict).select("source", "latest", "baseline", "samples", "verdict")


def nearest_rank(values: Column, fraction: float) -> Column:
    """Value at place round(fraction x (n - 1)), halves to even, of a sorted array."""
    return F.get(values, F.bround(F.lit(fraction) * (F.size(values) - 1), 0).cast("int"))


def nearest_rank_by(df: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles by key. Equal values are counted first; the values of all keys are dealt out by ranges,
    and a value's place is the count of its range before it and of the ranges before: no key's values are gathered
    or sorted in one task. Null values take no part."""
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")).repartitionByRange(key, value).withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy(key, "part").agg(F.sum("n").alias("m"))
    before = sums.select(key, "part", (F.sum("m").over(W.partitionBy(key).orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy(key)).alias("total"))
    inner = F.sum("n").over(W.partitionBy(key, "part").orderBy(value))
    placed = counts.withColumn("upto", inner).join(before, [key, "part"])
    end = F.col("before") + F.col("upto")
    picks = [F.max(F.when((end - F.col("n") <= F.bround(F.lit(f) * (F.col("total") - 1), 0)) & (F.bround(F.lit(f) * (F.col("total") - 1), 0) < end), F.col(value))).alias(name) for name, f in fractions.items()]
    return placed.groupBy(key).agg(*picks, F.max("total").alias("n"))


def page_budgets(members: DataFrame, pages: int, key: str = "key", demand: str = "demand", least: int = 0, top_up: int = 0) -> DataFrame:
    """``members`` with granted: ``least`` each, then, from the greatest demand on, ties by key, up to what each demands,
    then, by key, up to ``top_up`` each, as far as the pages go.

    What goes to one demand is found from sums by demand, so only members of the one demand at which the
    pages run out are numbered, and of the top-up those of the range of keys in which it ends.
    """
    rows = members.withColumn("wants", F.greatest(F.coalesce(F.col(demand), F.lit(0)) - least, F.lit(0)).cast("long"))
    by = rows.groupBy("wants").agg(F.count("*").alias("many")).withColumn("sum", F.col("wants") * F.col("many"))
    n = by.agg(F.sum("many")).first()[0] or 0
    room = max(0, pages - least * n)
    # One row for each different demand, which are no more than a board has pages.
    before = by.select("wants", (F.sum("sum").over(W.orderBy(F.col("wants").desc())) - F.col("sum")).alias("before"))
    met = rows.join(before, "wants")
    turn = F.row_number().over(W.partitionBy("wants").orderBy(key)) - 1
    tight = met.join(by.select("wants", "sum"), "wants").filter((F.col("before") < room) & (F.col("before") + F.col("sum") > room)).withColumn("got", F.greatest(F.lit(0), F.least("wants", F.lit(room) - F.col("before") - turn * F.col("wants")))).select(key, "got")
    given = met.join(tight, key, "left").withColumn("granted", F.lit(least) + F.coalesce("got", F.when(F.col("before") < room, F.col("wants")).otherwise(0)))
    out = given.select(*members.columns, "granted")
    if not top_up:
        return out
    out = cut(out)
    left = max(0, pages - (out.agg(F.sum("granted")).first()[0] or 0))
    lacks = cut(out.withColumn("lacks", F.greatest(F.lit(top_up) - F.col("granted"), F.lit(0))).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sums = lacks.groupBy("part").agg(F.sum("lacks").alias("m"))
    start = sums.select("part", (F.sum("m").over(W.orderBy("part")) - F.col("m")).alias("start"))  # one row a partition
    upto = F.sum("lacks").over(W.partitionBy("part").orderBy(key)) - F.col("lacks")
    more = F.greatest(F.lit(0), F.least("lacks", F.lit(left) - F.col("start") - F.col("upto")))
    return lacks.withColumn("upto", upto).join(F.broadcast(start), "part").withColumn("granted", F.col("granted") + more).select(*members.columns, "granted")


def coverage_state(routable: Column, postings: Column, attempted: Column, failures: Column, last_success: Column, now: Column, stale_days: int) -> Column:
    """producing, never-reached, failing, stale or empty, in that order; unroutable without an adapter."""
    return (
        F.when(~routable, "unroutable").when(postings > 0, "producing").when(attempted.isNull(), "never-reached").when(failures > 0, "failing")
        .when(last_success < now - F.make_dt_interval(F.lit(stale_days)), "stale").otherwise("empty")
    )


def unregistered(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``names`` (name, toks) that match no registry entry (reg_toks) by token sets.

    One set lies within the other, so they share the rarer set's rarest token: sets are met by their own
    rarest token, over both sides, and by every token of the other, which keeps a common word from being
    a key of many.
    """
    from gristmill.functions.text import token_sets_match

    mine = cut(names.select("toks").filter(F.size("toks") > 0).distinct())
    theirs = cut(registry.select("reg_toks").filter(F.size("reg_toks") > 0).distinct())
    spread = mine.select(F.explode("toks").alias("tok")).union(theirs.select(F.explode("reg_toks"))).groupBy("tok").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, toks: str) -> DataFrame:
        by = df.select(toks, F.explode(toks).alias("tok")).join(spread, "tok").groupBy(toks)
        return by.agg(F.min_by("tok", F.struct("n", "tok")).alias("tok"))

    every = lambda df, toks: df.select(toks, F.explode(toks).alias("tok"))
    a = rarest(mine, "toks").join(every(theirs, "reg_toks"), "tok").select("toks", "reg_toks")
    b = every(mine, "toks").join(rarest(theirs, "reg_toks"), "tok").select("toks", "reg_toks")
    met = a.union(b).filter(token_sets_match(F.col("toks"), F.col("reg_toks"))).select("toks").distinct()
    return names.join(met, "toks", "left_anti")


def visit_runs(visits: DataFrame) -> DataFrame:
    """(board, last_attempt, last_success, failures) from visits (board, ts, failed): failures since the last success,
    by two aggregates and no sort of a board's visits."""
    ok = F.when(F.col("failed") == 0, F.col("ts"))
    last = visits.groupBy("board").agg(F.max("ts").alias("last_attempt"), F.max(ok).alias("last_success"))
    after = visits.filter("failed = 1").select("board", "ts").join(last.select("board", F.col("last_success").alias("was")), "board").filter("was is null or ts > was")
    return last.join(after.groupBy("board").agg(F.count("*").alias("failures")), "board", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
