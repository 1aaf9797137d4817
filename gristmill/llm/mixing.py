"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 64-bit hash. Words are summed by source and by the hash's leading 12 bits; in each
source the running sum shows the one bucket in which its budget ends. Only rows of that bucket are
summed again by the next bits, and so on, until the threshold is one hash value. A row is in the mix
if its hash lies below its source's threshold: no rows are sorted, and a larger budget takes a
superset of what a smaller one takes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, sized

#: Bits of the hash that each level looks at, from the top; 64 in all.
LEVELS = (12, 12, 12, 28)


class Count(NamedTuple):
    """Sources, and the bytes of their names."""

    rows: int
    texts: int


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digit(level: int) -> Column:
    shift = 64 - sum(LEVELS[: level + 1])
    return F.shiftrightunsigned("h", shift).bitwiseAND((1 << LEVELS[level]) - 1)


def targets(sizes: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all words by repeating weights
    in code point order of the sources (null last), none above ``cap`` times its size.

    What the capped sources leave goes to the others by weight; this settles where every source gets
    the lesser of its cap and one common level times its weight, so the level is found from the
    sources in order of cap / weight. The frame has one row for each source, not for each document.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    by = W.orderBy(F.col("most") / F.col("w"), "place")
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    leveled = placed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))
    common = F.max(fits).over(everything)
    return leveled.select("source", "source_size", F.least("most", F.coalesce(common * F.col("w"), F.col("most"))).alias("target"))


def thresholds(slim: DataFrame, plan: DataFrame, n_sources: Count) -> DataFrame:
    """(source, source_size, target, copies, cut): rows of a source are taken ``copies`` times, and once more if
    their hash is below ``cut`` (unsigned; all bits flipped at the sign so that signed order serves)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("copies", whole.cast("long")).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    for level, bits in enumerate(LEVELS):
        shift = 64 - sum(LEVELS[:level])
        last = level == len(LEVELS) - 1
        known = state.select(F.col("source").alias("s"), "need", "prefix")
        inside = F.lit(True) if level == 0 else F.shiftrightunsigned("h", shift) == F.col("prefix")
        hist = (
            slim.join(sized(known, *n_sources), F.col("source").eqNullSafe(F.col("s")) & inside)
            .groupBy("s", "need", "prefix", _digit(level).alias("digit"))
            .agg(F.sum("size").alias("words"))
        )
        upto = F.sum("words").over(W.partitionBy("s").orderBy("digit"))
        run = hist.withColumn("upto", upto).withColumn("left", F.col("need") - (F.col("upto") - F.col("words")))
        ends = run.filter("upto > need").groupBy("s").agg(F.min_by(F.struct("digit", "left", "words", "prefix"), "digit").alias("e"))
        # The last level holds one hash value: it goes in if that comes nearer to the budget.
        step = F.when((F.col("e.words") - F.col("e.left") < F.col("e.left")), 1).otherwise(0) if last else F.lit(0)
        ends = ends.select("s", F.shiftleft("e.prefix", bits).bitwiseOR(F.col("e.digit")).alias("p"), F.col("e.left").alias("l"), step.cast("long").alias("step"))
        state = state.drop("step").join(sized(ends, *n_sources), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "copies", F.col("l").alias("need"), F.col("p").alias("prefix"), F.coalesce("step", F.lit(0)).alias("step"))
    flipped = F.col("prefix").bitwiseXOR(F.lit(-(1 << 63)))
    top = F.col("prefix") == -1  # the greatest hash: adding one would wrap
    return state.select("source", "source_size", "target", "copies", (flipped + F.when(top, 0).otherwise(F.col("step"))).alias("cut"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    The size of a row is its number of words between ASCII white space (null text: 0). The budget and
    the caps are those of ``targets``. The choice depends on id and text alone, so reruns agree and
    the order of rows is of no matter. Rows with equal id and text are taken or left together. Null
    sources are one source, the last. An empty table gives no rows. Column names beginning with
    ``mix_`` are the operator's own; other columns pass through.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    own = docs.select("*", n_words(F.col(text_col)).alias("mix_size"), h.alias("mix_h"))
    slim = cut(own.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size"), F.col("mix_h").alias("h")))
    cuts, n = mix_plan(slim, weights, share, cap)
    return _taken(own, cuts, n, source_col).drop("mix_h")


def mix_plan(slim: DataFrame, weights, share: float, cap: float) -> tuple[DataFrame, Count]:
    sizes = cut(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = Count(*sizes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first())
    plan = cut(targets(sizes, weights=weights, share=share, cap=cap))
    return cut(thresholds(slim, plan, n)), n


def _taken(rows: DataFrame, cuts: DataFrame, n_sources: Count, source_col: str) -> DataFrame:
    side = cuts.select(F.col("source").alias("mix_s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_whole"), F.col("cut").alias("mix_cut"))
    more = F.when(F.col("mix_h").bitwiseXOR(F.lit(-(1 << 63))) < F.col("mix_cut"), 1).otherwise(0)
    return rows.join(sized(side, *n_sources), F.col(source_col).eqNullSafe(F.col("mix_s")), "left").withColumn("mix_copies", F.col("mix_whole") + more).drop("mix_s", "mix_whole", "mix_cut")


def mix_report(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document; the texts are read once."""
    slim = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("mix_size"), F.xxhash64("doc_id", "text").alias("mix_h")))
    cuts, n = mix_plan(slim.select("source", F.col("mix_size").alias("size"), F.col("mix_h").alias("h")), weights, share, cap)
    out = _taken(slim, cuts, n, "source")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
