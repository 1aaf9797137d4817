"""What each of five filters does in every order, from parity sums.

A document's mask has a bit for each filter that it fails. Per part and label, the Walsh-Hadamard
transform of the masks' counts is summed: for each of the 32 sets s of filters the number of documents
that fail an even number of s less those that fail an odd number. Sums of whole numbers invert exactly
to the 32 counts by mask, and these give every order: a document goes at the first filter of the order
that it fails. Over all orders each of the k filters that a document fails is first equally often, so it
adds 120 / k to the Shapley number of each.

Nulls: a null text is empty, a null source is the part "". A null id has no smaller id and is none.
Repeated rows count each; rows of one id and text are no copies of each other. Repeated rows of
``labels`` hold a label if one of them does. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, join_counted, let

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Labels that the sums are made for: every document, those of good quality, toxic ones.
LABELS = ("all", "good", "toxic")


def _bit(failed: Column, letter: str) -> Column:
    return F.when(failed, 1 << FILTERS.index(letter)).otherwise(0)


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which a text fails by itself."""
    words = let(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("own")))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    by_words = let(words, lambda w: _bit(w["n"] < 50, "A") + _bit(100 * w["own"].cast("long") < 65 * w["n"].cast("long"), "B"))
    return by_words + _bit(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), "C") + _bit(text.rlike("[#$%&*|]"), "D")


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask): one row for each document. Texts are read once and compared by their SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("said"),
    ))
    first = rows.groupBy("said").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rows = join_counted(rows, cut(first), "said", "n", rows.count())
    return rows.select("doc_id", "part", (F.col("mask") + _bit(F.col("doc_id") > F.col("first"), "E")).alias("mask"))


def parity_sums(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed sums of each part and label; a label without documents has no row.

    Rows of one id, part and mask are counted first, so that an id held by many rows meets its labels once.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(told, "doc_id", "left")
    held = F.array_compact(F.array(F.lit(LABELS[0]), F.when(F.col("good"), LABELS[1]), F.when(F.col("toxic"), LABELS[2])))
    each = counted.select("part", "mask", "n", F.explode(held).alias("label"))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    return each.groupBy("part", "label").agg(*[F.sum(F.col("n") * sign(s)).alias(f"s{s}") for s in range(MASKS)]).select("part", "label", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """The counts by mask that have these parity sums."""
    at = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda acc, s: acc + F.get(sums, s) * (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)))
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: (at(m) / MASKS).cast("long"))


def _over(counts: Column, wanted) -> Column:
    """The sum of ``counts`` over the masks that are ``wanted``; 0 without counts."""
    masks_ = F.sequence(F.lit(0), F.lit(MASKS - 1))
    return F.coalesce(F.aggregate(F.filter(masks_, wanted), F.lit(0).cast("long"), lambda acc, m: acc + F.get(counts, m)), F.lit(0).cast("long"))


def evaluate(sums: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the parity sums."""
    by_part = sums.withColumn("counts", cells(F.col("sums"))).groupBy("part").agg(*[F.max(F.when(F.col("label") == x, F.col("counts"))).alias(x) for x in LABELS])
    orders = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    rows = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = reduce(lambda acc, c: acc.when(F.substr(F.col("filter_order"), F.col("step"), F.lit(1)) == c, 1 << FILTERS.index(c)), FILTERS[1:], F.when(F.substr(F.col("filter_order"), F.col("step"), F.lit(1)) == FILTERS[0], 1))
    before = reduce(lambda acc, c: acc + F.when(F.instr("filter_order", c) < F.col("step"), 1 << FILTERS.index(c)).otherwise(0), FILTERS, F.lit(0))
    rows = rows.withColumn("own", bit).withColumn("earlier", before)
    own, earlier, every = F.col("own"), F.col("earlier"), F.col(LABELS[0])
    removed = lambda m: (m.bitwiseAND(earlier) == 0) & (m.bitwiseAND(own) != 0)
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(1), F.lit(MASKS - 1)), lambda m: m.bitwiseAND(own) != 0), F.lit(0).cast("long"),
        lambda acc, m: acc + F.get(every, m) * (F.lit(120) / F.bit_count(m)).cast("long"),
    )
    return rows.select(
        "part", "filter_order", "step",
        _over(every, lambda m: m.bitwiseAND(earlier.bitwiseOR(own)) == 0).alias("kept"),
        _over(every, removed).alias("removed"),
        _over(every, lambda m: (m.bitwiseAND(earlier) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        F.get(every, own).alias("unique_fails"),
        _over(F.col("good"), removed).alias("good_lost"),
        _over(F.col("toxic"), removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return evaluate(cut(parity_sums(masks(docs), labels)))
