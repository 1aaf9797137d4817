"""Ranked full-text search: weighted columns, terms as prefixes, BM25."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import fold, tokens
from gristmill.session import cut

K1, B = 1.2, 0.75
# Weights of a posting's columns.
WEIGHTS = {"company": 5.0, "title_raw": 10.0, "title_normalized": 8.0, "title_canonical": 8.0, "location_raw": 2.0, "description": 1.0}
#: Terms of a query and characters of a term that count.
MOST_TERMS, MOST_CHARS = 32, 48


def query_terms(spark, query: str) -> list[str]:
    """Folded terms of a query, at most MOST_TERMS of at most MOST_CHARS characters each, every one once."""
    said = spark.range(1).select(tokens(fold(F.lit(query))).alias("t")).first()["t"]
    return list(dict.fromkeys(t[:MOST_CHARS] for t in said[:MOST_TERMS]))


def frequencies(docs: DataFrame, terms: list[str], weights: dict[str, float], keep: list[str]) -> DataFrame:
    """``docs``'s ``keep`` columns with words, and f0, f1, ...: the weighted count of words that begin with each term.

    Every text is folded once and searched where it is: no word is shuffled.
    """
    texts = [tokens(fold(F.coalesce(F.col(c), F.lit("")))).alias(f"t{i}") for i, c in enumerate(weights)]
    held = docs.select(*keep, *texts)
    words = reduce(add, [F.size(f"t{i}") for i in range(len(weights))])

    def count(term: str) -> Column:
        hits = [F.size(F.filter(f"t{i}", lambda t: t.startswith(term))) * F.lit(float(w)) for i, w in enumerate(weights.values())]
        return reduce(add, hits)

    return held.select(*keep, words.cast("long").alias("words"), *[count(t).alias(f"f{i}") for i, t in enumerate(terms)])


def score_part(documents: int, found: int, f: Column, words: Column, mean: float) -> Column:
    """What one term adds to a row's rank, by its weighted count ``f`` and how many of all ``documents`` have it."""
    idf = F.greatest(F.lit(1e-6), F.log(F.lit((documents - found + 0.5) / (found + 0.5))))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * words / F.lit(mean)))


def bm25(docs: DataFrame, terms: list[str], weights: dict[str, float] | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` and score of the rows that have every term as the beginning of some word; a lower score is better.

    How many rows there are and have a term, and their mean length, are taken over all of ``docs``; the
    counts of one pass are kept in the shared folder, a few numbers for each row. No terms find nothing.
    """
    weights = WEIGHTS if weights is None else weights
    if not terms:
        return docs.select(*keep, F.lit(0.0).alias("score")).limit(0)
    counted = cut(frequencies(docs, terms, weights, list(keep)))
    every = counted.agg(F.count("*").alias("n"), F.avg("words").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()
    has_all = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(terms))])
    mean = every["mean"] or 1.0
    part = lambda i: score_part(every["n"], every[f"n{i}"], F.col(f"f{i}"), F.col("words"), mean)
    return counted.filter(has_all).select(*keep, (-reduce(add, map(part, range(len(terms))))).alias("score"))


def search(jobs: DataFrame, query: str, predicates: Column | None = None, limit: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """The best postings for a query that pass ``predicates``: by score, then the newest, then by id. Scores look at
    all postings, whatever the predicates leave."""
    terms = query_terms(jobs.sparkSession, query)
    passes = F.lit(True) if predicates is None else predicates
    marked = jobs.withColumn("passes", passes)
    scored = bm25(marked, terms, weights, ("id", "first_seen", "passes"))
    return scored.filter("passes").orderBy("score", F.col("first_seen").desc(), "id").limit(limit).select("id", "first_seen", "score")
