"""A stored inverted index, kept commit by commit, and ranked search on it.

``postings`` has a row for each document and distinct token: the token's weighted count, the document's
words and the number of the segment. A segment is what one change adds, in folders by the token's first
character and ranged by token within them, so that the words that begin with a term are a range of a few
files. A document that changed is in a later segment too; ``replaced`` says from which segment on its
earlier rows do not count. ``lengths`` has a document's words and a mark of its texts, by which a change
finds the documents that differ. How many documents and words there are is kept with the commit.

A change's texts are read once, in blocks of documents whose words are counted where they are; what is
dealt out by ranges of tokens has a row for each token of a block, not one for each of its documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import spelled
from gristmill.operators.search import WEIGHTS, score_part
from gristmill.operators.store import Store
from gristmill.session import cut

#: Segments beyond which they are merged into one.
MOST_SEGMENTS = 8
POSTINGS, REPLACED, LENGTHS = "postings", "replaced", "lengths"
#: Sorts after every character of a token.
_AFTER = "{"
#: Bytes of the texts of a block of documents, at most (one document may be larger).
BLOCK_BYTES = 8 << 20
#: Documents of a row of a frequent token, at most: ranges hold even numbers of rows, so rows must not differ much.
RUN = 16
#: A token of a block with documents that have it, or no token: all documents of the block and their marks.
_BLOCK = "token string, ids array<string>, weights array<double>, words array<int>, marks array<bigint>"
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


@dataclass
class Delta:
    """What a change of documents adds to a commit."""

    append: dict = field(default_factory=dict)
    upsert: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


def _mark(columns) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in columns])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of spelled texts one after another, and the row of each."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < data.size]
    first[rows] = inside[rows]
    starts = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[inside]))
    return words, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), at)))


def _block(part: pa.RecordBatch, factors: np.ndarray):
    """``part``'s documents, then its tokens, as rows of ``_BLOCK``; column i of ``factors`` has texts ``t{i}``."""
    n, k, ids = part.num_rows, len(factors), part.column("id")
    found = [_words(part.column(f"t{i}")) for i in range(k)]
    tokens = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
    docs = np.concatenate([rows for _, rows in found])
    words = np.bincount(docs, minlength=n).astype(np.int32)
    key = (tokens.indices.to_numpy().astype(np.int64) * n + docs) * k + np.repeat(np.arange(k), [len(rows) for _, rows in found])
    key.sort()
    posting, column = np.divmod(key, k)
    first = np.flatnonzero(np.diff(posting, prepend=-1))
    weights = np.add.reduceat(factors[column], first) if first.size else np.empty(0)
    token, doc = np.divmod(posting[first], n)
    every, ends = np.array([0, n]), np.searchsorted(token, np.arange(len(tokens.dictionary) + 1))
    runs = -(-np.diff(ends) // RUN)
    of = np.repeat(np.arange(len(runs)), runs)
    ends = np.append(ends[of] + RUN * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)), first.size)
    listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    none = lambda m, kind: pa.nulls(m, pa.list_(kind))
    names = ["token", "ids", "weights", "words", "marks"]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), listed(every, ids), none(1, pa.float64()), listed(every, pa.array(words)), listed(every, part.column("mark"))], names)
    if first.size:
        yield pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(of)), listed(ends, ids.take(pa.array(doc))), listed(ends, pa.array(weights)), listed(ends, pa.array(words[doc])), none(len(ends) - 1, pa.int64())], names)


def _blocks(weights: list[float]):
    """Batches of id, mark and t0, t1, ... as rows of ``_BLOCK``."""
    factors = np.array(weights, dtype=np.float64)

    def run(batches):
        for batch in batches:
            size = sum(pc.binary_length(batch.column(f"t{i}")).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(factors)))
            ends = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_BYTES)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:], strict=False):
                if b > a:
                    yield from _block(batch.slice(a, b - a), factors)

    return run


class Index:
    """The index of one store, over the columns of ``weights`` of documents with a unique ``id``."""

    def __init__(self, store: Store, weights: dict[str, float] | None = None):
        self.store, self.weights = store, WEIGHTS if weights is None else weights

    def _facts(self, versions: dict) -> dict:
        have = versions.get("_meta", {})
        return {"segments": have.get("segments", 0), "documents": have.get("documents", 0), "words": have.get("words", 0), "oldest": have.get("oldest", 0)}

    def _segment(self, docs: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) of ``docs``; each text is folded and counted once."""
        texts = [spelled(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(self.weights)]
        rows = docs.select(F.col("id").cast("string").alias("id"), _mark(self.weights).alias("mark"), *texts)
        blocks = cut(rows.mapInArrow(_blocks([float(w) for w in self.weights.values()]), _BLOCK))
        lengths = blocks.filter("token is null").select(F.inline(F.arrays_zip("ids", "words", "marks")).alias("id", "words", "mark"))
        dealt = blocks.filter("token is not null").withColumn("head", F.substring("token", 1, 1)).repartitionByRange("head", "token", F.col("ids")[0])
        each = dealt.select("head", "token", F.inline(F.arrays_zip("ids", "weights", "words")).alias("id", "weight", "words"))
        return self._columns(each, number).sortWithinPartitions("head", "token", "id"), lengths.withColumn("words", F.col("words").cast("long"))

    @staticmethod
    def _columns(postings: DataFrame, number: int) -> DataFrame:
        return postings.select("token", "id", "weight", F.col("words").cast("long").alias("words"), F.lit(number).alias("segment"), F.substring("token", 1, 1).alias("head"))

    def _sorted(self, postings: DataFrame, number: int) -> DataFrame:
        return self._columns(postings, number).repartitionByRange("head", "token", "id").sortWithinPartitions("head", "token", "id")

    def delta(self, changed: DataFrame, gone: DataFrame | None = None, versions: dict | None = None) -> Delta:
        """What a commit needs so that the index holds ``changed`` documents as they are now, and none of ``gone`` (id).

        Documents whose texts are as they were cost a look at their marks alone.
        """
        now = self.store.versions() if versions is None else versions
        facts = self._facts(now)
        number = facts["segments"] + 1
        known = self.store.read(LENGTHS, now) if LENGTHS in now else None
        if known is not None:
            same = known.select("id", "mark")
            changed = changed.withColumn("mark", _mark(self.weights)).join(same, ["id", "mark"], "left_anti").drop("mark")
        new, lengths = self._segment(changed, number)
        lengths = cut(lengths)
        told = lengths.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        lost = (0, 0)
        out = Delta(append={POSTINGS: (new, "head")}, upsert={LENGTHS: (lengths, gone, "id")})
        if known is not None:
            ids = lengths.select("id") if gone is None else lengths.select("id").union(gone.select("id")).distinct()
            before = cut(known.join(ids, "id", "left_semi"))
            lost = before.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
            if lost[0]:
                out.append[REPLACED] = before.select("id", F.lit(number).alias("segment"))
        out.meta = {"segments": number, "documents": facts["documents"] + told[0] - lost[0], "words": facts["words"] + told[1] - lost[1], "oldest": facts["oldest"] or number}
        return out

    def live(self, versions: dict, only: set[str] | None = None, wanted: Column | None = None) -> DataFrame:
        """The postings that count, of tokens that begin with a character of ``only`` and are ``wanted``."""
        rows = self.store.read(POSTINGS, versions, only)
        if wanted is not None:
            rows = rows.filter(wanted)
        if not versions.get(REPLACED, {}).get("parts"):
            return rows
        dead = self.store.read(REPLACED, versions).groupBy("id").agg(F.max("segment").alias("from"))
        return rows.join(dead, "id", "left").filter(F.col("from").isNull() | (F.col("segment") >= F.col("from"))).drop("from")

    def compact(self) -> int:
        """All segments as one, in a commit of its own; readers of earlier commits keep theirs."""
        base = self.store.last()
        now = self.store.versions(base)
        facts = self._facts(now)
        rows = self._sorted(self.live(now), facts["segments"])
        merged = {POSTINGS: {"schema": now[POSTINGS]["schema"], "parts": []}, REPLACED: {"schema": now[POSTINGS]["schema"], "parts": []}}
        return self.store.commit(base, append={POSTINGS: (rows, "head")}, meta=facts | {"oldest": facts["segments"]}, emptied=merged)

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> int:
        """A commit of the index alone."""
        base = self.store.last()
        d = self.delta(changed, gone, self.store.versions(base) if base else {})
        number = self.store.commit(base, append=d.append, upsert=d.upsert, meta=d.meta)
        return self.compact() if self.crowded() else number

    def crowded(self) -> bool:
        facts = self._facts(self.store.versions())
        return facts["segments"] - facts["oldest"] >= MOST_SEGMENTS

    def scores(self, terms: list[str], versions: dict | None = None) -> DataFrame:
        """(id, score) of the documents that have every term as the beginning of some word; a lower score is better.

        Reads the ranges of the postings that begin with a term, and no text. No terms find nothing.
        """
        now = self.store.versions() if versions is None else versions
        spark = self.store.spark
        if not terms or POSTINGS not in now:
            return spark.createDataFrame([], "id string, score double")
        facts = self._facts(now)
        held = [(F.col("token") >= t) & (F.col("token") < t + _AFTER) for t in terms]
        rows = self.live(now, {t[:1] for t in terms}, reduce(or_, held))
        counted = cut(rows.groupBy("id").agg(F.max("words").alias("words"), *[F.coalesce(F.sum(F.when(h, F.col("weight"))), F.lit(0.0)).alias(f"f{i}") for i, h in enumerate(held)]))
        found = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()
        mean = facts["words"] / facts["documents"] if facts["documents"] and facts["words"] else 1.0
        has_all = reduce(lambda a, b: a & b, [F.col(f"f{i}") > 0 for i in range(len(terms))])
        score = -reduce(add, [score_part(facts["documents"], found[f"n{i}"], F.col(f"f{i}"), F.col("words"), mean) for i in range(len(terms))])
        return counted.filter(has_all).select("id", score.alias("score"))
