"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length
matters for a plan, so the plan is made from at most ``capacity`` counts: for the longest length in
hand, a single, a pair or a triple of available lengths that fills its gap exactly is used as often as
the counts allow; what is left is filled best-fit. The plan is a short table of patterns. Pieces find
their place by their rank within their length, counted in cells.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cells_for, cut, held, shuffle_partitions, sized, small_batches

CAPACITY = 2048
#: Words, and parts of words, kept with their ids in a worker; later ones are encoded each time they occur.
KEPT_WORDS = 200_000

#: Control characters that Python takes for white space and the tokenizer does not; and characters that
#: lower-case or compose by rules beyond one character.
_RARE = re.compile("[\x1c-\x1f]|[^\x00-\u02ff]")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The tokenizer's own parting of a text, for characters below U+0300.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_LETTERS = {i: c for i, c in enumerate(_byte_letters())}


class _Kept(dict):
    """Ids by word, made by ``encode`` when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model = t.model
    special = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or "(?!)")
    parts = _Kept(lambda x: array("I", [y.id for y in model.tokenize(x if x.isascii() and x.isalnum() else x.encode().decode("latin-1").translate(_LETTERS))]).tobytes())
    plain = _Kept(lambda w: parts[w] if w.isascii() and w.isalpha() else b"".join([parts[x] for x in _PARTS.findall(w)]))
    whole = _Kept(lambda w: array("I", t.encode(w, add_special_tokens=False).ids).tobytes())
    return t, special, plain, whole


def encode(text: str, path: str, by_word: bool = True) -> bytes:
    """The ids of ``text`` as unsigned 32-bit numbers, for a lower-casing word vocabulary.

    by_word: the tokenizer merges nothing across white space nor across the parts that its pattern
    finds, so a text's ids are those of its words in turn, and a frequent word is encoded once in a
    worker. Texts with rarer characters, or with one of the vocabulary's own added tokens, have their
    words left to the whole tokenizer.
    """
    t, special, plain, whole = held(("tokenizer", path), lambda: _load(path))
    if not by_word:
        return array("I", t.encode(text, add_special_tokens=False).ids).tobytes()
    if _RARE.search(text) or special.search(text):
        return b"".join([whole[w] for w in _SPACES.split(text) if w])
    return b"".join(map(plain.__getitem__, text.lower().split()))


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """(id, row_key, piece, start, length, ids_crc32): every document's ids, then ``end_id``, cut after each ``capacity`` ids."""
    end = int(end_id).to_bytes(4, "little")

    def cut_up(batches):
        for b in batches:
            out = []
            for i, k, text in zip(b["id"], b["row_key"], b["text"], strict=True):
                ids = (encode(text, tokenizer, by_word) if text else b"") + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    out.append((i, k, p, at // 4, len(one) // 4, zlib.crc32(one)))
            rows = pd.DataFrame(out, columns=["id", "row_key", "piece", "start", "length", "ids_crc32"])
            rows["id"] = rows["id"].astype("Int64")
            yield rows

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return slim.mapInPandas(cut_up, "id long, row_key long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, longest first) and how often each is used; every piece is used once.

    counts: pieces by length. Each use of a pattern empties at least one length or leaves the longest
    with less than before, so there are a few patterns for each length, however many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {n: pattern.count(n) for n in pattern}
        times = min(left[n] // k for n, k in need.items())
        out.append((pattern, times))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                order.pop(bisect.bisect_left(order, n))

    def has(first: int, *more: int) -> bool:
        all_ = (first, *more)
        return all(left.get(n, 0) >= all_.count(n) for n in more)

    def exact(first: int, gap: int) -> tuple[int, ...] | None:
        if has(first, gap):
            return (gap,)
        top = bisect.bisect_right(order, gap - 1)
        for a in reversed(order[:top]):
            if 2 * a < gap:
                break
            if has(first, a, gap - a):
                return (a, gap - a)
        for a in reversed(order[:top]):
            if 3 * a < gap:
                break
            for b in reversed(order[: bisect.bisect_right(order, min(a, gap - a - 1))]):
                if 2 * b < gap - a:
                    break
                if has(first, a, b, gap - a - b):
                    return (a, b, gap - a - b)
        return None

    while order:
        first = order[-1]
        pattern, gap = [first], capacity - first
        while gap and order[0] <= gap:
            rest = exact(first, gap) if len(pattern) == 1 else None
            if rest:
                pattern += rest
                break
            fits = next((n for n in reversed(order[: bisect.bisect_right(order, gap)]) if left[n] > pattern.count(n)), None)
            if fits is None:
                break
            pattern.append(fits)
            gap -= fits
        take(tuple(pattern))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int):
    """For each length: starts of its rank intervals, and for each interval the sequence it begins with, its
    pieces a sequence and their offsets."""
    by: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        at, offsets = 0, {}
        for n in pattern:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            by.setdefault(n, []).append((used.get(n, 0), sequence, len(where), where))
            used[n] = used.get(n, 0) + times * len(where)
        sequence += times
    return {n: ([x[0] for x in xs], [x[1:] for x in xs]) for n, xs in by.items()}


def pack(pieced: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieced`` with sequence_id and offset: sequences of at most ``capacity`` tokens, as few as the plan finds.

    The lengths' counts (at most ``capacity`` of them) and the plan are all that the driver handles. A
    piece's rank within its length comes from its rank in a cell of that length and the cells before;
    frequent lengths have many cells. An empty table gives none.
    """
    counts = {n: c for n, c in pieced.groupBy("length").count().collect()}
    total = sum(counts.values())
    target = cells_for(total, shuffle_partitions(pieced.sparkSession))
    cells = {n: max(1, -(-c // target)) for n, c in counts.items()}
    places = pieced.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity), capacity))
    split = F.lit(1)
    many = {n: c for n, c in cells.items() if c > 1}
    if many:
        table = F.create_map(*[F.lit(x).cast("long") for pair in many.items() for x in pair])
        split = F.coalesce(F.try_element_at(table, F.col("length")), F.lit(1))
    celled = pieced.withColumn("cell", F.pmod(F.xxhash64("row_key", "piece", "id", F.lit(7)), split))
    sums = cut(celled.groupBy("length", "cell").agg(F.count("*").alias("n")))
    starts = sums.select("length", "cell", (F.sum("n").over(W.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = celled.withColumn("in_cell", F.row_number().over(W.partitionBy("length", "cell").orderBy("row_key", "id", "piece")) - 1)
    ranked = ranked.join(sized(starts, sum(cells.values())), ["length", "cell"]).withColumn("rank", F.col("before") + F.col("in_cell")).drop("cell", "before", "in_cell")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset, table = np.empty(len(rank), dtype="int64"), np.empty(len(rank), dtype="int64"), places.value
        for i, (n, r) in enumerate(zip(length, rank, strict=True)):
            begins, what = table[n]
            k = bisect.bisect_right(begins, r) - 1
            first, each, where = what[k]
            q, m = divmod(r - begins[k], each)
            sequence[i], offset[i] = first + q, where[m]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("at", place("length", "rank")).select("*", "at.*").drop("at", "rank")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each. Texts are tokenized once;
    the pieces (a few numbers each) are kept in the shared folder while they are counted and placed.
    """
    made = cut(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col))
    return pack(made, capacity=capacity).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

