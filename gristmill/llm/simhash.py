"""SimHash near-duplicates found through Golay-code fuzzy keys.

The 64 bits of a fingerprint are parted into segments of at most 23 bits. The perfect (23,12) Golay
code gives every 23-bit word one codeword within 3 bits, so a word and its 23 one-bit neighbours lie
by at most six codewords: two words that differ by one bit share one of them with the other's own. If
two fingerprints differ by 3 bits at most, some choice of segments has at most one error in each
(pigeonhole), so one side's own key meets one of the other side's few keys. Pairs that meet are
verified in the join by counting bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, shuffle_partitions, sized, small_batches
from .components import components

#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_POLY = 0b110001110101
#: Differing bits up to which fingerprints link.
BITS = 3
#: From so many distinct fingerprints on, keys of two fuzzy segments (24 bits) would meet too often by
#: chance, and longer keys with one exact segment are used. Both find every link.
NARROW_UP_TO = 20_000_000
#: Distinct fingerprints whose keys one task makes.
PRINTS_A_TASK = 50_000


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial, which are 0 for codewords."""
    w = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        w ^= np.where((w >> bit) & 1, _POLY << (bit - 11), 0)
    return w


def _error_table() -> np.ndarray:
    """For each of the 2048 remainders the one error of at most 3 bits that leaves it."""
    errors = [0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(23), n)]
    table = np.zeros(2048, dtype=np.int64)
    table[_syndrome(np.array(errors))] = errors
    return table


_ERRORS = _error_table()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12 leading bits, which name a codeword, of the codeword nearest to each 23-bit word."""
    w = words.astype(np.int64)
    return (w ^ _ERRORS[_syndrome(w)]) >> 11


def neighbours(words: np.ndarray) -> list[np.ndarray]:
    """For each word the codewords nearest to it or to any word one bit away, each once: at most six."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    all_ = np.sort(decode((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), 24), axis=1)
    first = np.ones_like(all_, dtype=bool)
    first[:, 1:] = all_[:, 1:] != all_[:, :-1]
    return [row[keep] for row, keep in zip(all_, first, strict=True)]


def _tables(narrow: bool):
    """(segments as (shift, bits), tables as (exact segments, fuzzy segments)).

    Narrow: three segments; at most 3 errors leave at most one of them with more than one. Wide: four
    segments; one is without error and at least two others have one at most.
    """
    if narrow:
        return [(41, 23), (18, 23), (0, 18)], [((), c) for c in combinations(range(3), 2)]
    return [(48, 16), (32, 16), (16, 16), (0, 16)], [((a,), c) for a in range(4) for c in combinations([x for x in range(4) if x != a], 2)]


def fuzzy_keys(prints: np.ndarray, narrow: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own keys (one for each table, by row) and the keys to look up (some for each table), from unsigned 64-bit prints."""
    segments, tables = _tables(narrow)
    words = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in segments]
    own, near = [decode(w) for w in words], [neighbours(w) for w in words]
    mine = np.empty((len(prints), len(tables)), dtype=np.int64)
    sought: list[list[np.ndarray]] = [[] for _ in prints]
    for t, (exact, fuzzy) in enumerate(tables):
        base = np.full(len(prints), t, dtype=np.int64)
        for e in exact:
            base = (base << 16) | words[e]
        key = base
        for f in fuzzy:
            key = (key << 12) | own[f]
        mine[:, t] = key
        for i in range(len(prints)):
            k = base[i : i + 1]
            for f in fuzzy:
                k = ((k[:, None] << 12) | near[f][i][None, :]).ravel()
            sought[i].append(k)
    return mine, [np.concatenate(x) for x in sought]


def print_of(text: str | None) -> int:
    """SimHash of 3-word shingles (A-Z lower-cased, words between ASCII white space, repeats counted; fewer words:
    all of them; none: 0): a bit is 1 if it is in more than half of the shingles' XXH64 hashes (seed 42)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - 2
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        to = min(n, at + (1 << 16))
        pairs = map(b" ".join, zip(words[at:to], words[at + 1 : to + 1], words[at + 2 : to + 2], strict=True))
        h = np.fromiter((xxh64_intdigest(s, 42) for s in pairs), dtype=">u8", count=to - at)
        ones += _count_bits(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _count_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def simhash(text: Column) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([print_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


def near_pairs(prints: DataFrame, n: int, narrow_up_to: int = NARROW_UP_TO) -> DataFrame:
    """Pairs (a, b) of distinct ``print`` values, a < b, that differ by at most BITS bits; a pair may be there twice.

    Each value has about a hundred keys, so the few values of a partition are dealt out before.
    """
    narrow = n <= narrow_up_to

    def keyed(batches):
        for b in batches:
            mine, sought = fuzzy_keys(b["print"].to_numpy().astype(np.int64).view(np.uint64), narrow)
            yield pd.DataFrame({"print": b["print"], "mine": list(mine), "sought": sought})

    dealt = prints.select("print").repartition(max(shuffle_partitions(prints.sparkSession), n // PRINTS_A_TASK), "print")
    keys = dealt.mapInPandas(keyed, "print long, mine array<long>, sought array<long>")
    left = keys.select(F.explode("mine").alias("key"), F.col("print").alias("a"))
    right = keys.select(F.explode("sought").alias("key"), F.col("print").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    met = left.join(right.hint("shuffle_merge"), (left["key"] == right["key"]) & close)
    return met.select("a", "b")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", narrow_up_to: int = NARROW_UP_TO) -> DataFrame:
    """(id_col, print, component_id) for every row of ``docs``; component_id is the least id that links reach.

    Rows of one fingerprint are one node, so copies are never paired. A null text is an empty one:
    both have fingerprint 0 and link like any other. Rows with a null id take part; a component of
    null ids alone has a null component_id. Repeated rows are kept; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    own = cut(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("print")))
    nodes = cut(own.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    linked = components(near_pairs(nodes, n, narrow_up_to).distinct())
    placed = nodes.join(linked, nodes["print"] == linked["node"], "left").select("print", "least", "rows", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(placed.join(least, "root").select("print", "component_id", "rows"))
    return join_counted(own, by_print, "print", "rows", total).select(F.col("id").alias(id_col), "print", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the least id; rows without an id stay. Rows that repeat
    one id are one document and share its fate. All columns pass through. The ids that go are counted: up to
    ``BROADCAST_ROWS`` of them are sent to the texts, more meet them by a shuffle."""
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col)
    gone = cut(groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    return docs.join(sized(gone, gone.count()), id_col, "left_anti").select(*docs.columns)


def simhash_report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint as 16 lower-case hex digits."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
