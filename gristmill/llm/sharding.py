"""Sharding by histogram sort: splitters from exact byte counts below candidate boundaries, then one exchange.

Rows are ordered by (hash of the text, hash of the id), both unsigned. Each round sums the bytes of
every row by the next 12 bits of the key, only within the intervals that still hold an unsettled
splitter, so the driver sees at most shards x 4096 sums a round. A splitter settles at the boundary
nearest to its share once that is within the tolerance. Equal texts stay in one shard, but a group of
copies that is itself too large for a shard to stay even (above ``split_above`` of a shard's share: the law
of equal bytes comes before that of groups) is split by the ids' hash. Rows of one id and text are parted by
a row number, the key's last digits, so that they never weigh a shard down together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cells_for, cut, shuffle_partitions, sized

BITS = 12
_TOP = 1 << 64


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _unsigned(c: str) -> Column:
    """Signed order of the result is unsigned order of ``c``."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - _TOP if x >= _TOP >> 1 else x


def splitters(keyed: DataFrame, shards: int, tolerance: float, split_above: float) -> tuple[list[tuple[int, int]], int, int]:
    """Boundaries (k1, k2) in ascending unsigned order, the rows and the bytes of ``keyed`` (k1, k2, size).

    A row belongs to the shard whose number is the count of boundaries at or below its key.
    tolerance: of a shard's share, within which a boundary settles. split_above: of a shard's share,
    the bytes above which a group of one k1 may be cut.
    """
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = total / shards
    settled: dict[int, tuple[int, int]] = {}
    # An open interval: digits so far (as one number and its bits), bytes below it, the splitters in it.
    open_ = [(0, 0, 0, list(range(1, shards)))]
    while open_ and total:
        bits = open_[0][1]
        at = {p: (below, wanted) for p, _, below, wanted in open_}
        width = min(BITS, (64 if bits < 64 else 128) - bits)
        column, used = ("k1", bits) if bits < 64 else ("k2", bits - 64)
        digit = F.shiftrightunsigned(column, 64 - used - width).bitwiseAND((1 << width) - 1).alias("digit")
        if bits == 0:
            inside, first, second = keyed, F.lit(0).cast("long"), F.lit(0).cast("long")
        else:
            first = F.shiftrightunsigned("k1", 64 - min(bits, 64)) if bits < 64 else F.col("k1")
            second = F.shiftrightunsigned("k2", 64 - used) if bits > 64 else F.lit(0).cast("long")
            kept = [(_signed(p if bits <= 64 else p >> used), _signed(p & ((1 << used) - 1)) if bits > 64 else 0) for p in at]
            inside = keyed.filter(F.struct(first.alias("a"), second.alias("b")).isin([F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in kept]))
        sums: dict[int, dict[int, int]] = {}
        for a, b, d, s in inside.groupBy(first.alias("a"), second.alias("b"), digit).agg(F.sum("size").alias("bytes")).collect():
            whole = 0 if bits == 0 else (a % _TOP if bits <= 64 else ((a % _TOP) << used) | (b % _TOP))
            sums.setdefault(whole, {})[d] = s
        opened = []
        for p, (below, wanted) in at.items():
            again: dict[int, tuple[int, list[int]]] = {}
            edges, low = [], below
            for d in sorted(sums.get(p, {})):
                edges.append((low, d, sums[p][d]))
                low += sums[p][d]
            for j in wanted:
                goal = j * share
                if not edges:
                    settled[j] = _edge(p, bits)
                    continue
                start, d, inner = next((e for e in reversed(edges) if e[0] <= goal), edges[0])
                near = d if goal - start <= start + inner - goal else d + 1
                off = min(abs(goal - start), abs(start + inner - goal))
                whole_group = bits + width >= 64
                if off <= tolerance * share or bits + width == 128 or (whole_group and inner <= split_above * share):
                    settled[j] = _edge((p << width) + near, bits + width)
                else:
                    again.setdefault(d, (start, []))[1].append(j)
            opened += [((p << width) | d, bits + width, start, js) for d, (start, js) in again.items()]
        open_ = opened
    return [settled[j] for j in sorted(settled)], rows, total


def _edge(prefix: int, bits: int) -> tuple[int, int]:
    """The least 128-bit key with these leading bits, as two unsigned numbers; past the end as the end."""
    key = min(prefix << (128 - bits), (1 << 128) - 1)
    return key >> 64, key & (_TOP - 1)


def shard_of(edges: list[tuple[int, int]]) -> Column:
    flip = lambda x: _signed(x ^ (_TOP >> 1))
    at_or_above = [((_unsigned("k1") > flip(a)) | ((_unsigned("k1") == flip(a)) & (_unsigned("k2") >= flip(b)))).cast("int") for a, b in edges]
    return sum(at_or_above, F.lit(0))


def assign_slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """``placed`` (shard, k1, k2, ...) with slot, gapless from 0 in each shard.

    Slots are counted in cells, many to a shard, so that no task holds a whole shard: a cell's rows
    follow those of the cells before it.
    """
    cells = max(1, -(-rows // (shards * cells_for(rows, shuffle_partitions(placed.sparkSession)))))
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("k2", "k1"), F.lit(cells)))
    counts = cut(celled.groupBy("shard", "cell").agg(F.count("*").alias("n")))
    starts = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    numbered = celled.withColumn("in_cell", F.row_number().over(W.partitionBy("shard", "cell").orderBy(_unsigned("k1"), _unsigned("k2"))) - 1)
    return numbered.join(sized(starts, shards * cells), ["shard", "cell"]).withColumn("slot", (F.col("start") + F.col("in_cell")).cast("long")).drop("cell", "start", "in_cell")


#: Last bits of a key that tell rows of one id and text apart.
_OWN = 24


def keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Hashes of the text and of the id; the latter's last bits are of the row's number in its table."""
    own = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << _OWN) - 1)
    return F.xxhash64(F.col(text_col)), F.xxhash64(F.col(id_col), F.lit(1)).bitwiseAND(~((1 << _OWN) - 1)).bitwiseOR(own)


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, split_above: float = 0.1) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1), sizes near equal; size is the UTF-8 bytes of the text and one.

    A shard's bytes differ from their share by at most the tolerance or half of a group of equal texts
    at each end; a group above ``split_above`` of a share is cut. Null and empty texts are two groups
    of rows of size 1. Repeated rows (equal id and text) are as many rows; a group of them is cut like one of
    equal texts. An empty table gives none. ``docs`` must give its rows in one order when it is read again, as
    files and cut tables do. The columns ``shard``, ``k1`` and ``k2`` are the operator's own; other columns pass through.
    """
    k1, k2 = keys(id_col, text_col)
    slim = cut(docs.select(k1.alias("k1"), k2.alias("k2"), text_size(F.col(text_col)).alias("size")))
    edges, _, _ = splitters(slim, shards, tolerance, split_above)
    return docs.withColumn("k1", k1).withColumn("k2", k2).withColumn("shard", shard_of(edges)).drop("k1", "k2")


def write_shards(docs: DataFrame, path: str, shards: int = 16, *, files_a_shard: int = 1, **how) -> None:
    """Writes ``docs`` as Parquet, one folder for each shard, with the rows exchanged once."""
    placed = shard_documents(docs, shards, **how)
    salt = F.pmod(F.xxhash64(how.get("id_col", "doc_id")), F.lit(files_a_shard))
    placed.repartition(shards * files_a_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 16, *, tolerance: float = 0.002, split_above: float = 0.1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every document, law ``bytes``.

    The texts are read once; only ids, sizes and hashes are kept and exchanged.
    """
    k1, k2 = keys("doc_id", "text")
    slim = cut(docs.select("doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), k1.alias("k1"), k2.alias("k2")))
    edges, rows, _ = splitters(slim, shards, tolerance, split_above)
    out = assign_slots(slim.withColumn("shard", shard_of(edges)), rows, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
