"""A Merkle manifest of a dataset, with a proof for every row.

Leaves are digests of rows, in order of id within a group; pairs of neighbours become their parents until
one node is left. The work is dealt in aligned blocks of 2^depth nodes: each block is traversed in
postorder, returning its digest and appending, while unwinding, the sibling of each subtree to the leaves
in it. The digests of the blocks are the nodes of the next traversal, dealt in blocks again, until every
group has one node, its subroot; the subroots are traversed in the same way, to the root. Then paths go
down again, block by block, so that no join meets a key with more than 2^depth rows.

A path is an array with an element a level: empty where a node has no sibling and is hashed alone, else
one byte, ``L`` or ``R`` for the side that the sibling stands on, and its 32 bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, sized

#: Levels of a block.
DEPTH = 8


def field(c: Column) -> Column:
    """A value of a row as it is hashed: ``-`` if null, else its UTF-8 bytes' count, ``:`` and itself."""
    said = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos, gapless from 0 within each ``group``, by ``order``, and size, the group's rows.

    Rows are dealt by ranges of (group, order), wherever a group's rows end; ties are parted by a row
    number, so that equal rows too are dealt to many tasks. Only a row for each range and group is counted.
    """
    spark = rows.sparkSession
    named = cut(rows).withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    dealt = cut(named.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()).drop("_tie"))
    runs = dealt.groupBy("_range", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("_group").orderBy("_range")
    runs = cut(runs.select("_range", "_group", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("_group")).alias("size")))
    joined = dealt.alias("d").join(sized(runs, runs.count()).alias("r"), (F.col("d._range") == F.col("r._range")) & (F.col(group) == F.col("_group")))
    return joined.select("d.*", (F.col("_at") + F.col("_shift")).alias("pos"), "size").drop("_at", "_range")


def _parent(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


def traverse(digests: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The digest of the tree of ``levels`` over ``digests`` and the path of each of them to it."""
    n, paths = len(digests), [[] for _ in digests]

    def below(at: int, level: int) -> bytes:
        if level == 0:
            return digests[at]
        half = 1 << level - 1
        left = below(at, level - 1)
        right = below(at + half, level - 1) if at + half < n else None
        for i in range(at, min(at + half, n)):
            paths[i].append(b"R" + right if right is not None else b"")
        for i in range(at + half, min(at + 2 * half, n)):
            paths[i].append(b"L" + left)
        return _parent(left, right)

    return below(0, levels), paths


def _climb(nodes: DataFrame, depth: int, finish) -> DataFrame:
    """``nodes`` (grp, pos, digest, size, ...) with path and tops, without size.

    ``finish`` gives path and tops of the last node of each group, from frames of (grp, pos, digest, size).
    """
    if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
        return finish(nodes).drop("size")

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        size = rows["size"][0].as_py()
        top, paths = traverse(rows["digest"].to_pylist(), min(depth, (size - 1).bit_length()))
        return rows.append_column("path", pa.array(paths, pa.list_(pa.binary()))).append_column("top", pa.array([top] * len(rows), pa.binary()))

    dealt = nodes.withColumn("block", F.shiftright("pos", depth))
    schema = dealt.select("*", F.lit(None).cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("top")).schema
    walked = cut(dealt.groupBy("grp", "block").applyInArrow(walk, schema))
    heads = walked.filter(F.col("pos") == F.shiftleft("block", depth))
    above = _climb(heads.select("grp", F.col("block").alias("pos"), F.col("top").alias("digest"), F.shiftright(F.col("size") + ((1 << depth) - 1), depth).alias("size")), depth, finish)
    above = cut(above.select(F.col("grp").alias("_grp"), F.col("pos").alias("block"), F.col("path").alias("_path"), "tops"))
    blocks, weight = above.agg(F.count("*"), F.sum(F.octet_length("_grp") + 50 * F.size("_path") + 150)).first()
    joined = walked.join(sized(above, blocks, weight or 0), (F.col("grp") == F.col("_grp")) & (walked["block"] == above["block"]))
    return joined.select(*[c for c in nodes.columns if c != "size"], F.concat("path", "_path").alias("path"), "tops")


def _end(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("path", F.array().cast("array<binary>")).withColumn("tops", F.array("digest"))


def trees(leaves: DataFrame, *order: str, depth: int = DEPTH) -> DataFrame:
    """``leaves`` (grp, digest, ...) with path, from the leaf to the root, subroot and root.

    The leaves of a group are in the order of ``order``, rows equal in it by their digests; the groups'
    subroots are in the order of grp (UTF-8 bytewise) and make one tree more.
    """

    def join_groups(last: DataFrame) -> DataFrame:
        named = positions(last.select(F.lit("").alias("all"), "grp", "digest"), "all", "grp")
        up = _climb(named.select(F.col("all").alias("grp"), "pos", "digest", "size", F.col("grp").alias("_name")), depth, _end)
        up = up.select(F.col("_name").alias("grp"), "path", F.concat(F.array("digest"), "tops").alias("tops"))
        return last.drop("digest").join(up.withColumn("digest", up["tops"][0]), "grp")

    placed = positions(leaves, "grp", *order, "digest")
    return _climb(placed, depth, join_groups).withColumns({"subroot": F.col("tops")[0], "root": F.col("tops")[1]}).drop("tops")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` (hex) has by ``path``."""

    def up(h: Column, step: Column) -> Column:
        beside = _hex(F.substring(step, 2, 32))
        return F.when(F.octet_length(step) == 0, F.sha2(h, 256)).when(F.substring(step, 1, 1) == F.lit(b"L"), F.sha2(F.concat(beside, h), 256)).otherwise(F.sha2(F.concat(h, beside), 256))

    return F.aggregate(path, leaf, up)


def siblings(path: Column) -> Column:
    """The siblings of ``path`` in hex, from the leaf to the root."""
    return F.transform(F.filter(path, lambda s: F.octet_length(s) > 0), lambda s: _hex(F.substring(s, 2, 32)))


def manifest(docs: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """For each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A row's leaf is the digest of doc_id, source, lang, n_chars and text. Where 7 divides the CRC-32 of its
    id, 1 is added to n_chars before the root is folded again, so that its proof must fail; a null n_chars
    stays, and so does the proof. A null lang is a group before all others; a null id comes first in its
    group and is not tampered with. Rows of one id are ordered by their digests; equal rows have a leaf
    each. Whole texts are hashed, empty and null ones differ. An empty table has no root and no rows.
    """
    own = lambda n: F.unhex(leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"), "doc_id",
        own(F.col("n_chars")).alias("digest"), F.when(tampered, own(F.col("n_chars") + 1)).alias("changed"),
    )
    made = trees(leaves, "doc_id", depth=depth).withColumn("folded_root", fold(_hex(F.coalesce("changed", "digest")), F.col("path")))
    return made.select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == _hex(F.col("root"))).alias("verified"),
    )
