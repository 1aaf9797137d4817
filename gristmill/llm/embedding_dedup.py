"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so a cosine is a distance. A table's key is the cells, ``WIDTH`` wide and
shifted, of several random projections. Vectors that share a key in any of the tables are candidates;
all that share a key are held against each other exactly, in double precision, block by block inside
tasks, and only counts and one link a vector and block leave a task: no pair is written out, a group
of copies is one vector with a weight, and a bucket of any size is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted
from .components import components

#: Width of a cell, in the unit of the projections (distance between unit vectors).
WIDTH = 1.2
#: Chance with which the tables must bring together two vectors at just the threshold.
RECALL = 0.995
LEAST_PROJECTIONS = 12
#: Bytes of a block's vectors, of which a task holds two, and vectors of a block at most. A vector is sent once for
#: each block of its bucket, so blocks are as large as memory allows and compared in strips.
BLOCK_BYTES, MOST_VECTORS, STRIP = 8 << 20, 8192, 512
SEED = 20_240_229


def same_cell(distance: float) -> float:
    """Chance that one projection puts vectors at this distance into one cell."""
    t = WIDTH / distance
    normal = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Projections a key and tables for ``n`` vectors: enough projections that unrelated vectors seldom meet, and
    enough tables that those at the threshold meet with chance RECALL."""
    k = max(LEAST_PROJECTIONS, math.ceil(math.log(max(n, 2)) / -math.log(same_cell(math.sqrt(2)))))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - same_cell(math.sqrt(2 - 2 * threshold)) ** k))


@lru_cache(maxsize=8)
def _projections(dim: int, k: int, tables: int):
    rng = np.random.default_rng([SEED, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(-(1 << 62), 1 << 62, k) | 1


def bucket_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """One key for each vector and table."""
    a, shift, mult = _projections(unit.shape[1], k, tables)
    cells = np.floor((unit @ a + shift) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        h = (cells * mult).sum(axis=2)
        return h ^ (h >> 29)


def _matrix(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(embedding: Column) -> Column:
    """True for vectors with at least one component, all of them finite and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _count_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks of one bucket: for each vector the weight of those linked first in this table,
    and the least vector of its part of the block. A vector is named by its least id and a hash of itself."""
    t = int(pdf["table"].iat[0])
    right_side = pdf["side"].to_numpy() == 1
    alone = not right_side.any()
    rep, vec, weight = pdf["rep"].to_numpy(), pdf["vec"].to_numpy(), pdf["weight"].to_numpy()
    left, right = np.flatnonzero(~right_side), np.flatnonzero(right_side if not alone else ~right_side)
    unit, keys = _matrix(pdf["embedding"]), np.stack(pdf["keys"])
    # Numbers in the order of the names; a block against itself has every name once.
    order = np.lexsort((vec, rep))
    first_of = np.ones(len(order), dtype=bool)
    first_of[1:] = (rep[order][1:] != rep[order][:-1]) | (vec[order][1:] != vec[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(first_of) - 1
    names_rep, names_vec = rep[order][first_of], vec[order][first_of]
    x, y, kx, ky, wl, wr = unit[left], unit[right], keys[left], keys[right], weight[left], weight[right]
    nl, nr, n = number[left], number[right], len(left)
    out_left, out_right = np.zeros(n, dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    low = np.arange(len(names_rep))
    for at in range(0, n, STRIP):
        some = slice(at, at + STRIP)
        near = x[some] @ y.T >= threshold
        near &= nl[some][:, None] != nr[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        low = _settled(low, nl[some][i], nr[j])
        # A pair counts in the first table that has it.
        if 8 * len(i) > near.size:
            for s in range(t):
                near &= kx[some, s][:, None] != ky[:, s][None, :]
            i, j = np.nonzero(near)
        else:
            first = (kx[some][i, :t] != ky[j, :t]).all(axis=1)
            i, j = i[first], j[first]
        out_left[some] += np.bincount(i, weights=wr[j], minlength=len(near)).astype(np.int64)
        if not alone:
            out_right += np.bincount(j, weights=wl[some][i], minlength=len(right)).astype(np.int64)
    links = np.zeros(len(names_rep), dtype=np.int64)
    np.add.at(links, nl, out_left)
    np.add.at(links, nr, out_right)
    told = np.flatnonzero((links > 0) | (low != np.arange(len(low))))
    return pd.DataFrame({"rep": names_rep[told], "vec": names_vec[told], "links": links[told], "low_rep": names_rep[low[told]], "low_vec": names_vec[low[told]]})


def _settled(low: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``low``, the least number known to hang together with each, after these pairs too; pointers are followed to
    their ends."""
    while True:
        a, b = low[one], low[other]
        apart = a != b
        if not apart.any():
            return low
        low = low.copy()
        np.minimum.at(low, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (low[low] != low).any():
            low = low[low]


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal labels link if their cosine is at least ``threshold``. Vectors that are null,
    empty or zero, or hold a null or non-finite component, and rows with a null label or id link with
    nothing: 0 links, themselves as component, kept. Copies link with each other. Vectors of different
    lengths never meet. Repeated ids are vectors of their own, whose links are counted apart; ids are whole numbers.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    whole = F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("embedding"))
    # Zeros of either sign are one number, so that equal vectors have equal hashes.
    base = base.withColumn("whole", whole).withColumn("embedding", F.when(whole, F.transform("embedding", lambda x: x + 0.0))).withColumn("vec", F.xxhash64("label", "embedding"))
    base = base.withColumn("class", F.when(F.col("whole"), F.struct("vec", F.xxhash64("embedding", "label", F.lit(1)).alias("vec2"))))  # 128 bits
    rows = cut(base.select("id", "class"))
    good = base.filter(F.col("class").isNotNull())
    classes = cut(good.groupBy("label", "class", "vec", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    n, total, dim = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    k, tables = tables_for(n, threshold)
    block = max(STRIP, min(MOST_VECTORS, BLOCK_BYTES // (8 * (dim + tables))))

    def hashed(batches):
        for b in batches:
            dims = b["embedding"].map(len)
            for d in dims.unique():
                some = b[dims == d]
                yield pd.DataFrame({"label": some["label"], "rep": some["rep"], "vec": some["vec"], "keys": list(bucket_keys(_matrix(some["embedding"]), k, tables))})

    label = f"label {classes.schema['label'].dataType.simpleString()}"
    keys = cut(classes.select("label", "rep", "vec", "embedding").mapInPandas(hashed, f"{label}, rep long, vec long, keys array<long>"))
    places = keys.select("label", "rep", "vec", F.posexplode("keys").alias("table", "key"))
    buckets = cut(places.groupBy("label", "table", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    # Only vectors that share a bucket are sent on, once for each block they are held against.
    shared = places.join(buckets, ["label", "table", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep", "vec"), blocks).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "label", "rep", "vec", "table", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    vectors_ = classes.select("label", "rep", "vec", "embedding", "weight").join(keys, ["label", "rep", "vec"])
    sent = dealt.join(vectors_, ["label", "rep", "vec"]).groupBy("label", "table", "key", "i", "j")
    counted = cut(sent.applyInPandas(lambda pdf: _count_block(pdf, threshold), "rep long, vec long, links long, low_rep long, low_vec long"))
    links = counted.groupBy("rep", "vec").agg(F.sum("links").alias("links"))
    ends = counted.select(F.struct("rep", "vec").alias("a"), F.struct(F.col("low_rep").alias("rep"), F.col("low_vec").alias("vec")).alias("b"))
    roots = components(ends.filter("a <> b").distinct()).select("node.rep", "node.vec", F.col("root.rep").alias("root"))
    known = classes.drop("embedding").join(links, ["rep", "vec"], "left").join(roots, ["rep", "vec"], "left")
    known = cut(known.select("class", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    linked = join_counted(rows.filter(F.col("class").isNotNull()), known, "class", "weight", total).select("id", "n_links", "component_id")
    alone = rows.filter(F.col("class").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
