"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in these operators.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes that a frame may have to be sent to every executor. A row of the frames that are counted by rows
#: alone is a few numbers.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set a temporary one serves a
    local master, as in tests; on a cluster, whose executors could not see it, that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Text that goes to a Python worker at once, at most (one row may be larger). Both sides hold a batch several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on an Arrow batch to ``BATCH_BYTES``, for the plans that run from now on; a
    lower bound stays. Whole texts are long, so the default bound would be held by every task."""
    now = spark.conf.get(_BATCH).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # a larger unit (64m) is above the bound
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def sized(df: DataFrame, rows: int, texts: int = 0) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, and the bytes of its texts, are within the bounds, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and texts <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and, as ``weight``, its number of rows.

    Keys that hold more than a 50,000th of all ``total`` rows, so fewer than 50,000 of them, are sent to
    the rows; only rows of other keys are shuffled. ``rows`` is read twice, so it should be cut.
    """
    hot = F.col(weight) > max(10_000, total // 50_000)
    frequent = table.filter(hot).drop(weight)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    return rows.join(F.broadcast(frequent), key).unionByName(rest.join(table.filter(~hot).drop(weight), key))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op, zero: Column) -> Column:
    """For each of ``values`` what ``op`` makes of all before it, from ``zero``, and last what it makes of all.

    Blocks of values are folded apart and then joined, so that the time grows with the number of values
    and not, as with one array that is copied at each step, with its square.
    """
    kind = "array<bigint>"
    start = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast(kind).alias("out"))
    step = lambda acc, x: F.struct(op(acc["at"], x).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).cast(kind).alias("out"))

    def joined(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, zero.cast("long"), lambda a, x: op(a, x).cast("long")))
        begins = F.aggregate(totals, start(zero), step, lambda acc: F.struct(acc["at"].alias("at"), acc["out"].alias("out")))
        inner = lambda b: F.flatten(F.zip_with(parts, b["out"], lambda p, at: F.aggregate(p, start(at), step, lambda acc: acc["out"])))
        return let(begins, lambda b: F.concat(inner(b), F.array(b["at"])))

    blocks = lambda v: F.transform(F.sequence(F.lit(1), F.size(v), F.lit(RUN)), lambda i: F.slice(v, i, RUN))
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(F.array(zero.cast("long"))))


#: Values of a block of ``running``.
RUN = 512


def cells_for(rows: int, partitions: int, largest: int = 100_000) -> int:
    """Rows of a cell of work: a few cells for each shuffle partition, never more than ``largest`` rows."""
    return max(32, min(largest, rows // max(1, 4 * partitions)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_held: dict = {}


def held(key, make):
    """``make()``, kept in this worker until another operator asks for its own: a worker that is used again holds
    the model and cache of one operator at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
