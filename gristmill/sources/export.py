"""Exports: the fixed projection as CSV, JSON or Markdown, each in files that a manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import collapse_whitespace, formula_guard, graphemes, markdown_cell, sanitize

# Columns of an export, in order.
COLUMNS = ("company", "title", "location", "term", "role", "language", "degree", "work_authorization", "source", "status", "first_seen", "url", "id")
PDF_COLUMNS, PDF_CELL = ("company", "title", "location", "term", "url"), 300
MARK = "\ufeff"


def projection(jobs: DataFrame) -> DataFrame:
    """The thirteen columns of an export: flags as yes or no, dates in UTC."""
    return jobs.select(
        "company", F.col("title_raw").alias("title"), F.col("location_raw").alias("location"), "term", "role", "language", F.col("degree_requirement").alias("degree"),
        F.when(F.col("work_auth_flag"), "yes").otherwise("no").alias("work_authorization"), "source", "status",
        F.date_format(F.to_utc_timestamp("first_seen", F.current_timezone()), "yyyy-MM-dd").alias("first_seen"), F.col("apply_url_raw").alias("url"), "id",
    )


def pdf_projection(jobs: DataFrame) -> DataFrame:
    """The columns that a printed list shows, each cell of at most PDF_CELL characters; laying it out is not done here."""
    return projection(jobs).select(*[F.array_join(F.slice(graphemes(collapse_whitespace(F.coalesce(F.col(c), F.lit("")))), 1, PDF_CELL), "").alias(c) for c in PDF_COLUMNS])


def csv_cell(c: Column) -> Column:
    return formula_guard(collapse_whitespace(F.coalesce(c.cast("string"), F.lit(""))))


def csv_rows(df: DataFrame) -> DataFrame:
    """``df`` with every column a safe cell."""
    return df.select(*[csv_cell(F.col(c)).alias(c) for c in df.columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """(at, value): the rows of a CSV file, the byte order mark before its head; quoted where they must be."""
    quoted = lambda c: F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    body = csv_rows(df).select(F.lit(1).alias("at"), F.concat_ws(",", *[quoted(F.col(c)) for c in df.columns]).alias("value"))
    return _headed(df.sparkSession, [MARK + ",".join(df.columns)], body)


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects without control characters, times in UTC."""
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    plain = [sanitize(F.col(c)).alias(c) if t == "string" else utc(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]
    return df.select(*plain).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_lines(df: DataFrame, title: str = "Postings") -> DataFrame:
    """(at, value): title, number of rows, the table's head, its rows."""
    n = df.count()
    head = [f"# {title}", "", f"{n} posting{'' if n == 1 else 's'}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return _headed(df.sparkSession, head, markdown_rows(df).select(F.lit(1).alias("at"), "value"))


def _headed(spark: SparkSession, head: list[str], body: DataFrame) -> DataFrame:
    top = spark.createDataFrame([("\n".join(head),)], "value string").select(F.lit(0).alias("at"), "value")
    return top.unionByName(body)


MANIFEST = "_manifest.json"


def _places(spark: SparkSession, path: str):
    """(Hadoop's paths, the file system of ``path``)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What an export holds: format, rows, and its files under ``path``; none if no export was ever finished there."""
    make, fs = _places(spark, path)
    at = make(f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a finished export, as they were when the manifest was read."""
    held = manifest(spark, path)
    if held is None:
        raise FileNotFoundError(f"no finished export at {path}")
    return spark.read.option("lineSep", held["line_end"]).text([f"{path}/{f}" for f in held["files"]])


def write(df: DataFrame, path: str, fmt: str = "csv", force: bool = False) -> None:
    """``df`` as text files of one format under ``path``, which a manifest names.

    The files are written to a folder of their own, whose tasks commit as Spark's writers do. Only then is the
    manifest, whole, put in the place of the old one, in one step of the file system; until then readers have
    the old export, from then on the new one, wherever a writer breaks off. What no manifest names goes at the
    next write. An export that is there is replaced only by ``force``.
    """
    spark = df.sparkSession
    if not force and manifest(spark, path) is not None:
        raise FileExistsError(f"{path} is there; force replaces it")
    made = {"csv": csv_lines, "json": json_rows, "md": markdown_lines}[fmt](df)
    parts, line_end = f"parts-{uuid.uuid4().hex}", "\r\n" if fmt == "csv" else "\n"
    order = ["at"] if "at" in made.columns else []
    rows = made.repartitionByRange(*order).sortWithinPartitions(*order).select("value") if order else made
    rows.write.option("lineSep", line_end).text(f"{path}/{parts}")
    make, fs = _places(spark, path)
    files = sorted(f"{parts}/{x.getPath().getName()}" for x in fs.listStatus(make(f"{path}/{parts}")) if x.getPath().getName().startswith("part-"))
    _switch(spark, path, parts, {"format": fmt, "line_end": line_end, "files": files}, force)
    _sweep(spark, path, parts)


def _switch(spark: SparkSession, path: str, parts: str, held: dict, force: bool) -> None:
    """Puts the manifest in its place; without ``force`` only if none came there meanwhile."""
    make, fs = _places(spark, path)
    new = make(f"{path}/{parts}/{MANIFEST}")
    stream = fs.create(new, False)
    try:
        stream.write(json.dumps(held).encode())
    finally:
        stream.close()
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if force else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, make(f"{path}/{MANIFEST}"), how)


def _sweep(spark: SparkSession, path: str, parts: str) -> None:
    make, fs = _places(spark, path)
    for x in fs.listStatus(make(path)):
        name = x.getPath().getName()
        if name.startswith("parts-") and name != parts:
            fs.delete(x.getPath(), True)


def log_requests(requests: DataFrame, path: str) -> None:
    """Appends requests, and payloads that could not be read, as JSON lines, a folder a day."""
    requests.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


def drop_old_logs(spark: SparkSession, path: str, keep_days: int, now: Column) -> DataFrame:
    """The logged lines that are kept when older days go."""
    return spark.read.json(path).filter(F.col("day") >= F.date_sub(F.to_date(now), keep_days))
