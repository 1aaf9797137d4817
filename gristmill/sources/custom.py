"""Boards that a register row describes: paths into JSON, embedded objects, feeds, sitemaps, HTML; and walks of pages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.classify import CANADIAN_CODES, US_CODES
from gristmill.functions.text import collapse_whitespace, strip_html, unescape

from .html import html_rows

#: Rows of a board at most; list entries that a ``[field=value]`` step looks at; segments of a sitemap's path.
MOST_ROWS, MOST_SCANNED, MOST_SEGMENTS = 5000, 500, 6
FIELDS = ("title", "id", "location", "url", "description", "department", "employment_type", "category")


def segments(path: str) -> list[str]:
    """Parts of a dotted path; dots within brackets part nothing."""
    return re.findall(r"(?:[^.\[\]]|\[[^\]]*\])+", path)


def _key(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def dig_variant(v: Column, path: str) -> Column:
    """The value at a path like ``a.0.b[kind=x].c``: a name of an object, a place in a list, the first of a list's
    first MOST_SCANNED entries whose field is the text; null if there is none."""
    for part in segments(path):
        name, _, predicate = part.partition("[")
        if name:
            here = F.try_variant_get(v, _key(name), "variant")
            v = F.coalesce(F.try_variant_get(v, f"$[{name}]", "variant"), here) if name.isdigit() else here
        if predicate:
            where, sep, wanted = predicate[:-1].partition("=")
            if not sep:
                return F.lit(None).cast("variant")
            v = F.get(F.filter(F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, MOST_SCANNED), _says(where.strip(), wanted.strip())), F.lit(0))
    return v


def _says(path: str, wanted: str):
    return lambda x: (F.schema_of_variant(dig_variant(x, path)) == "STRING") & (_text(dig_variant(x, path)) == wanted)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def dig(payload: Column, path: str) -> Column:
    """The value at a path of a JSON text, as text; '' if there is none."""
    return F.coalesce(_text(dig_variant(F.try_parse_json(payload), path)), F.lit(""))


def first_str(payload: Column, *paths: str) -> Column:
    """The first path's value that is a text with something in it."""
    v = F.try_parse_json(payload)
    said = [F.when(F.schema_of_variant(dig_variant(v, p)) == "STRING", F.nullif(F.trim(_text(dig_variant(v, p))), F.lit(""))) for p in paths]
    return F.coalesce(*said, F.lit(""))


def first_int(payload: Column, *paths: str) -> Column:
    """The first path's value that is a whole number; true and false are none."""
    v = F.try_parse_json(payload)
    return F.coalesce(*[F.when(F.schema_of_variant(dig_variant(v, p)) == "BIGINT", F.try_variant_get(dig_variant(v, p), "$", "bigint")) for p in paths])


def job_count(payload: Column, count_paths: list[str], jobs_paths: list[str]) -> Column:
    """How many postings a board says it has, else how many its first list holds; null without either."""
    v = F.try_parse_json(payload)
    listed = [F.size(F.try_variant_get(dig_variant(v, p), "$", "array<variant>")) for p in jobs_paths]
    sizes = [F.when(n >= 0, n.cast("bigint")) for n in listed]
    return F.coalesce(*([first_int(payload, *count_paths)] if count_paths else []), *sizes, F.lit(None).cast("bigint"))


def scalar(v: Column) -> Column:
    """A value as text: an object its simple values, ``, `` apart, a list its entries, `` / `` apart."""
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    simple = lambda x: F.when(~(kind(x).startswith("OBJECT") | kind(x).startswith("ARRAY") | kind(x).isin("VOID", "BOOLEAN")), _text(x))
    joined = lambda xs, sep: F.array_join(F.filter(xs, lambda t: t.isNotNull() & (t != "")), sep)
    flat = lambda x: F.when(kind(x).startswith("OBJECT"), joined(F.transform(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), simple), ", ")).otherwise(_text(x))
    return F.coalesce(F.when(kind(v).startswith("ARRAY"), joined(F.transform(F.try_variant_get(v, "$", "array<variant>"), flat), " / ")).otherwise(flat(v)), F.lit(""))


def embedded(text: Column, marker: str, most: int = 8 << 20) -> Column:
    """The JSON object that follows ``marker`` in a page, or that a ``JSON.parse("...")`` after it holds, as text; null
    if none follows whole."""

    @F.pandas_udf("string")
    def cut_out(pages: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(page: str | None) -> str | None:
            start = (page or "").find(marker)
            if start < 0:
                return None
            brace, wrapped = page.find("{", start + len(marker)), page.find('JSON.parse("', start + len(marker))
            try:
                if wrapped >= 0 and (brace < 0 or wrapped < brace):
                    inner, _ = decoder.raw_decode(page[: wrapped + 11 + most], wrapped + 11)
                    return json.dumps(json.loads(inner))
                return json.dumps(decoder.raw_decode(page[: brace + most], brace)[0]) if brace >= 0 else None
            except ValueError:
                return None

        return pages.map(one)

    return cut_out(text)


def rss_items(payloads: DataFrame, tag: str = "item", payload_col: str = "payload") -> DataFrame:
    """One row for each item, with ``m``: the first text of every tag in it."""
    item = F.explode(F.regexp_extract_all(payload_col, F.lit(rf"(?s)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>"), F.lit(1)))
    rest = [c for c in payloads.columns if c != payload_col]
    return payloads.select(*rest, item.alias("i")).withColumn("m", _tags(F.col("i"))).filter(F.size("m") > 0).drop("i")


def _tags(item: Column) -> Column:
    pattern = F.lit(r"(?s)<([A-Za-z][^\s>/]*)[^>]*>(?:<!\[CDATA\[(.*?)\]\]>|(.*?))</\1>")
    names, quoted, plain = (F.regexp_extract_all(item, pattern, F.lit(i)) for i in (1, 2, 3))
    bodies = F.zip_with(quoted, plain, lambda q, p: F.trim(F.when(q != "", q).otherwise(unescape(p))))
    pairs = F.filter(F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("n"), b.alias("b"))), lambda x: x["b"] != "")

    def firsts(ps):
        keys = F.transform(ps, lambda x: x["n"])
        return F.map_from_entries(F.filter(F.transform(ps, lambda x, i: F.when(F.array_position(keys, x["n"]) == i + 1, x)), lambda x: x.isNotNull()))

    return F.transform(F.array(pairs), firsts)[0]


def sitemap_rows(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """One row for each ``<url>``, with ``m``: loc, the last segment's id and slug about its last ``_``, a title made of
    the slug, and path1, path2, ... from the end, each also as a title whose last word, if it is a state's or
    province's code, is in capitals."""
    entry = F.explode(F.regexp_extract_all(payload_col, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)))
    rest = [c for c in payloads.columns if c != payload_col]
    loc = F.trim(unescape(F.regexp_replace(F.regexp_extract("e", r"(?s)<(?:\w+:)?loc[^>]*>(.*?)</(?:\w+:)?loc>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")))
    rows = payloads.select(*rest, entry.alias("e")).withColumn("loc", loc).filter("loc <> ''").drop("e")
    tail = F.regexp_extract(F.regexp_replace("loc", "/+$", ""), "([^/]*)$", 1)
    slug = F.coalesce(F.nullif(F.regexp_extract(tail, "^(.+)_[^_]*$", 1), F.lit("")), tail)
    ident = F.when(slug == tail, tail).otherwise(F.regexp_extract(tail, "([^_]*)$", 1))
    codes = F.array(*[F.lit(x) for x in (*US_CODES, *CANADIAN_CODES)])
    titled = lambda p: F.initcap(F.trim(F.regexp_replace(p, "[- ]+", " ")))
    coded = lambda p: F.transform(F.array(titled(p)), lambda t: F.when(F.array_contains(codes, F.upper(F.regexp_extract(t, r"(?:^| )(\S\S)$", 1))), F.concat(F.left(t, F.length(t) - 2), F.upper(F.right(t, F.lit(2))))).otherwise(t))[0]
    parts = F.reverse(F.filter(F.split(F.regexp_replace("loc", r"[?#].*$", ""), "/"), lambda x: x != ""))
    pairs = [F.lit("loc"), F.col("loc"), F.lit("id"), ident, F.lit("slug"), slug, F.lit("title"), titled(slug)]
    for i in range(MOST_SEGMENTS):
        part = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        pairs += [F.lit(f"path{i + 1}"), part, F.lit(f"path{i + 1}_title"), coded(part)]
    return rows.select(*rest, F.map_filter(F.create_map(*pairs), lambda k, v: v != "").alias("m"))


def jsonld_rows(payloads: DataFrame, payload_col: str = "payload", depth: int = 3) -> DataFrame:
    """One row for each JobPosting of a page's JSON-LD blocks, ``v``: single, in lists, under ``@graph``, also of one
    another, ``depth`` deep."""
    block = F.explode(F.regexp_extract_all(payload_col, F.lit(r"(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)))
    rest = [c for c in payloads.columns if c != payload_col]
    none = F.array().cast("array<variant>")

    def inner(x):
        graph = F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$['@graph']", "array<variant>"))
        listed = F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))
        return F.coalesce(graph, listed, none)

    every = level = F.array(F.try_parse_json("b"))
    for _ in range(depth):
        level = F.flatten(F.transform(level, inner))
        every = F.concat(every, level)
    posting = F.filter(every, lambda x: F.try_variant_get(x, "$['@type']", "string") == "JobPosting")
    return payloads.select(*rest, block.alias("b")).filter(F.try_parse_json("b").isNotNull()).select(*rest, F.explode(posting).alias("v"))


@dataclass(frozen=True)
class Board:
    """A configured board: its format, where its rows are, and which path or selector gives each field."""

    fmt: str = "json"
    fields: dict[str, str] = field(default_factory=dict)
    jobs_path: str = ""
    extract: str = ""
    row_selector: str = ""
    row_filter: str = ""
    item_tag: str = "item"
    url: str = ""
    url_template: str = ""


def parse_custom(payloads: DataFrame, board: Board, payload_col: str = "payload") -> DataFrame:
    """Rows of a configured board: native_id, title, url, location, description, employment_type and category, without
    rows that have no title. An id that is not there is the url, else the title; a url that is not there is made of
    the template, else the board's own."""
    rest = [c for c in payloads.columns if c != payload_col]
    mapped = {k: p for k, p in board.fields.items() if k in FIELDS and p}
    if board.fmt == "html":
        got = html_rows(payloads, board.row_selector, mapped, base=board.url, payload_col=payload_col).drop("at")
    elif board.fmt in ("rss", "sitemap"):
        rows = rss_items(payloads, board.item_tag, payload_col) if board.fmt == "rss" else sitemap_rows(payloads, payload_col)
        if board.row_filter:
            rows = rows.filter(F.try_element_at("m", F.lit("loc")).rlike(board.row_filter))
        got = rows.select(*rest, *[F.coalesce(F.try_element_at("m", F.lit(p)), F.lit("")).alias(k) for k, p in mapped.items()])
    else:
        if board.fmt == "jsonld":
            rows = jsonld_rows(payloads, payload_col)
        else:
            text = embedded(F.col(payload_col), board.extract) if board.extract else F.col(payload_col)
            found = F.try_variant_get(dig_variant(F.try_parse_json(text), board.jobs_path), "$", "array<variant>")
            rows = payloads.select(*rest, F.explode(found).alias("v"))
        got = rows.select(*rest, *[scalar(dig_variant(F.col("v"), p)).alias(k) for k, p in mapped.items()])
    full = got.withColumns({k: F.lit("") for k in FIELDS if k not in mapped})
    title = collapse_whitespace(strip_html(F.col("title")))
    named = full.withColumn("title", title).filter("title <> ''")
    ident = F.coalesce(F.nullif("id", F.lit("")), F.nullif("url", F.lit("")), "title")
    made = F.replace(F.lit(board.url_template), F.lit("{id}"), ident) if board.url_template else F.lit(board.url)
    return named.select(
        *rest, ident.alias("native_id"), "title", F.coalesce(F.nullif("url", F.lit("")), made).alias("url"), collapse_whitespace(strip_html(F.col("location"))).alias("location"),
        collapse_whitespace(strip_html(F.col("description"))).alias("description"), "employment_type", F.coalesce(F.nullif("category", F.lit("")), "department").alias("category"),
    )


def walk_pages(pages: DataFrame, page_size: int, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(kept pages, ends by board) of pages (board, page, marks: what names their rows, null if unchanged).

    A walk ends after a page that is shorter than ``page_size`` or brings the board to ``most_rows``, and
    before one that is unchanged, but the first, or that names only what was seen. ends: board, why
    (short, cap, unchanged, repeated, open) and authoritative, which only a walk that ended short is.
    Pages of one board are few, so what was seen before each is one list.
    """
    w = W.partitionBy("board").orderBy("page")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    seen = pages.withColumn("seen", F.array_distinct(F.flatten(F.collect_list(F.coalesce("marks", none)).over(before)))).withColumn("rows", F.sum(F.size(F.coalesce("marks", none))).over(w)).withColumn("turn", F.row_number().over(w))
    later = F.col("turn") > 1
    why = (
        F.when(F.col("marks").isNull(), "unchanged").when(later & (F.size("marks") > 0) & (F.size(F.array_except("marks", "seen")) == 0), "repeated")
        .when(F.size("marks") < page_size, "short").when(F.col("rows") > most_rows, "cap")
    )
    marked = seen.withColumn("why", why)
    end = marked.groupBy("board").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("turn", "why"))).alias("e"))
    met = marked.join(end, "board")
    last = F.when(F.col("e.why").isin("short", "cap"), F.col("turn") <= F.col("e.turn")).otherwise(F.col("turn") < F.col("e.turn"))
    kept = met.filter(F.col("e").isNull() | last).select(*pages.columns)
    return kept, end.select("board", F.coalesce("e.why", F.lit("open")).alias("why"), F.coalesce(F.col("e.why") == "short", F.lit(False)).alias("authoritative"))


def page_completeness(pages: DataFrame) -> DataFrame:
    """(board, rows, total, complete) of pages (board, page, total, rows): complete if the rows make up the total that
    the last page named and no page named another."""
    by = pages.groupBy("board").agg(F.sum("rows").alias("rows"), F.max_by("total", "page").alias("total"), F.count_distinct("total").alias("totals"))
    return by.select("board", "rows", "total", ((F.col("rows") >= F.col("total")) & (F.col("totals") <= 1)).alias("complete"))
