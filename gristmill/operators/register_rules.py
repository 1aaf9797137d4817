"""What an entry of the register must be like: rules as rows, and every error of every entry in one pass."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import urls

PLATFORMS = sorted({*(b["platform"] for b in urls.PATH_BOARDS), *(p for p, _, _ in urls.HOST_BOARDS), "workday", "oracle_cloud", "successfactors", "avature", "phenom", "custom_json"})
# Who an entry comes from, formats and methods of a configured board, and what its fields may map.
RECORDS = ("openjobs", "discover", "manual")
FORMATS = ("json", "rss", "html", "sitemap", "jsonld")
METHODS = ("GET", "POST")
FIELDS = ("title", "id", "location", "url", "description", "department", "employment_type", "category")


@dataclass(frozen=True)
class Rule:
    """field: a path in the entry. kind: a name in KINDS. values: what the kind compares with. within: a path that must
    be there for the rule to be asked, and maybe the value that it must have."""

    field: str
    kind: str
    values: tuple[str, ...] = ()
    within: tuple[str, ...] = ()


RULES = (
    Rule("name", "text"), Rule("platform", "text"), Rule("slug", "text"), Rule("platform", "one of", tuple(PLATFORMS)), Rule("source_of_record", "one of", RECORDS),
    Rule("enabled", "flag"), Rule("name_gate_exempt", "flag"), Rule("last_verified", "date"), Rule("recheck_after", "date"), Rule("paused_until", "date"),
    *[Rule(f, "text or none") for f in ("rate_profile", "workday_tenant", "workday_site", "workday_dc", "workday_facet", "oracle_host", "oracle_site", "oracle_keyword", "notes")],
    *[Rule(f, "only with platform", ("oracle_cloud",)) for f in ("oracle_host", "oracle_site", "oracle_keyword")],
    *[Rule(f, "needed", (), ("platform", "oracle_cloud")) for f in ("oracle_host", "oracle_site")], Rule("oracle_host", "oracle target", ("oracle_site",), ("platform", "oracle_cloud")),
    Rule("custom", "needed", (), ("platform", "custom_json")), Rule("custom", "only with platform", ("custom_json",)), Rule("custom", "mapping"),
    Rule("custom.url", "address", (), ("custom",)), Rule("custom.url", "needed", (), ("custom",)), Rule("custom.fields", "mapping", (), ("custom",)), Rule("custom.fields", "keys", FIELDS, ("custom",)),
    Rule("custom.fields.title", "text", (), ("custom",)), Rule("custom.fields", "texts", (), ("custom",)), Rule("custom.method", "one of, in capitals", METHODS, ("custom",)),
    Rule("custom.body", "mapping", (), ("custom",)), Rule("custom.headers", "mapping", (), ("custom",)), Rule("custom.headers", "texts", (), ("custom",)),
    Rule("custom.format", "one of, in small letters", FORMATS, ("custom",)), Rule("custom.row_selector", "needed", (), ("custom.format", "html")), Rule("custom.handshake_url", "address", (), ("custom",)),
    Rule("custom.token_pattern", "needed", (), ("custom.handshake_url",)), Rule("custom.token_header", "needed", (), ("custom.handshake_url",)), Rule("custom.token_pattern", "pattern", (), ("custom",)),
    Rule("custom.item_tag", "element", (), ("custom",)), Rule("custom.row_filter", "pattern", (), ("custom",)), Rule("custom.page_size", "positive", (), ("custom.page_param",)),
    *[Rule(f"custom.{f}", "whole number", (), ("custom",)) for f in ("page_size", "page_start", "page_step", "max_pages")], Rule("custom.authoritative", "flag", (), ("custom",)),
)


def _sound_patterns(patterns: pd.Series) -> pd.Series:
    def sound(p) -> bool:
        try:
            re.compile(p or "")
        except re.error:
            return False
        return True

    return patterns.map(sound).astype(bool)


def _compiles(pattern: Column) -> Column:
    return F.pandas_udf(_sound_patterns, "boolean")(pattern)


def _at(path: str) -> Column:
    return F.try_variant_get("entry", f"$.{path}", "variant")


def _kind(path: str) -> Column:
    """STRING, BIGINT, BOOLEAN, OBJECT<...>, ...; VOID where the entry says null, null where it says nothing."""
    return F.schema_of_variant(_at(path))


def _text(path: str) -> Column:
    """What is there as a text, empty if nothing is."""
    return F.coalesce(F.trim(F.try_variant_get("entry", f"$.{path}", "string")), F.lit(""))


def _said(path: str) -> Column:
    """True where the entry says something that is not null."""
    return F.coalesce(_kind(path) != "VOID", F.lit(False))


def _map(path: str) -> Column:
    return F.coalesce(F.try_variant_get("entry", f"$.{path}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


_INT = ("BIGINT", "INT", "SMALLINT", "TINYINT")
#: By kind: what is wrong, and when. The column is true for a wrong entry.
KINDS: dict[str, tuple[str, Callable[[Rule], Column]]] = {
    "text": ("must be a text that is not empty", lambda r: (F.coalesce(_kind(r.field), F.lit("")) != "STRING") | (_text(r.field) == "")),
    "text or none": ("must be a text", lambda r: _said(r.field) & (_kind(r.field) != "STRING")),
    "one of": ("must be one of {values}", lambda r: _kind(r.field).isNotNull() & ~_text(r.field).isin(*r.values)),
    "one of, in capitals": ("must be one of {values}", lambda r: (_text(r.field) != "") & ~F.upper(_text(r.field)).isin(*r.values)),
    "one of, in small letters": ("must be one of {values}", lambda r: (_text(r.field) != "") & ~F.lower(_text(r.field)).isin(*r.values)),
    "flag": ("must be true or false", lambda r: _kind(r.field).isNotNull() & (_kind(r.field) != "BOOLEAN")),
    "date": ("must be a date like 2026-08-08", lambda r: _said(r.field) & ((_kind(r.field) != "STRING") | ~_text(r.field).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp(_text(r.field), F.lit("yyyy-MM-dd")).isNull())),
    "needed": ("is needed", lambda r: (_text(r.field) == "") & ~F.coalesce(_kind(r.field).startswith("OBJECT"), F.lit(False))),
    "only with platform": ("belongs only to platform {values}", lambda r: _said(r.field) & ~_text("platform").isin(*r.values)),
    "oracle target": ("makes no address of a board with {values}", lambda r: (_text(r.field) != "") & (_text(r.values[0]) != "") & urls.oracle_target(_text(r.field), _text(r.values[0])).isNull()),
    "mapping": ("must be a mapping", lambda r: _said(r.field) & ~_kind(r.field).startswith("OBJECT")),
    "keys": ("may only have {values}", lambda r: F.size(F.array_except(F.map_keys(_map(r.field)), F.array(*map(F.lit, r.values)))) > 0),
    "texts": ("must map to texts that are not empty", lambda r: F.exists(F.map_values(_map(r.field)), lambda v: (F.schema_of_variant(v) != "STRING") | (F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))) == ""))),
    "address": ("must be a public https address without credentials", lambda r: (_text(r.field) != "") & ~urls.public_https_url(_text(r.field))),
    "pattern": ("is no regular expression", lambda r: ~_compiles(_text(r.field))),
    "element": ("must be the name of an element", lambda r: (_text(r.field) != "") & ~_text(r.field).rlike(r"^[A-Za-z_][\w.:-]{0,63}$")),
    "whole number": ("must be a whole number, 0 or more", lambda r: _said(r.field) & (_kind(r.field) != "STRING") & (~_kind(r.field).isin(*_INT) | (F.coalesce(F.try_variant_get("entry", f"$.{r.field}", "long"), F.lit(-1)) < 0)) | ((_kind(r.field) == "STRING") & (_text(r.field) != ""))),
    "positive": ("must be 1 or more", lambda r: F.coalesce(F.try_variant_get("entry", f"$.{r.field}", "long"), F.lit(0)) < 1),
}


def rules(spark: SparkSession) -> DataFrame:
    """The rules as rows."""
    return spark.createDataFrame([(r.field, r.kind, list(r.values), " = ".join(r.within), KINDS[r.kind][0].format(values=", ".join(r.values))) for r in RULES], "field string, kind string, values array<string>, asked_where string, message string")


def errors() -> Column:
    """All errors of ``entry``, a variant, in the rules' order; an entry that is no mapping has one."""
    told = []
    for r in RULES:
        message, broken = KINDS[r.kind]
        asked = F.lit(True)
        if len(r.within) == 2:
            asked = F.lower(_text(r.within[0])) == r.within[1]
        elif r.within:
            asked = F.coalesce(_kind(r.within[0]).startswith("OBJECT"), F.lit(False)) | (_text(r.within[0]) != "")
        told.append(F.when(asked & F.coalesce(broken(r), F.lit(False)), F.lit(f"{r.field} {message.format(values=', '.join(r.values))}")))
    mapping = F.coalesce(F.schema_of_variant("entry").startswith("OBJECT"), F.lit(False))
    return F.when(mapping, F.array_distinct(F.array_compact(F.array(*told)))).otherwise(F.array(F.lit("is no entry")))


def check(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines``, each a JSON text in ``column``, with errors: an empty array for entries that may be used."""
    return lines.withColumn("entry", F.try_parse_json(column)).withColumn("errors", errors()).drop("entry")
