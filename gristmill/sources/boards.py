"""Readers: one projection for each payload family, from files of JSON, XML, HTML or Markdown to posting rows.

Every reader yields native_id, title, url, location, description, posted_at and employment_type; rows
without id or title are dropped and counted by ``salvage``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import collapse_whitespace, strip_html


@dataclass(frozen=True)
class Board:
    """How one platform's payload becomes rows: its schema, the path of its rows, and each column's expression."""

    schema: str
    rows: str | None
    columns: dict[str, str]
    keep: str = "true"


def _place(*parts: str) -> str:
    return f"array_join(array_distinct(filter(array({', '.join(parts)}), x -> x is not null and x <> '')), ', ')"


BOARDS = {
    "greenhouse": Board("jobs array<struct<id: bigint, title: string, absolute_url: string, updated_at: string, location: struct<name: string>, content: string>>", "jobs", {"native_id": "cast(r.id as string)", "title": "r.title", "url": "r.absolute_url", "location": "r.location.name", "html": "r.content", "posted_at": "try_to_timestamp(r.updated_at)"}),
    "lever": Board("array<struct<id: string, text: string, hostedUrl: string, createdAt: bigint, categories: struct<location: string, allLocations: array<string>, commitment: string>, descriptionPlain: string, additionalPlain: string>>", None, {"native_id": "r.id", "title": "r.text", "url": "r.hostedUrl", "location": "coalesce(nullif(array_join(array_distinct(r.categories.allLocations), ' / '), ''), r.categories.location)", "html": "concat_ws('\\n', r.descriptionPlain, r.additionalPlain)", "posted_at": "timestamp_millis(r.createdAt)", "employment_type": "r.categories.commitment"}),
    "ashby": Board("jobs array<struct<id: string, title: string, location: string, secondaryLocations: array<struct<locationName: string>>, employmentType: string, isListed: boolean, isRemote: boolean, publishedAt: string, jobUrl: string, descriptionPlain: string, descriptionHtml: string>>", "jobs", {"native_id": "r.id", "title": "r.title", "url": "r.jobUrl", "location": "coalesce(nullif(array_join(array_distinct(filter(concat(array(r.location), coalesce(r.secondaryLocations.locationName, array())), x -> x is not null and x <> '')), ' / '), ''), if(r.isRemote, 'Remote', null))", "html": "coalesce(nullif(r.descriptionPlain, ''), r.descriptionHtml)", "posted_at": "try_to_timestamp(r.publishedAt)", "employment_type": "r.employmentType"}, "coalesce(r.isListed, true)"),
    "smartrecruiters": Board("content array<struct<id: string, name: string, releasedDate: string, location: struct<city: string, region: string, country: string, remote: boolean, fullLocation: string>>>", "content", {"native_id": "r.id", "title": "r.name", "location": f"coalesce(nullif(r.location.fullLocation, ''), nullif({_place('r.location.city', 'r.location.region', 'r.location.country')}, ''), if(r.location.remote, 'Remote', null))", "posted_at": "try_to_timestamp(r.releasedDate)"}),
    "workable": Board("jobs array<struct<shortcode: string, title: string, url: string, city: string, state: string, country: string, telecommuting: boolean, employment_type: string, published_on: string, description: string, requirements: string, benefits: string>>", "jobs", {"native_id": "r.shortcode", "title": "r.title", "url": "r.url", "location": f"coalesce(nullif({_place('r.city', 'r.state', 'r.country')}, ''), if(r.telecommuting, 'Remote', null))", "html": "concat_ws('\\n', r.description, r.requirements, r.benefits)", "posted_at": "try_to_timestamp(r.published_on)", "employment_type": "r.employment_type"}),
    "recruitee": Board("offers array<struct<id: bigint, title: string, slug: string, description: string, requirements: string, location: string, city: string, country_code: string, employment_type_code: string, careers_url: string, remote: boolean, published_at: string>>", "offers", {"native_id": "cast(r.id as string)", "title": "r.title", "url": "r.careers_url", "location": f"coalesce(nullif(r.location, ''), nullif({_place('r.city', 'r.country_code')}, ''), if(r.remote, 'Remote', null))", "html": "concat_ws('\\n', r.description, r.requirements)", "posted_at": "coalesce(try_to_timestamp(r.published_at, \"yyyy-MM-dd HH:mm:ss 'UTC'\"), try_to_timestamp(r.published_at))", "employment_type": "r.employment_type_code"}),
    "bamboohr": Board("result array<struct<id: string, jobOpeningName: string, location: struct<city: string, state: string, country: string>, atsLocation: struct<city: string, state: string, country: string>, isRemote: boolean>>", "result", {"native_id": "r.id", "title": "r.jobOpeningName", "location": f"coalesce(nullif({_place('r.location.city', 'r.location.state', 'r.location.country')}, ''), {_place('r.atsLocation.city', 'r.atsLocation.state', 'r.atsLocation.country')})"}),
    "breezy": Board("array<struct<id: string, name: string, location: struct<name: string, city: string, country: struct<name: string>, is_remote: boolean>, url: string, description: string, published_date: string>>", None, {"native_id": "r.id", "title": "r.name", "url": "r.url", "location": f"coalesce(nullif(r.location.name, ''), nullif({_place('r.location.city', 'r.location.country.name')}, ''), if(r.location.is_remote, 'Remote', null))", "html": "r.description", "posted_at": "try_to_timestamp(r.published_date)"}),
    "collage": Board("positions array<struct<id: string, title: string, url: string, location: string, description: string>>", "positions", {"native_id": "r.id", "title": "r.title", "url": "r.url", "location": "r.location", "html": "r.description"}),
    "oracle_cloud": Board("items array<struct<TotalJobsCount: int, requisitionList: array<struct<Id: string, Title: string, PostedDate: string, PrimaryLocation: string, PrimaryLocationCountry: string, ShortDescriptionStr: string, ExternalQualificationsStr: string, ExternalResponsibilitiesStr: string>>>>", "items[0].requisitionList", {"native_id": "r.Id", "title": "r.Title", "location": _place("r.PrimaryLocation", "r.PrimaryLocationCountry"), "html": "concat_ws(' ', r.ShortDescriptionStr, r.ExternalQualificationsStr, r.ExternalResponsibilitiesStr)", "posted_at": "try_to_timestamp(r.PostedDate)"}),
    "workday": Board("jobPostings array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>", "jobPostings", {"native_id": "coalesce(get(filter(r.bulletFields, x -> trim(x) <> ''), 0), element_at(split(r.externalPath, '/'), -1))", "title": "r.title", "url": "r.externalPath", "location": "r.locationsText"}),
    "simplify": Board("array<struct<id: string, company_name: string, title: string, url: string, locations: array<string>, active: boolean, is_visible: boolean, date_posted: bigint, terms: array<string>, degrees: array<string>, sponsorship: string, category: string>>", None, {"native_id": "r.id", "company": "r.company_name", "title": "r.title", "url": "r.url", "location": "array_join(r.locations, ' / ')", "posted_at": "timestamp_seconds(r.date_posted)", "terms": "r.terms", "degrees": "r.degrees", "sponsorship": "r.sponsorship", "category": "r.category"}, "coalesce(r.active, true) and coalesce(r.is_visible, true)"),
    "community": Board("array<struct<id: string, company_name: string, title: string, url: string, locations: array<string>, active: boolean, is_visible: boolean, date_posted: bigint, season: string, sponsorship: string>>", None, {"native_id": "coalesce(nullif(r.id, ''), concat_ws(':', r.company_name, r.title, r.url))", "company": "r.company_name", "title": "r.title", "url": "r.url", "location": "array_join(r.locations, ' / ')", "posted_at": "timestamp_seconds(r.date_posted)", "sponsorship": "r.sponsorship", "season": "r.season"}, "coalesce(r.active, true) and coalesce(r.is_visible, true) and trim(r.company_name) <> ''"),
    "themuse": Board("results array<struct<id: bigint, name: string, locations: array<struct<name: string>>, refs: struct<landing_page: string>, contents: string>>", "results", {"native_id": "cast(r.id as string)", "title": "r.name", "url": "r.refs.landing_page", "location": "array_join(r.locations.name, ' / ')", "html": "r.contents"}),
    "quebec-emploi": Board("items array<struct<ide_affch: bigint, titre: string, employeur: string, nom_ville: string>>", "items", {"native_id": "cast(r.ide_affch as string)", "title": "r.titre", "location": "r.nom_ville"}),
    "zshah101": Board("array<struct<id: string, title: string, url: string, location: string, program: string>>", None, {"native_id": "r.id", "title": "r.title", "url": "r.url", "location": "r.location"}, "lower(r.program) = 'internship'"),
}
COLUMNS = ("native_id", "company", "title", "url", "location", "employment_type", "category", "season", "sponsorship")


def parse_board(payloads: DataFrame, platform: str, payload_col: str = "payload") -> DataFrame:
    """``payloads`` exploded into rows of the platform; a payload that is no such JSON gives none (``malformed`` names it)."""
    board = BOARDS[platform]
    schema = board.schema if board.rows is None else f"struct<{board.schema.replace(' array', ': array', 1)}>"
    text = F.col(payload_col)
    if platform == "community":  # a list, or an object around one
        text = F.coalesce(F.get_json_object(payload_col, "$.listings"), text)
    parsed = payloads.withColumn("p_", F.from_json(text, schema))
    rows = parsed.withColumn("r", F.explode(F.expr("p_" if board.rows is None else f"p_.{board.rows}"))).filter(F.expr(board.keep))
    out = {c: F.coalesce(F.expr(board.columns.get(c, "cast(null as string)")), F.lit("")) for c in COLUMNS}
    for c in ("terms", "degrees"):
        out[c] = F.coalesce(F.expr(board.columns.get(c, "cast(null as array<string>)")), F.array().cast("array<string>"))
    out["posted_at"] = F.expr(board.columns.get("posted_at", "cast(null as timestamp)"))
    out["description"] = strip_html(F.coalesce(F.expr(board.columns.get("html", "''")), F.lit("")))
    return rows.select(*[c for c in payloads.columns if c != payload_col], *[v.alias(k) for k, v in out.items()])


def malformed(payloads: DataFrame, platform: str, payload_col: str = "payload") -> DataFrame:
    """``payloads`` that do not hold the platform's list at all, so that a run can count and keep them."""
    path = BOARDS[platform].rows
    at = "$" if path is None else "$." + path
    listed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload_col), at, "variant")).startswith("ARRAY")
    if platform == "community":
        listed = listed | F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload_col), "$.listings", "variant")).startswith("ARRAY"), F.lit(False))
    return payloads.filter(~F.coalesce(listed, F.lit(False)))


def read_board(spark: SparkSession, path: str | list[str], platform: str) -> DataFrame:
    """Rows of all payload files under the paths, with the file that each is from."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))
    return parse_board(files, platform)


def fetch_states(planned: DataFrame, read: DataFrame) -> DataFrame:
    """One row: files planned and missing, and whether what was read may close what it does not name: only if all are
    there."""
    seen = planned.join(read.select("file").distinct().withColumn("there", F.lit(True)), "file", "left")
    one = seen.agg(F.count("*").alias("planned"), F.count_if(F.col("there").isNull()).alias("missing"))
    return one.withColumn("authoritative", F.col("missing") == 0)


def first_of_pages(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a paged listing, each native_id once, as the first page in ``order`` has it."""
    rest = [c for c in rows.columns if c != "native_id"]
    turn = F.struct(*[F.col(c) for c in order])
    return rows.groupBy("native_id").agg(F.min_by(F.struct(*rest), turn).alias("r")).select("native_id", "r.*").select(*rows.columns)


def with_details(rows: DataFrame, details: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, fetches): descriptions of ``details`` (native_id, html; null: it could not be fetched) put into the rows
    that were ``wanted``, and what became of each of those."""
    got = wanted.select("native_id").join(details, "native_id", "left")
    filled = rows.join(got.select("native_id", strip_html(F.col("html")).alias("more")), "native_id", "left")
    out = filled.withColumn("description", F.coalesce(F.nullif("more", F.lit("")), "description")).select(*rows.columns)
    return out, got.select("native_id", F.coalesce(strip_html(F.col("html")) != "", F.lit(False)).alias("resolved"), F.col("html").isNull().alias("failed"))


def fallback(whole: DataFrame, bare: DataFrame, key: str) -> DataFrame:
    """Payloads of ``whole`` and, for boards whose whole listing was too large to come, of ``bare``; those are degraded."""
    lacking = bare.join(whole.filter("payload is not null").select(key), key, "left_anti")
    return whole.filter("payload is not null").withColumn("degraded", F.lit(False)).unionByName(lacking.withColumn("degraded", F.lit(True)))


def salvage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with id and title, and the others."""
    good = (F.trim("native_id") != "") & (F.trim("title") != "")
    return rows.filter(good), rows.filter(~good)


def parse_rss(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Items of RSS payloads: the first title, link, guid and description of each."""
    first = lambda item, tag: F.regexp_replace(F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    items = payloads.select(*[c for c in payloads.columns if c != payload_col], F.explode(F.regexp_extract_all(payload_col, F.lit(r"(?is)<item\b[^>]*>.*?</item>"), F.lit(0))).alias("i"))
    return items.select("*", strip_html(first(F.col("i"), "title")).alias("title"), F.trim(first(F.col("i"), "link")).alias("url"), F.coalesce(F.nullif(first(F.col("i"), "guid"), F.lit("")), first(F.col("i"), "link")).alias("native_id"), strip_html(first(F.col("i"), "description")).alias("description")).drop("i")


def parse_sitemap(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Locations of a sitemap with the last path segment as slug and a title made of it."""
    loc = payloads.select(*[c for c in payloads.columns if c != payload_col], F.explode(F.regexp_extract_all(payload_col, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))
    parts = F.filter(F.split(F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*|[?#].*$", ""), "/"), lambda s: s != "")
    return loc.withColumn("slug", F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).withColumn("title", F.initcap(F.regexp_replace("slug", "[-_]+", " ")))


def parse_jsonld(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """JobPosting objects of a page's JSON-LD blocks, single, in lists or under @graph."""
    one = "struct<`@type`: string, title: string, url: string, description: string, identifier: struct<value: string>>"
    block = F.explode(F.regexp_extract_all(payload_col, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)))
    seen = payloads.select(*[c for c in payloads.columns if c != payload_col], block.alias("b"))
    graph = F.from_json("b", f"struct<`@graph`: array<{one}>>")["@graph"]
    every = F.filter(F.concat(F.coalesce(F.from_json("b", f"array<{one}>"), F.array().cast(f"array<{one}>")), F.coalesce(graph, F.array().cast(f"array<{one}>"))), lambda x: x["@type"] == "JobPosting")
    return seen.select("*", F.explode(F.array_distinct(every)).alias("r")).select(*[c for c in seen.columns if c != "b"], "r.title", "r.url", strip_html(F.col("r.description")).alias("description"), F.coalesce("r.identifier.value", "r.url", "r.title").alias("native_id"))


def _lines(payloads: DataFrame, key: str, payload_col: str) -> DataFrame:
    return payloads.select(key, F.posexplode(F.split(payload_col, r"\r\n|[\n\r]")).alias("pos", "line"))


def _cells(line: Column) -> Column:
    """Cells of a table's row; null for other lines and for the rule below its head."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return F.when(line.rlike(r"^\s*\|.*\|\s*$") & ~line.rlike(r"^[\s|:-]+$"), cells)


def _plain(c: Column) -> Column:
    """A cell's text: links as what they say, no marks, no markup."""
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"\[([^\]]+)\]\([^)]*\)", "$1"), r"\*\*|`", "")
    return F.regexp_replace(collapse_whitespace(strip_html(said)), r"^[| ]+|[| ]+$", "")


def _urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s)\"'<>]+"), F.lit(0))


def parse_markdown(payloads: DataFrame, key: str, payload_col: str = "payload", width: int | None = None) -> DataFrame:
    """Rows of a Markdown table (company, title, location, link), the company carried down where its cell is empty or
    ``↳``; with ``width`` only of tables of so many columns. Rows without a link are dropped."""
    from gristmill.operators.merge import carry_forward

    rows = _lines(payloads, key, payload_col).withColumn("c", _cells(F.col("line"))).filter(F.col("c").isNotNull() & (F.size("c") == width if width else F.size("c") >= 4))
    named = rows.withColumn("company", _plain(F.col("c")[0])).filter(F.lower("company") != "company").withColumn("company", F.when(F.col("company") == "↳", "").otherwise(F.col("company")))
    carried = carry_forward(named, key, "pos", "company")
    out = carried.select(key, "pos", "company", _plain(F.col("c")[1]).alias("title"), _plain(F.col("c")[2]).alias("location"), F.coalesce(F.try_element_at(_urls(F.col("c")[3]), F.lit(-1)), F.lit("")).alias("url"))
    return out.filter("url <> '' and company <> ''")


def parse_wide_markdown(payloads: DataFrame, key: str, payload_col: str = "payload") -> DataFrame:
    """Rows of tables of seven columns (title, company, description, -, details, location, link) that speak of interns
    in title or details."""
    rows = _lines(payloads, key, payload_col).withColumn("c", _cells(F.col("line"))).filter(F.col("c").isNotNull() & (F.size("c") == 7))
    kept = rows.filter(F.concat_ws(" ", F.col("c")[0], F.col("c")[4]).rlike(r"(?i)\b(?:intern|internship|co-?op|student)s?\b"))
    out = kept.select(key, "pos", _plain(F.col("c")[1]).alias("company"), _plain(F.col("c")[0]).alias("title"), _plain(F.col("c")[5]).alias("location"), F.coalesce(F.try_element_at(_urls(F.col("c")[6]), F.lit(-1)), F.lit("")).alias("url"), _plain(F.col("c")[2]).alias("description"))
    return out.filter("url <> ''")


# Roles of the tables under headings, by their short names.
HEADED_ROLES = {
    "qd": "Quantitative Developer Intern", "qr": "Quantitative Research Intern", "qt": "Quantitative Trader Intern", "swe": "Software Engineer Intern", "ml": "Machine Learning Intern",
    "hw": "Hardware Engineer Intern", "fpga": "FPGA Engineer Intern", "devops/sre": "DevOps/SRE Intern",
}


def parse_headed_markdown(payloads: DataFrame, key: str, payload_col: str = "payload") -> DataFrame:
    """Rows of tables of two columns (role, links) under headings that name the company and, below them, lines that
    name its locations; one row for each link, its text behind the role."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = _lines(payloads, key, payload_col)
    head = F.when(F.col("line").startswith("## "), _plain(F.substring("line", 4, 10_000)))
    place = F.when(head.isNotNull(), "").when(F.col("line").startswith("**Locations**:"), _plain(F.substring("line", 15, 10_000)))
    told = lines.withColumn("company", F.last(head, ignorenulls=True).over(w)).withColumn("location", F.last(place, ignorenulls=True).over(w)).withColumn("c", _cells(F.col("line")))
    roles = F.create_map(*[F.lit(x) for pair in HEADED_ROLES.items() for x in pair])
    rows = told.filter(F.col("c").isNotNull() & (F.size("c") == 2)).withColumn("role", F.try_element_at(roles, F.lower(_plain(F.col("c")[0])))).filter("role is not null and company <> ''")
    form = F.lit(r"\[([^\]]*)\]\((https?://[^)\s]+)\)")
    links = F.arrays_zip(F.regexp_extract_all(F.col("c")[1], form, F.lit(1)).alias("label"), F.regexp_extract_all(F.col("c")[1], form, F.lit(2)).alias("url"))
    each = rows.select(key, "pos", "company", F.coalesce("location", F.lit("")).alias("location"), "role", F.explode(links).alias("l"))
    said = F.trim(F.replace(_plain(F.col("l.label")), F.lit("✅"), F.lit("")))
    return each.select(key, "pos", "company", F.when(said != "", F.concat("role", F.lit(" — "), said)).otherwise(F.col("role")).alias("title"), "location", F.col("l.url").alias("url"))


def parse_cell_markdown(payloads: DataFrame, key: str, now: Column, payload_col: str = "payload") -> DataFrame:
    """Rows of tables whose cells are HTML (company, title, location, [pay,] link, age), of five or six columns; an age
    like ``3d`` dates them. Rows of another width, or without company or link, have a null url."""
    rows = _lines(payloads, key, payload_col).filter(F.trim("line").rlike(r"(?i)^\|\s*<a href=")).withColumn("c", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)))
    known = F.size("c").isin(5, 6)
    text = lambda c: collapse_whitespace(strip_html(c))
    company = text(F.regexp_extract(F.col("c")[0], r"(?is)<strong>(.*?)</strong>", 1))
    link = F.nullif(F.regexp_extract(F.try_element_at("c", F.lit(-2)), r"(?i)href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    days = F.nullif(F.regexp_extract(text(F.try_element_at("c", F.lit(-1))), r"^(\d+)d$", 1), F.lit("")).cast("int")
    return rows.select(key, "pos", company.alias("company"), text(F.get("c", F.lit(1))).alias("title"), text(F.get("c", F.lit(2))).alias("location"), F.when(known & (company != ""), link).alias("url"), F.when(known, now - F.make_dt_interval(days)).alias("posted_at"))


def unwrap_base64(envelope: Column) -> Column:
    """The Markdown inside a ``{"encoding": "base64", "content": ...}`` envelope, null for another."""
    content = F.try_to_binary(F.regexp_replace(F.get_json_object(envelope, "$.content"), r"\s", ""), F.lit("base64"))
    return F.when(F.get_json_object(envelope, "$.encoding") == "base64", F.try_validate_utf8(content.cast("string")))
