"""The register of employers: reading and checking rows, matching against a dataset, verdicts of probes, adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import urls
from gristmill.functions.text import first_line, fold, name_matches, name_root, tokens

from . import register_rules

COMPANY = (
    "name string, platform string, slug string, enabled boolean, fmt string, rate_profile string, last_verified date, recheck_after date, paused_until date, "
    "source_of_record string, notes string"
)
#: Words that make a division of its parent's name.
QUALIFIERS = (
    "americas", "canada", "usa", "us", "uk", "europe", "emea", "apac", "asia", "global", "international", "north", "america", "technologies",
    "technology", "digital", "services", "solutions", "group", "labs", "research", "studios", "cloud", "ai",
)
# Postings that an employer of each size may have.
SIZES = {"startup": (1, 300), "mid": (5, 3000), "large": (25, 60000)}


def read_registry(spark: SparkSession, path: str, today: Column) -> tuple[DataFrame, DataFrame]:
    """(companies, rejected) of JSON lines under ``path``: a row needs a name, a platform and a slug, and keeps to all of
    ``register_rules.RULES``; two rows of one board are both rejected; a pause that has passed ends, and its row is
    enabled. Rejected rows carry why, the first reason, and all their errors."""
    lines = register_rules.check(spark.read.text(path))
    rows = lines.select(F.from_json("value", COMPANY).alias("row"), "errors").select("row.*", "errors")
    key = F.concat_ws(":", F.lower("platform"), F.lower("slug"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    marked = rows.withColumn("registry_key", key).withColumn("why", F.when(blank("name"), "no name").when(blank("platform"), "no platform").when(blank("slug") | ~F.coalesce(urls.safe_slug(F.col("slug")), F.lit(False)), "no usable slug").when(F.size("errors") > 0, F.get("errors", F.lit(0))))
    twice = marked.filter("why is null").groupBy("registry_key").agg(F.count("*").alias("n")).filter("n > 1").select("registry_key", F.lit(True).alias("twice"))
    judged = marked.join(twice, "registry_key", "left").withColumn("why", F.coalesce("why", F.when(F.col("twice"), "board listed twice"))).drop("twice")
    over = F.coalesce(F.col("paused_until") <= today, F.lit(False))
    good = judged.filter("why is null").drop("why", "errors").withColumn("enabled", F.coalesce("enabled", F.lit(True)) | over).withColumn("paused_until", F.when(~over, F.col("paused_until")))
    return good, judged.filter("why is not null")


def shard(name: Column) -> Column:
    """The first folded letter of a name, ``other`` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(fold(name), "^([a-z])", 1), F.lit("")), F.lit("other"))


def write_registry(companies: DataFrame, path: str) -> None:
    """Rows by shard; shards that no row is in any more go."""
    kept = companies.drop("registry_key").withColumn("shard", shard(F.col("name")))
    kept.repartition("shard").sortWithinPartitions(F.lower("name"), "name").write.mode("overwrite").partitionBy("shard").json(path)


def parse_dataset(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """(name, website, links, countries) of payloads that are a JSON list of employers or an object around one; links
    and countries may be one text, a list, or an object of them. Rows without a name go."""
    parsed = payloads.select(F.try_parse_json(payload_col).alias("p"))
    item = "array<variant>"
    whole = F.coalesce(F.try_variant_get("p", "$", item), F.get(F.filter(F.transform(F.map_values(F.try_variant_get("p", "$", "map<string,variant>")), lambda v: F.try_variant_get(v, "$", item)), lambda x: x.isNotNull()), F.lit(0)))
    rows = parsed.select(F.explode(whole).alias("r"))

    def texts(key: str) -> Column:
        at = f"$.{key}"
        one = F.when(F.expr(f"schema_of_variant(try_variant_get(r, '{at}', 'variant')) = 'STRING'"), F.array(F.try_variant_get("r", at, "string")))
        strings = lambda vs: F.filter(F.transform(vs, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
        listed = strings(F.try_variant_get("r", at, item))
        mapped = strings(F.map_values(F.try_variant_get("r", at, "map<string,variant>")))
        return F.coalesce(one, listed, mapped, F.array().cast("array<string>"))

    out = rows.select(F.trim(F.try_variant_get("r", "$.name", "string")).alias("name"), F.coalesce(F.try_variant_get("r", "$.website", "string"), F.lit("")).alias("website"), texts("ats_links").alias("links"), texts("countries").alias("countries"))
    return out.filter("name <> ''")


def root_tokens(name: Column) -> Column:
    return tokens(name_root(name))


def is_division(parent: Column, name: Column) -> Column:
    """A longer name that begins with the parent's words and goes on with nothing but qualifiers."""
    p, n = root_tokens(parent), root_tokens(name)
    more = F.slice(n, F.size(p) + 1, F.greatest(F.size(n) - F.size(p), F.lit(1)))
    begins = (F.size(n) > F.size(p)) & (F.slice(n, F.lit(1), F.size(p)) == p)
    return begins & F.forall(more, lambda t: F.array_contains(F.array(*[F.lit(q) for q in QUALIFIERS]), t))


def recognized(entries: DataFrame) -> DataFrame:
    """(name, countries, platform, slug, label, at): the boards that an entry's links name, each label once, in order."""
    seen = entries.select("name", "countries", F.posexplode("links").alias("at", "link")).withColumn("p", urls.identify(F.col("link"))).filter("p is not null")
    one = seen.select("name", "countries", "p.platform", "p.slug", F.concat_ws("/", "p.platform", "p.slug").alias("label"), "at")
    return one.groupBy("name", "label").agg(F.min_by(F.struct("countries", "platform", "slug", "at"), "at").alias("b")).select("name", "b.countries", "b.platform", "b.slug", "label", "b.at")


def crossref(seeds: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, contested) boards of seeds (name): entries of the seed's own name, and its divisions, by joins on the
    folded root and on every beginning of longer names. A label that unlike names claim belongs to none."""
    key = lambda c: F.array_join(root_tokens(c), " ")
    s = seeds.select(F.col("name").alias("seed"), key(F.col("name")).alias("key")).filter("key <> ''")
    first = entries.withColumn("key", key(F.col("name")))
    own = s.join(first.groupBy("key").agg(F.min("name").alias("entry")), "key").select("seed", "entry", F.lit(False).alias("related"))
    words = root_tokens(F.col("name"))
    begins = first.withColumn("key", F.explode(F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " ")))))
    seeded = s.select(F.col("key").alias("own_key"))
    parts = s.join(begins.select("key", F.col("name").alias("entry")), "key").filter(is_division(F.col("seed"), F.col("entry")))
    parts = parts.withColumn("own_key", key(F.col("entry"))).join(seeded, "own_key", "left_anti").select("seed", "entry", F.lit(True).alias("related"))
    claims = own.unionByName(parts).join(recognized(entries).withColumnRenamed("name", "entry"), "entry").select("seed", "entry", "related", "platform", "slug", "label")
    short = claims.groupBy("label").agg(F.min_by("entry", F.struct(F.length("entry"), "entry")).alias("root"))
    family = claims.join(short, "label").withColumn("kin", F.slice(root_tokens(F.col("entry")), F.lit(1), F.size(root_tokens(F.col("root")))) == root_tokens(F.col("root")))
    bad = family.groupBy("label").agg(F.bool_and("kin").alias("one"), F.array_sort(F.collect_set("entry")).alias("names")).filter("not one")
    good = claims.join(bad.select("label"), "label", "left_anti")
    turn = F.row_number().over(W.partitionBy("label").orderBy("related", F.lower("seed"), "entry"))
    return good.withColumn("n", turn).filter("n = 1").drop("n"), bad.select("label", "names")


def mine_country(entries: DataFrame, country: str, known: DataFrame) -> DataFrame:
    """(name, platform, slug): employers of a country with one board only, which no known label names; of one label the
    first by name."""
    here = entries.filter(F.exists("countries", lambda c: fold(c) == fold(F.lit(country))))
    boards = recognized(here)
    single = boards.groupBy("name").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("platform").alias("platform"), F.first("slug").alias("slug")).filter("n = 1")
    new = single.join(known.select("label").distinct(), "label", "left_anti")
    return new.groupBy("label").agg(F.min(F.struct(F.lower("name").alias("low"), "name", "platform", "slug")).alias("b")).select("b.name", "b.platform", "b.slug").orderBy(F.lower("name"), "name")


def direct_boards(applied: DataFrame, order: list[str]) -> DataFrame:
    """(company, platform, slug): of the boards that an employer's own URLs name, that of the first platform in order,
    then of the least slug."""
    seen = applied.withColumn("p", urls.identify(F.col("url"))).filter("p is not null")
    turn = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("p.platform"))
    best = seen.withColumn("turn", turn).filter("turn > 0").groupBy("company").agg(F.min(F.struct("turn", "p.slug", "p.platform")).alias("b"))
    return best.select("company", "b.platform", "b.slug")


def platform_histogram(boards: DataFrame) -> DataFrame:
    return boards.groupBy("platform").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "platform")


def probe_verdict(company: Column, board_name: Column, count: Column, size: Column) -> Column:
    """struct(verdict, detail) of a probed board: miss without a list, empty, rejected for a number of postings that no
    employer of its size has or for another's name, unverified without a name, match."""
    low = F.coalesce(*[F.when(size == k, F.lit(v[0])) for k, v in SIZES.items()])
    high = F.coalesce(*[F.when(size == k, F.lit(v[1])) for k, v in SIZES.items()])
    said = lambda v, *d: F.struct(F.lit(v).alias("verdict"), F.concat(*d).alias("detail"))
    n = count.cast("string")
    return (
        F.when(count.isNull(), said("miss", F.lit("no job collection in the response"))).when(count == 0, said("empty", F.lit("board exists but is empty")))
        .when(count < low, said("rejected", n, F.lit(" posting(s) is below the plausible floor for a "), size, F.lit(" employer")))
        .when(count > high, said("rejected", n, F.lit(" posting(s) exceeds the plausible ceiling for a "), size, F.lit(" employer")))
        .when(F.coalesce(board_name, F.lit("")) == "", said("unverified", F.lit("no board name")))
        .when(~name_matches(company, board_name), said("rejected", F.lit("board is named "), board_name)).otherwise(said("match", F.lit("")))
    )


def verify(companies: DataFrame, results: DataFrame, today: Column) -> DataFrame:
    """``companies`` after probes (company, verdict, detail): matches are enabled and dated, rejections disabled with a
    dated note of one line, others as they were."""
    told = results.groupBy("company").agg(F.bool_or(F.col("verdict") == "match").alias("live"), F.max(F.when(F.col("verdict") == "rejected", F.coalesce(F.nullif("detail", F.lit("")), "verdict"))).alias("dead"))
    met = companies.join(told.withColumnRenamed("company", "name"), "name", "left")
    live, dead = F.coalesce("live", F.lit(False)), ~F.coalesce("live", F.lit(False)) & F.col("dead").isNotNull()
    note = F.concat(F.date_format(today, "yyyy-MM-dd"), F.lit(": "), F.left(first_line(F.col("dead")), F.lit(200)))
    out = {"enabled": F.when(live, True).when(dead, False).otherwise(F.col("enabled")), "last_verified": F.when(live, F.to_date(today)).when(~dead, F.col("last_verified")), "notes": F.when(dead, note).when(~live, F.col("notes"))}
    return met.withColumns(out).select(*companies.columns)


def adopt(existing: DataFrame, results: DataFrame, unnamed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(adopted, review) of probe results (at, company, platform, slug, verdict, job_count): matches with a posting,
    and on request unverified ones, whose board and name nobody has, each board and each name once by ``at``; the
    others that are unverified and have postings are for review."""
    some = F.coalesce("job_count", F.lit(0)) > 0
    open_ = (F.col("verdict") == "unverified") & some
    key, caption = F.concat_ws("/", "platform", F.lower("slug")), F.lower("company")
    marked = results.withColumns({"key": key, "caption": caption, "take": ((F.col("verdict") == "match") & some) | (open_ & unnamed), "look": open_ & (not unnamed)})
    boards = existing.select(F.concat_ws("/", "platform", F.lower("slug")).alias("key")).distinct()
    names = existing.select(F.lower("name").alias("caption")).distinct()
    once = lambda df, *by: df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("at"))).filter("n = 1").drop("n")
    new = marked.filter("take").join(boards, "key", "left_anti").join(names, "caption", "left_anti")
    adopted = once(once(new, "key"), "caption").select("company", "platform", "slug", "job_count")
    distinctive = (F.length(F.regexp_replace("slug", "[-_]", "")) > 6) & name_matches(F.col("company"), F.col("slug"))
    review = once(marked.filter("look").join(boards, "key", "left_anti"), "key").select("company", "platform", "slug", "job_count", distinctive.alias("distinctive"))
    return adopted, review


