"""Registered queries of the posting operators, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions import classify, control, text, urls
from gristmill.operators import dedup, merge, schedule, search
from gristmill.session import shared_folder, shuffle_partitions
from gristmill.sources import custom, export

from .adapters import JOBS, NOW, VISITS, jobs, table, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW_SQL = f"TIMESTAMP '{NOW}'"
WITH_JOBS = f"WITH jobs AS ({JOBS})"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def now():
    return F.lit(NOW).cast("timestamp")


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def fold_sql(c: str) -> str:
    """The canonical form in DuckDB, without inclusive spellings, which the tables do not have."""
    return f"trim(regexp_replace(replace(strip_accents(lower(replace({c}, '&', ' and '))), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"


# Text and URLs


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded, length({fold_sql('text')})::BIGINT AS n FROM documents")
def txt_fold(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "documents").select("doc_id", text.fold(F.col("text")).alias("f"))
    return f.select("doc_id", F.md5("f").alias("folded"), F.length("f").cast("long").alias("n"))


_CONTROL_SQL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
_WHITE_SQL = r"\x20\t\n\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '{_CONTROL_SQL}', '', 'g'), '[{_WHITE_SQL}]+', ' ', 'g'))) AS flat FROM documents""")
def txt_collapse_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("flat"))


@query("""WITH d AS (SELECT doc_id, text, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS head FROM documents)
  SELECT doc_id, head, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS short, CASE WHEN length(head) <= 30 THEN head ELSE left(head, 29) || '…' END AS said FROM d""")
def txt_first_line_truncate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.first_line(t).alias("head"), text.truncate(t, 80).alias("short"), text.summary(t, 30).alias("said"))


def _strip_sql(c: str) -> str:
    """What a reader sees of a page, for markup as the pages have it: named characters, scripts and styles that are
    closed, blocks that end lines, tags."""
    names = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}

    def read(x):
        for name, char in names.items():
            x = f"replace({x}, '{name}', '{char}')"
        return x

    x = f"regexp_replace({read(c)}, '(?is)<script(?:\\s[^>]*)?>.*?</script\\s*>|<style(?:\\s[^>]*)?>.*?</style\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)</p>|</div>|</li>|</tr>|</h[1-6]>|<br */?>', chr(10), 'g')"
    x = read(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: rtrim(l, ' ' || chr(9))), chr(10))"
    return f"trim(regexp_replace({x}, '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


@query(f"SELECT page_id, md5({_strip_sql('html')}) AS plain FROM pages")
def txt_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("plain"))


@query(f"""
WITH n AS (SELECT p_partkey AS k, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Co., Ltd' ELSE '' END) AS name FROM part),
f AS (SELECT k, {fold_sql('name')} AS f FROM n)
SELECT k, f AS folded, regexp_replace(f, '( (inc|incorporated|corp|corporation|co|company|ltd|limited|llc|llp|lp|plc|gmbh|ag|sa|sas|sarl|nv|bv|pty|ulc|ltee))+$', '') AS root FROM f""")
def txt_name_root(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, " Inc.").when(F.col("p_partkey") % 3 == 1, " Co., Ltd").otherwise("")
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", tail).alias("name"))
    return n.select("k", text.fold(F.col("name")).alias("folded"), text.name_root(F.col("name")).alias("root"))


@query(f"""
WITH s AS (SELECT s_suppkey, s_name, string_split({fold_sql('s_name')}, ' ') AS w FROM supplier)
SELECT s_suppkey, array_to_string(list_distinct(list_filter([array_to_string(w, ''), CASE WHEN len(w) > 1 THEN array_to_string(w, '-') END,
  CASE WHEN len(w) > 1 AND NOT list_contains({sql_list(text.GENERIC_TOKENS)}, w[1]) AND length(w[1]) >= 4 THEN w[1] END], lambda x: x IS NOT NULL)).list_sort(), ',') AS slugs FROM s""")
def txt_slug_candidates(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.array_sort(text.slug_candidates(F.col("s_name"))), ",").alias("slugs"))


@query(r"""
WITH n AS (SELECT c_custkey, c_name AS native, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer),
i AS (SELECT c_custkey, concat_ws(':', 'lever', 'b-1', CASE WHEN native = slug THEN native ELSE slug || '~' || lower(hex(encode(native))) END) AS id FROM n)
SELECT c_custkey, id, 'lever:b-1' AS board FROM i""")
def ids_posting(spark, sf):
    id_ = text.posting_id(F.lit("lever"), F.lit("B 1"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", id_.alias("id"), text.board_of(id_, F.lit("")).alias("board"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(rf"""
WITH u AS (SELECT page_id, {_HOST} AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, 'https://' || h || '/' || array_to_string(list_filter(string_split(p, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^[a-z]{{2}}[-_][a-zA-Z]{{2}}$') AND NOT list_contains({sql_list(urls.LANGUAGES)}, lower(s))), '/') AS canonical,
  list_contains({sql_list(urls.TRACKERS)}, h) AS tracker FROM u""")
def url_canonical(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.canonical_apply_url(u).alias("canonical"), urls.is_tracker(u).alias("tracker"))


#: URLs of every board form, made of a customer's key: what the URL is, and the board that it belongs to.
_BOARD_URLS = (
    ("https://boards.greenhouse.io/{s}/jobs/{k}", "greenhouse"), ("https://boards-api.greenhouse.io/v1/boards/{s}/jobs", "greenhouse"), ("https://job-boards.eu.greenhouse.io/en-US/{s}?x=1", "greenhouse"),
    ("https://jobs.lever.co/{s}/{k}", "lever"), ("https://api.lever.co/v0/postings/{s}", "lever"), ("https://jobs.ashbyhq.com/{s}", "ashby"), ("http://careers.smartrecruiters.com/{s}/a", "smartrecruiters"),
    ("https://apply.workable.com/{s}/j/1", "workable"), ("https://{s}.workable.com", "workable"), ("https://jobs.jobvite.com/{s}/job/x", "jobvite"), ("https://join.com/companies/{s}/9", "join"),
    ("{s}.bamboohr.com/jobs", "bamboohr"), ("https://{s}.recruitee.com/o/x", "recruitee"), ("https://{s}.breezy.hr", "breezy"), ("https://secure.collage.co/jobs/{s}", "collage"),
    ("https://{s}.teamtailor.com/jobs", "teamtailor"), ("https://{s}.jobs.personio.de/job/1", "personio"), ("https://{s}.taleo.net/careersection", "taleo"), ("https://careers-{s}.icims.com/x", "icims"),
    ("https://{s}.njoyn.com/a", "njoyn"), ("https://{s}.eightfold.ai/careers", "eightfold"), ("https://jobs.{s}.com/careers?domain={s}.com", "eightfold"), ("https://{s}.csod.com/ux", "cornerstone"),
    ("https://{s}.wd3.myworkdayjobs.com/en-US/Site_1/job/x", "workday"), ("https://{s}.fa.ca2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/2", "oracle_cloud"),
    ("https://careers.{s}.com/go/all/1", "successfactors"), ("https://jobs.{s}.com/en_CA/careers/JobDetail", "avature"),
    ("https://boards.greenhouse.io/embed/{s}", None), ("ftp://jobs.lever.co/{s}", None), ("https://{s}.example.com/about", None), ("https://{s}.taleo.net.example.org/", None),
)
_BOARD_URL_SQL = "[" + ", ".join("'" + u + "'" for u, _ in _BOARD_URLS) + "]"
_BOARD_OF_SQL = "[" + ", ".join("NULL" if p is None else f"'{p}'" for _, p in _BOARD_URLS) + "]"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey % {len(_BOARD_URLS)} + 1 AS form, 'acme' || c_custkey AS s FROM customer)
  SELECT k, {_BOARD_OF_SQL}[form] AS platform, CASE WHEN {_BOARD_OF_SQL}[form] IS NOT NULL THEN s END AS slug,
    CASE {_BOARD_OF_SQL}[form] WHEN 'workday' THEN 'Site_1' WHEN 'oracle_cloud' THEN 'CX_1' END AS site, CASE {_BOARD_OF_SQL}[form] WHEN 'workday' THEN 'wd3' END AS dc,
    starts_with({_BOARD_URL_SQL}[form], 'https://') AS public_https FROM c""")
def url_platform(spark, sf):
    form = F.element_at(F.array(*[F.lit(u) for u, _ in _BOARD_URLS]), (F.col("c_custkey") % len(_BOARD_URLS) + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    made = F.replace(F.replace(form, F.lit("{s}"), F.concat(F.lit("acme"), key)), F.lit("{k}"), key)
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), made.alias("u")).withColumn("p", urls.identify(F.col("u")))
    return u.select("k", "p.platform", "p.slug", "p.site", "p.dc", urls.public_https_url(F.col("u")).alias("public_https"))


# Classification


@query(f"""
WITH d AS (SELECT doc_id, text, list_distinct(string_split({fold_sql('text')}, ' ')) AS w FROM documents),
s AS (SELECT doc_id, text, len(list_intersect(w, {sql_list(classify.FRENCH)})) AS f0, len(list_intersect(w, {sql_list(classify.ENGLISH)})) AS en FROM d),
t AS (SELECT doc_id, en, f0 + CASE WHEN f0 > 0 AND regexp_matches(lower(text), '[àâäçéèêëîïôöùûüÿœæ]') THEN 1 ELSE 0 END AS fr FROM s)
SELECT doc_id, CASE WHEN fr >= 2 AND en >= 2 THEN CASE WHEN fr >= 2 * en THEN 'FR' WHEN en >= 2 * fr THEN 'EN' ELSE 'bilingual' END
  WHEN fr >= 2 THEN 'FR' WHEN en >= 2 THEN 'EN' ELSE 'unknown' END AS language FROM t""")
def lng_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", classify.detect_language(F.col("text"), F.lit("")).alias("language"))


@query("""WITH o AS (SELECT o_orderkey AS k, ['summer', 'fall', 'winter', 'spring'][month(o_orderdate) % 4 + 1] AS s, 2020 + k % 9 AS y, 2020 + k % 5 AS y2, k % 7 AS form, o_orderdate FROM orders)
  SELECT k, CASE form WHEN 0 THEN s || '-' || y WHEN 1 THEN s || '-' || y WHEN 2 THEN 'unknown' WHEN 3 THEN s || '-' || y2 WHEN 4 THEN CASE WHEN y = y2 THEN s || '-' || y ELSE 'unknown' END WHEN 5 THEN 'unknown' ELSE s || '-' || y END AS term,
    CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 8 THEN 1 ELSE 0 END AS INT) AS season_year FROM o""")
def trm_resolve(spark, sf):
    """Seven forms: the year behind, or ahead through fillers; no year; a declared term alone, and against the title's;
    two terms; the body's."""
    k = F.col("o_orderkey")
    season = F.element_at(F.array(*map(F.lit, ("été", "Automne", "Winter", "Spring"))), (F.month("o_orderdate") % 4 + 1).cast("int"))
    plain = F.element_at(F.array(*map(F.lit, ("Summer", "Fall", "Winter", "Spring"))), (F.month("o_orderdate") % 4 + 1).cast("int"))
    y, y2, form = (2020 + k % 9).cast("string"), (2020 + k % 5).cast("string"), k % 7
    said = lambda *xs: F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    title = (
        F.when(form == 0, said("Intern, spring boot -", season, y)).when(form == 1, said("Developer", season, "term of", y)).when(form == 2, said("Intern", season)).when(form == 3, said("Intern"))
        .when(form == 4, said("Intern", season, y)).when(form == 5, said("Intern", season, y, "or Summer 1999, Fall 2030 and Winter 2031")).otherwise("Intern")
    )
    signals = F.when(form.isin(3, 4), F.array(said(plain, y2)))
    body = F.when(form == 6, said("We start in", plain, y)).when(form == 0, "Another, Fall 2038").otherwise("")
    o = table(spark, sf, "orders")
    return o.select(k.alias("k"), classify.resolve_term(title, signals, body).alias("term"), control.upcoming_season_year(F.col("o_orderdate")).alias("season_year"))


#: Places and what they are: bucket, and scope if the segment were remote.
_PLACES = (
    ("Kitchener, ON", "canada", "canada"), ("Austin, TX", "usa", "us"), ("Anywhere", "unknown", "unspecified"), ("Montréal, QC", "montreal", "canada"), ("London, Ontario", "canada", "canada"), ("London", "international", "unspecified"),
    ("New London, CT", "usa", "us"), ("Waterloo", "unknown", "unspecified"), ("Waterloo, Canada", "canada", "canada"), ("Laval, QC", "montreal", "canada"), ("Vancouver, WA", "usa", "us"), ("Paris, Texas", "usa", "us"), ("in or me", "unknown", "unspecified"),
)
_PLACE_SQL = lambda i: "[" + ", ".join(f"'{p[i]}'" for p in _PLACES) + "]"
_OF_NATION = "CASE WHEN n_name = 'CANADA' THEN 'canada' WHEN n_name = 'UNITED STATES' THEN 'usa' WHEN n_name IN ('FRANCE','GERMANY','INDIA','CHINA','JAPAN','BRAZIL','UNITED KINGDOM') THEN 'international' ELSE 'unknown' END"


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % {len(_PLACES)} + 1 AS i, {_OF_NATION} AS own FROM customer JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT c_custkey, {_PLACE_SQL(1)}[i] AS a, own AS b, {_PLACE_SQL(2)}[i] AS s FROM c)
  SELECT c_custkey, CASE WHEN 'montreal' IN (a, b) THEN 'montreal' WHEN 'canada' IN (a, b) THEN 'canada' WHEN 'usa' IN (a, b) THEN 'usa' WHEN 'international' IN (a, b) THEN 'international' ELSE 'unknown' END AS bucket,
    CASE WHEN c_custkey % 2 = 0 THEN s END AS scope FROM p""")
def loc_resolve(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    place = F.element_at(F.array(*[F.lit(p) for p, _, _ in _PLACES]), (F.col("c_custkey") % len(_PLACES) + 1).cast("int"))
    raw = F.concat(place, F.when(F.col("c_custkey") % 2 == 0, " (Remote)").otherwise(""), F.lit(" / "), F.col("n_name"))
    l = classify.resolve_location(raw)  # noqa: E741
    return c.select("c_custkey", l["bucket"].alias("bucket"), l["remote_scope"].alias("scope"))


#: Parts of titles, with what each does: markers (reason, phrase), roles (role, phrase of another field), degrees.
_MARKED = (("Intern", None), ("Summer Student", None), ("Senior", "senior"), ("Student Services", "student services"), ("Internal Audit Intern", None), ("Permanent", "no internship marker in title"))
_FIELDS = (("Software Developer", "swe", None), ("Data Analyst", "data", None), ("Marketing", "unknown", "marketing"), ("Marketing Data", "data", None), ("Nursing Informatics Data", "data", "nursing"), ("Barista", "unknown", None), ("Machine Learning", "ml-ai", None))
_SCOPES = (("", None), ("PhD", "phd"), ("PhD or MSc", "phd"), ("Graduate", "graduate"), ("Graduate or Undergraduate", None))
_pick = lambda xs, i: "[" + ", ".join("NULL" if x[i] is None else f"'{x[i]}'" for x in xs) + "]"


@query(f"""WITH p AS (SELECT p_partkey, {_pick(_MARKED, 1)}[p_partkey % 6 + 1] AS m, p_partkey // 6 % 7 + 1 AS f, {_pick(_SCOPES, 1)}[p_partkey // 42 % 5 + 1] AS d FROM part),
  s AS (SELECT *, {_pick(_FIELDS, 1)}[f] AS role, {_pick(_FIELDS, 2)}[f] AS other FROM p)
  SELECT p_partkey, role, CASE WHEN m IS NOT NULL THEN 'not-an-internship' WHEN d IS NOT NULL THEN 'out-of-scope-degree' WHEN other IS NOT NULL THEN 'not-a-cs-role' WHEN role = 'unknown' THEN 'unknown-cs-role' END AS reason,
    CASE WHEN m IS NOT NULL THEN m WHEN d IS NOT NULL THEN d WHEN other IS NOT NULL THEN other WHEN role = 'unknown' THEN 'no matching CS role or source category' END AS phrase FROM s""")
def scr_screen(spark, sf):
    k = F.col("p_partkey")
    part = lambda xs, i: F.element_at(F.array(*[F.lit(x[0]) for x in xs]), (i + 1).cast("int"))
    title = F.concat_ws(" ", part(_FIELDS, F.floor(k / 6) % 7), part(_MARKED, k % 6), part(_SCOPES, F.floor(k / 42) % 5))
    none = F.lit("")
    # A small file is read by one task, and a title takes far longer to screen than to read.
    p = table(spark, sf, "part").select("p_partkey", title.alias("t")).repartition(shuffle_partitions(spark), "p_partkey").withColumn("s", classify.screen(F.col("t"), none, none, none))
    return p.select("p_partkey", classify.classify_role(F.col("t"), none, none).alias("role"), "s.reason", "s.phrase")


#: Sentences of a body: degrees asked for, alone or beside an alternative near by or far off; leave to work.
_ASKED = (
    ("", "unknown", None, False), ("PhD required.", "phd", "phd required", False), ("PhD required, or a Master with experience.", "phd", None, False), ("Bachelor's degree required.", "bachelors", None, False),
    ("PhD required. We are a small team that has worked for many years on compilers and tools. A Master is welcome elsewhere.", "phd", "phd required", False), ("Masters required. No sponsorship.", "masters", None, True), ("No sponsorship", "unknown", None, True),
)


@query(f"""WITH p AS (SELECT s_suppkey, s_suppkey % {len(_ASKED)} + 1 AS i FROM supplier)
  SELECT s_suppkey, {_pick(_ASKED, 1)}[i] AS degree, {_pick(_ASKED, 2)}[i] AS restricted, [{', '.join(str(x[3]).lower() for x in _ASKED)}][i] AS work_auth FROM p""")
def elg_resolve(spark, sf):
    body = F.element_at(F.array(*[F.lit(x[0]) for x in _ASKED]), (F.col("s_suppkey") % len(_ASKED) + 1).cast("int"))
    s = table(spark, sf, "supplier").select("s_suppkey", body.alias("b")).withColumn("e", classify.resolve_eligibility(F.lit("Intern"), F.col("b")))
    return s.select("s_suppkey", "e.degree", classify.screen_degree(F.lit("Intern"), F.col("b")).alias("restricted"), "e.work_auth")


# Lists, counts and compositions


def _canonical(df):
    return df.filter("duplicate_of is null")


@query(f"""{WITH_JOBS} SELECT id, company, CAST(CAST(first_seen AS DATE) AS STRING) AS first_seen FROM jobs
  WHERE duplicate_of IS NULL AND status = 'open' AND language IN ('EN', 'bilingual') AND location IN ('international', 'other') AND first_seen >= TIMESTAMP '2000-01-01' ORDER BY first_seen DESC, id LIMIT 50""")
def list_topk(spark, sf):
    kept = _canonical(jobs(spark, sf)).filter("status = 'open' and language in ('EN', 'bilingual') and location in ('international', 'other') and first_seen >= timestamp '2000-01-01'")
    return kept.orderBy(F.col("first_seen").desc(), "id").limit(50).select("id", "company", day("first_seen"))


@query(f"{WITH_JOBS} SELECT count(*) AS n, count(*) FILTER (status = 'open') AS n_open, count(duplicate_of) AS n_duplicates FROM jobs WHERE first_seen >= {NOW_SQL} - INTERVAL '400' DAY")
def count_recent(spark, sf):
    recent = jobs(spark, sf).filter(F.col("first_seen") >= now() - F.expr("interval 400 days"))
    return recent.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"), F.count("duplicate_of").alias("n_duplicates"))


_BUCKET = "CASE location WHEN 'other' THEN 'international' WHEN 'remote' THEN 'unknown' ELSE location END"


@query(f"""{WITH_JOBS}, j AS (SELECT {_BUCKET} AS location, role, language, status, source FROM jobs WHERE duplicate_of IS NULL)
  SELECT k AS facet, v AS value, count(*) AS n FROM (
    SELECT 'location' AS k, location AS v FROM j UNION ALL SELECT 'role', role FROM j UNION ALL SELECT 'language', language FROM j UNION ALL SELECT 'status', status FROM j UNION ALL SELECT 'source', source FROM j) GROUP BY 1, 2""")
def composition(spark, sf):
    j = _canonical(jobs(spark, sf)).select(F.expr(_BUCKET).alias("location"), "role", "language", "status", "source")
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in j.columns]))
    return j.select(facets.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


@query(f"""{WITH_JOBS}, c AS (SELECT company, source, count(*) AS n FROM jobs GROUP BY 1, 2)
  SELECT company, string_agg(source || '=' || n, ',' ORDER BY source) AS counts, sum(n)::BIGINT AS total FROM c GROUP BY 1""")
def company_source_counts(spark, sf):
    c = jobs(spark, sf).groupBy("company", "source").agg(F.count("*").alias("n"))
    pair = F.concat("source", F.lit("="), F.col("n").cast("string"))
    return c.groupBy("company").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("counts"), F.sum("n").alias("total"))


@query(f"{WITH_JOBS} SELECT array_to_string(string_split(id, ':')[1:2], ':') AS board, count(*) AS n FROM jobs GROUP BY 1")
def board_counts(spark, sf):
    return jobs(spark, sf).groupBy(text.board_of(F.col("id"), F.lit("")).alias("board")).agg(F.count("*").alias("n"))


@query(f"{WITH_JOBS} SELECT role AS reason, count(*) AS n FROM jobs WHERE status = 'closed' GROUP BY 1 ORDER BY n DESC, 1")
def reason_histogram(spark, sf):
    return jobs(spark, sf).filter("status = 'closed'").groupBy(F.col("role").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason")


@query(f"{WITH_JOBS} SELECT source, board_key, min(rank) AS best, max(price) AS most FROM jobs GROUP BY 1, 2 HAVING count(*) > 1")
def strictest_posture(spark, sf):
    return jobs(spark, sf).groupBy("source", "board_key").agg(F.min("rank").alias("best"), F.max("price").alias("most"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query(f"{WITH_JOBS} SELECT company, id, CAST(rn AS INT) AS place FROM (SELECT company, id, row_number() OVER (PARTITION BY company ORDER BY CASE status WHEN 'open' THEN 0 ELSE 1 END, id) AS rn FROM jobs) WHERE rn <= 5")
def urls_per_company(spark, sf):
    w = W.partitionBy("company").orderBy(F.when(F.col("status") == "open", 0).otherwise(1), "id")
    return jobs(spark, sf).select("company", "id", F.row_number().over(w).alias("place")).filter("place <= 5")


@query(f"{WITH_JOBS} SELECT j.id, j.company, c.id AS canonical, c.status AS canonical_status FROM jobs j JOIN jobs c ON j.duplicate_of = c.id")
def posting_detail(spark, sf):
    j, c = jobs(spark, sf), jobs(spark, sf).select(F.col("id").alias("canonical"), F.col("status").alias("canonical_status"))
    return j.join(c, j["duplicate_of"] == c["canonical"]).select("id", "company", "canonical", "canonical_status")


@query(f"{WITH_JOBS}, open_jobs AS (SELECT * FROM jobs WHERE status = 'open') SELECT id, duplicate_of FROM open_jobs WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT id FROM open_jobs)")
def dangling_duplicates(spark, sf):
    """Of open rows alone, so that canonical rows that are closed are missing."""
    j = jobs(spark, sf).filter("status = 'open'")
    return j.filter("duplicate_of is not null").select("id", "duplicate_of").join(j.select(F.col("id").alias("c")), F.col("duplicate_of") == F.col("c"), "left_anti")


# Merges


def _halves(spark, sf):
    j = jobs(spark, sf).select("id", "source", "board_key", "rank", "status", "first_seen", "last_seen", "duplicate_of", "price")
    key = F.substring_index("id", ":", -1).cast("long")
    return j.filter(key % 3 != 0), j.filter(key % 2 == 0).withColumn("first_seen", now()).withColumn("last_seen", now()).withColumn("status", F.lit("open")), j


_KEY = "CAST(string_split(id, ':')[3] AS BIGINT)"


@query(f"""{WITH_JOBS}, old AS (SELECT * FROM jobs WHERE {_KEY} % 3 <> 0), new AS (SELECT * FROM jobs WHERE {_KEY} % 2 = 0)
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE 'open' END AS status,
    CAST(CAST(coalesce(o.first_seen, {NOW_SQL}) AS DATE) AS STRING) AS first_seen, CAST(CAST(CASE WHEN n.id IS NULL THEN o.last_seen ELSE {NOW_SQL} END AS DATE) AS STRING) AS last_seen
  FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_first_seen(spark, sf):
    old, new, _ = _halves(spark, sf)
    return merge.upsert(old, new).select("id", "status", day("first_seen"), day("last_seen"))


@query(f"""{WITH_JOBS} SELECT id, CAST(CAST(CASE WHEN {_KEY} % 3 <> 0 THEN first_seen WHEN {_KEY} % 5 = 0 THEN first_seen - INTERVAL '1' DAY WHEN {_KEY} % 7 = 0 THEN first_seen - INTERVAL '2' DAY ELSE {NOW_SQL} END AS DATE) AS STRING) AS first_seen
  FROM jobs WHERE {_KEY} % 2 = 0""")
def first_seen_precedence(spark, sf):
    old, new, every = _halves(spark, sf)
    key = F.substring_index("id", ":", -1).cast("long")
    q = every.filter(key % 5 == 0).withColumn("first_seen", F.col("first_seen") - F.expr("interval 1 day"))
    t = every.filter(key % 7 == 0).withColumn("first_seen", F.col("first_seen") - F.expr("interval 2 days"))
    return merge.first_seen_known(new, old, q, t).select("id", day("first_seen"))


@query(f"""{WITH_JOBS}, d AS (SELECT DISTINCT board_key FROM jobs WHERE {_KEY} % 10 < 5)
  SELECT id, CASE WHEN board_key IN (SELECT board_key FROM d) AND status = 'open' AND last_seen < TIMESTAMP '2001-01-01' THEN 'closed' ELSE status END AS status FROM jobs""")
def close_missing(spark, sf):
    j = jobs(spark, sf)
    boards_ = j.filter(F.substring_index("id", ":", -1).cast("long") % 10 < 5).select("board_key")
    return merge.close_missing(j, boards_, F.lit("2001-01-01").cast("timestamp")).select("id", "status")


@query(f"""{WITH_JOBS} SELECT id, CAST(CAST(CASE WHEN source = 'lever' AND status = 'open' THEN {NOW_SQL} ELSE last_seen END AS DATE) AS STRING) AS last_seen FROM jobs""")
def touch_unchanged(spark, sf):
    j = jobs(spark, sf)
    return merge.touch(j, j.filter("source = 'lever'").select("board_key"), now()).select("id", day("last_seen"))


@query(f"""{WITH_JOBS} SELECT 'jobs' AS kind, id FROM jobs WHERE {_KEY} % 4 <> 1 UNION ALL
  SELECT 'quarantine', id FROM jobs WHERE {_KEY} % 4 = 1 OR ({_KEY} % 6 = 0 AND {_KEY} % 4 <> 2)""")
def quarantine_move(spark, sf):
    j = jobs(spark, sf).select("id")
    key = F.substring_index("id", ":", -1).cast("long")
    left, held = merge.move_to_quarantine(j, j.filter(key % 6 == 0), j.filter(key % 4 == 1), j.filter(key % 4 == 2))
    return left.select(F.lit("jobs").alias("kind"), "id").unionByName(held.select(F.lit("quarantine").alias("kind"), "id"))


_GONE = f"((status = 'open' AND first_seen < {NOW_SQL} - INTERVAL '14' DAY) OR (status = 'closed' AND first_seen < {NOW_SQL} - INTERVAL '3' DAY))"


@query(f"""{WITH_JOBS}, d AS (SELECT id, source, rank, CASE WHEN {_KEY} % 2 = 0 THEN first_seen + INTERVAL '2200' DAY ELSE first_seen END AS first_seen, status, coalesce(duplicate_of, id) AS cluster FROM jobs),
  b AS (SELECT cluster, arg_min(id, (rank, id)) AS best FROM d GROUP BY 1), s AS (SELECT id, source, rank, first_seen, status, CASE WHEN best <> id THEN best END AS duplicate_of FROM d JOIN b USING (cluster)),
  rest AS (SELECT * FROM s WHERE NOT {_GONE}),
  heirs AS (SELECT duplicate_of, arg_min(id, (rank, id)) AS heir FROM rest WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT id FROM rest) GROUP BY 1)
  SELECT 'job' AS kind, r.id, CASE WHEN h.heir IS NULL THEN r.duplicate_of WHEN h.heir <> r.id THEN h.heir END AS duplicate_of FROM rest r LEFT JOIN heirs h ON r.duplicate_of = h.duplicate_of
  UNION ALL SELECT 'tombstone', id, NULL FROM s WHERE {_GONE}""")
def purge_retention(spark, sf):
    j = jobs(spark, sf).select("id", "source", "rank", "status", "duplicate_of", "first_seen")
    j = j.withColumn("first_seen", F.when(F.substring_index("id", ":", -1).cast("long") % 2 == 0, F.col("first_seen") + F.expr("interval 2200 days")).otherwise(F.col("first_seen")))
    none = spark.createDataFrame([], "id string, source string, first_seen timestamp, purged_at timestamp")
    left, dead = merge.purge(j, none, now())
    return left.select(F.lit("job").alias("kind"), "id", "duplicate_of").unionByName(dead.select(F.lit("tombstone").alias("kind"), "id", F.lit(None).cast("string").alias("duplicate_of")))


@query(f"""{WITH_JOBS}, c AS (SELECT id, rank, coalesce(duplicate_of, id) AS cluster FROM jobs), b AS (SELECT cluster, arg_min(id, (rank, id)) AS best FROM c GROUP BY 1)
  SELECT c.id, CASE WHEN best <> c.id THEN best END AS duplicate_of FROM c JOIN b USING (cluster)""")
def reseat_links(spark, sf):
    return merge.reseat(jobs(spark, sf)).select("id", "duplicate_of")


@query("""WITH RECURSIVE l AS (SELECT s_suppkey AS id, s_suppkey - 1 - s_suppkey % 2 AS up FROM supplier WHERE s_suppkey % 100 > 2),
  w AS (SELECT id, up FROM l UNION ALL SELECT w.id, l.up FROM w JOIN l ON w.up = l.id)
  SELECT id, min(up) AS duplicate_of FROM w GROUP BY 1""")
def flatten_chains(spark, sf):
    s = F.col("s_suppkey")
    links = table(spark, sf, "supplier").filter(s % 100 > 2).select(s.alias("id"), (s - 1 - s % 2).alias("duplicate_of"))
    return merge.flatten_chains(links)


@query("""SELECT conv_id, turn, md5(w) AS said, length(w)::BIGINT AS n FROM (
  SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM conversations)""")
def carry_forward(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("said"))
    return merge.carry_forward(c, "conv_id", "turn", "said").select("conv_id", "turn", F.md5("said").alias("said"), F.length("said").cast("long").alias("n"))


@query(f"{WITH_JOBS} SELECT count(*) FILTER ({_KEY} % 3 = 0) AS added, count(*) FILTER ({_KEY} % 3 <> 0) AS updated FROM jobs WHERE {_KEY} % 2 = 0")
def change_counts(spark, sf):
    old, new, _ = _halves(spark, sf)
    return merge.change_counts(old, new)


# Entity resolution


_PARTS_JOBS = """
SELECT concat('s', CAST(p_partkey % 4 AS STRING), ':b', CAST(p_partkey % 40 AS STRING), ':', CAST(p_partkey AS STRING)) AS id, concat('s', CAST(p_partkey % 4 AS STRING)) AS source,
  concat('s', CAST(p_partkey % 4 AS STRING), ':b', CAST(p_partkey % 40 AS STRING)) AS board, CAST(p_partkey % 4 AS INT) AS rank,
  CASE WHEN p_partkey % 5 = 0 THEN concat('https://x.org/', CAST(p_partkey % 97 AS STRING)) ELSE '' END AS url, p_brand AS company_fold,
  CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'canada' END AS location, p_type AS title_key, CASE WHEN p_size % 2 = 0 THEN 'summer-2025' ELSE 'unknown' END AS term,
  CASE WHEN p_partkey % 2 = 0 THEN 'EN' ELSE 'FR' END AS language, CASE WHEN p_size < 3 THEN 'swe' ELSE '' END AS title_canonical
FROM part"""
_PAIRS_SQL = f"""
WITH j AS ({_PARTS_JOBS}), amb AS (SELECT source, url FROM j WHERE url <> '' GROUP BY 1, 2 HAVING count(*) > 1),
p AS (
  SELECT a.id AS a, b.id AS b,
    CASE WHEN a.url <> '' AND a.url = b.url AND a.url NOT IN (SELECT url FROM amb) THEN 0
      WHEN a.url <> '' AND a.url = b.url THEN NULL
      WHEN a.company_fold = b.company_fold AND a.location = 'canada' AND b.location = 'canada' AND a.title_key = b.title_key THEN 1
      WHEN a.company_fold = b.company_fold AND a.location = 'canada' AND b.location = 'canada' AND a.language <> b.language AND a.term = b.term AND a.term <> 'unknown' AND a.title_canonical = b.title_canonical AND a.title_canonical <> '' THEN 2 END AS r
  FROM j a JOIN j b ON a.board <> b.board AND (a.rank < b.rank OR (a.rank = b.rank AND a.id < b.id)) AND (a.url = b.url OR a.company_fold = b.company_fold))
SELECT a, b, ['url', 'same-language', 'cross-language'][r + 1] AS rule FROM p WHERE r IS NOT NULL"""


@query(_PAIRS_SQL)
def dedup_pairs(spark, sf):
    return dedup.candidate_pairs(view(spark, sf, _PARTS_JOBS))


@query("SELECT source, url FROM (" + _PARTS_JOBS + ") WHERE url <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_urls(spark, sf):
    return dedup.ambiguous_urls(view(spark, sf, _PARTS_JOBS))


@query()
def dedup_clusters(spark, sf):
    return dedup.clusters(view(spark, sf, _PARTS_JOBS))


# Scheduling, health and reports


@query(f"""WITH v AS ({VISITS}), d AS (SELECT source, CAST(ts AS DATE) AS run, count(*) AS stored FROM v WHERE failed = 0 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS rn FROM d),
  a AS (SELECT source, max(CASE WHEN rn = 1 THEN stored END) AS latest, median(CASE WHEN rn > 1 THEN stored END) AS m, count(*) - 1 AS samples FROM r GROUP BY 1)
  SELECT source, latest, CASE WHEN samples >= 3 THEN m ELSE 0.0 END::DOUBLE AS baseline, samples,
    CASE WHEN samples < 3 THEN 'unproven' WHEN m <= 0 THEN 'healthy' WHEN latest = 0 THEN 'collapsed' WHEN latest < m * 0.5 THEN 'dropped' ELSE 'healthy' END AS verdict FROM a""")
def volume_verdicts(spark, sf):
    runs = view(spark, sf, VISITS).filter("failed = 0").groupBy("source", F.to_date("ts").alias("run")).agg(F.count("*").alias("stored"))
    return schedule.volume_verdicts(runs)


@query("""WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)
  SELECT event_type, v[round_even(0.5 * (len(v) - 1), 0)::INT + 1] AS p50, v[round_even(0.95 * (len(v) - 1), 0)::INT + 1] AS p95, len(v)::BIGINT AS n FROM l""")
def latency_percentiles(spark, sf):
    return schedule.nearest_rank_by(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


_VISIT_STATE = f"""WITH v AS ({VISITS}), s AS (
  SELECT board, max(ts) AS last_attempt, max(CASE WHEN failed = 0 THEN ts END) AS last_success FROM v GROUP BY 1),
  f AS (SELECT s.board, last_attempt, last_success, count(v.board) AS failures FROM s LEFT JOIN v ON v.board = s.board AND v.failed = 1 AND (s.last_success IS NULL OR v.ts > s.last_success) GROUP BY 1, 2, 3)"""


@query(f"""{_VISIT_STATE} SELECT board, failures, CAST(CASE WHEN failures >= 3 THEN least(6 * pow(2, least(failures - 3, 8)), 168) END AS BIGINT) AS rest_hours,
  CASE WHEN failures > 0 THEN 'failing' WHEN last_success < TIMESTAMP '2024-01-29' THEN 'stale' ELSE 'healthy' END AS state FROM f""")
def visit_states(spark, sf):
    s = schedule.visit_runs(view(spark, sf, VISITS))
    state = F.when(F.col("failures") > 0, "failing").when(F.col("last_success") < F.lit("2024-01-29").cast("timestamp"), "stale").otherwise("healthy")
    return s.select("board", "failures", control.rest_hours(F.col("failures")).alias("rest_hours"), state.alias("state"))


@query(f"{_VISIT_STATE} SELECT board, failures FROM f ORDER BY last_success IS NOT NULL, last_success, board LIMIT 25")
def stalest_first(spark, sf):
    s = schedule.visit_runs(view(spark, sf, VISITS))
    return s.orderBy(F.col("last_success").asc_nulls_first(), "board").limit(25).select("board", "failures")


@query("""SELECT s_name FROM (SELECT s_name, CASE WHEN s_name > 'Supplier#000000060' THEN 0 ELSE 1 END AS lap FROM supplier) ORDER BY lap, s_name LIMIT 30""")
def rotation_slice(spark, sf):
    return schedule.rotate(table(spark, sf, "supplier").select("s_name"), "s_name", "Supplier#000000060", 30)


@query("""SELECT event_id, round(least(86400.0, 300.0 * pow(2.0, least(greatest(event_id % 20 - 5, 0), 16))), 3) AS block_s,
  CASE WHEN value > 5.25 AND greatest(5.0, value * 0.7) > 5.25 THEN round(greatest(5.0, value * 0.7), 6) END AS relaxed,
  round(least(10.0, greatest(0.25, value / 50) * 2), 6) AS tightened, least(2000, greatest(20, event_id % 500 * 3 + 10))::BIGINT AS ceiling FROM events""")
def control_math(spark, sf):
    v, n = F.col("value"), F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.round(control.block_seconds(n % 20), 3).alias("block_s"), F.round(control.decayed(v, F.lit(5.0)), 6).alias("relaxed"),
        F.round(control.tightened(v / 50), 6).alias("tightened"), control.request_ceiling(F.lit(20), n % 500, F.lit(3), F.lit(10)).cast("long").alias("ceiling"),
    )


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS demand FROM supplier),
  g AS (SELECT *, 1 + greatest(0, least(greatest(demand - 1, 0), 250 - (SELECT count(*) FROM s) - coalesce(sum(greatest(demand - 1, 0)) OVER (ORDER BY greatest(demand - 1, 0) DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got FROM s),
  t AS (SELECT *, greatest(0, 250 - (SELECT sum(got) FROM g)) AS rest FROM g)
  SELECT k, demand, CAST(got + greatest(0, least(greatest(3 - got, 0), rest - coalesce(sum(greatest(3 - got, 0)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted FROM t""")
def page_budgets(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7).alias("demand"))
    return schedule.page_budgets(s, 250, "k", "demand", least=1, top_up=3).select("k", "demand", F.col("granted").cast("long").alias("granted"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS postings, max(o_orderdate) AS seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
  SELECT c_custkey, postings, CASE WHEN c_custkey % 50 = 0 THEN 'unroutable' WHEN postings > 0 THEN 'producing' WHEN seen IS NULL THEN 'never-reached' WHEN c_custkey % 10 = 1 THEN 'failing'
    WHEN seen < TIMESTAMP '2001-08-02' - INTERVAL '30' DAY THEN 'stale' ELSE 'empty' END AS state FROM c""")
def coverage_states(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("postings"), F.max("o_orderdate").alias("seen"))
    c = table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    state = schedule.coverage_state(F.col("c_custkey") % 50 != 0, F.col("postings"), F.col("seen"), (F.col("c_custkey") % 10 == 1).cast("int"), F.col("seen"), now(), 30)
    return c.select("c_custkey", "postings", state.alias("state"))


_TOKS = "list_distinct(list_filter(string_split({f}, ' '), lambda t: t <> ''))"
#: Names of the register: what parts of two brands are, with their type, so that names like ``blue ring economy`` hold some.
_REGISTER = "SELECT DISTINCT concat_ws(' ', split_part(p_name, ' ', 2), p_type) AS name FROM part WHERE p_brand IN ('Brand#2', 'Brand#7')"


@query(f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part), nt AS (SELECT name, {_TOKS.format(f=fold_sql('name'))} AS toks FROM n),
  rr AS (SELECT {_TOKS.format(f=fold_sql('name'))} AS toks FROM ({_REGISTER}))
  SELECT name FROM nt n WHERE NOT EXISTS (SELECT 1 FROM rr WHERE (len(list_filter(n.toks, lambda x: NOT list_contains(rr.toks, x))) = 0 OR len(list_filter(rr.toks, lambda x: NOT list_contains(n.toks, x))) = 0)
    AND (len(list_filter(list_intersect(n.toks, rr.toks), lambda x: NOT list_contains({sql_list(text.GENERIC_TOKENS)}, x))) > 0 OR len(list_intersect(n.toks, rr.toks)) >= 2))""")
def unregistered_names(spark, sf):
    toks = F.array_distinct(text.tokens(text.fold(F.col("name"))))
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct().withColumn("toks", toks)
    return schedule.unregistered(names, view(spark, sf, _REGISTER).select(toks.alias("reg_toks"))).select("name")


@query(f"""WITH v AS ({VISITS}), r AS (SELECT source, CAST(ts AS DATE) AS d, count(*) AS n, sum(failed) AS bad FROM v GROUP BY 1, 2), newest AS (SELECT DISTINCT d FROM r ORDER BY d DESC LIMIT 5)
  SELECT CAST(d AS STRING) AS run, string_agg(source || ':' || n, ',' ORDER BY source) AS sources, sum(n)::BIGINT AS total,
    CASE WHEN sum(bad) = 0 THEN 'success' WHEN sum(bad) < sum(n) THEN 'partial' ELSE 'failed' END AS outcome FROM r WHERE d IN (SELECT d FROM newest) GROUP BY 1""")
def run_history(spark, sf):
    r = view(spark, sf, VISITS).groupBy("source", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("failed").alias("bad"))
    newest = r.select("d").distinct().orderBy(F.col("d").desc()).limit(5)
    runs = r.join(newest, "d", "left_semi").groupBy(F.date_format("d", "yyyy-MM-dd").alias("run"))
    said = F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(":"), F.col("n").cast("string")))), ",")
    out = runs.agg(said.alias("sources"), F.sum("n").alias("total"), F.sum("bad").alias("bad"))
    return out.select("run", "sources", "total", F.when(F.col("bad") == 0, "success").when(F.col("bad") < F.col("total"), "partial").otherwise("failed").alias("outcome"))


@query(f"""{WITH_JOBS}, v AS ({VISITS}), o AS (SELECT source, count(*) AS stored FROM jobs WHERE status = 'open' GROUP BY 1),
  f AS (SELECT CASE source WHEN 'click' THEN 'lever' WHEN 'view' THEN 'ashby' ELSE source END AS source, count(*) AS visits, sum(failed)::BIGINT AS failures FROM v GROUP BY 1)
  SELECT coalesce(o.source, f.source) AS source, coalesce(stored, 0) AS stored, coalesce(visits, 0) AS visits, coalesce(failures, 0) AS failures FROM o FULL JOIN f ON o.source = f.source""")
def doctor_sources(spark, sf):
    stored = jobs(spark, sf).filter("status = 'open'").groupBy("source").agg(F.count("*").alias("stored"))
    name = F.when(F.col("source") == "click", "lever").when(F.col("source") == "view", "ashby").otherwise(F.col("source"))
    seen = view(spark, sf, VISITS).groupBy(name.alias("source")).agg(F.count("*").alias("visits"), F.sum("failed").alias("failures"))
    return stored.join(seen, "source", "full_outer").fillna(0)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS missing, (event_id % 5)::STRING AS dotted, CASE WHEN event_type = 'view' THEN (event_id % 7)::STRING ELSE '' END AS viewed,
  (event_id % 7)::STRING AS second, event_id % 11 AS n, 2::BIGINT AS listed FROM events""")
def json_path(spark, sf):
    of = lambda n: (F.col("event_id") % n).cast("string")
    made = F.concat(F.lit('{"a": {"rows": [{"kind": "x.y", "v": '), of(5), F.lit('}, {"kind": "'), "event_type", F.lit('", "v": "'), of(7), F.lit('"}], "n": '), of(11), F.lit(', "t": true}, "p": '), "props", F.lit("}"))
    e = table(spark, sf, "events").select("event_id", made.alias("j"))
    j = F.col("j")
    return e.select(
        "event_id", custom.dig(j, "p.k").alias("k"), custom.dig(j, "a.missing.b").alias("missing"), custom.dig(j, "a.rows[kind=x.y].v").alias("dotted"), custom.dig(j, "a.rows[kind=view].v").alias("viewed"),
        custom.first_str(j, "a.t", "a.n", "a.rows.1.v").alias("second"), custom.first_int(j, "a.t", "a.rows", "a.n").alias("n"), custom.job_count(j, ["a.t"], ["a", "a.rows"]).alias("listed"),
    )


@query(rf"""SELECT c_custkey, CASE WHEN regexp_matches(x, '^[=+\-@]') THEN '''' || x ELSE x END AS cell, replace(x, '|', '\|') AS md FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-a|' || c_name ELSE c_name END AS x FROM customer)""")
def export_cells(spark, sf):
    x = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("-a|"), "c_name")).otherwise(F.concat(F.lit(" "), "c_name"))
    return table(spark, sf, "customer").select("c_custkey", export.csv_cell(x).alias("cell"), text.markdown_cell(x).alias("md"))


#: Documents as postings with all columns that a search weighs.
_FOUND = """SELECT doc_id AS id, coalesce(source, '') AS company, split_part(text, '.', 1) AS title_raw, lower(split_part(text, '.', 1)) AS title_normalized, coalesce(lang, '') AS title_canonical,
  concat('licence ', coalesce(lang, '')) AS location_raw, text AS description, TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(doc_id % 97 AS INT)) AS first_seen, doc_id % 3 <> 0 AS live FROM documents"""
_FOUND_SQL = _FOUND.replace("make_interval(0, 0, 0, CAST(doc_id % 97 AS INT))", "to_days(CAST(doc_id % 97 AS INT))")
#: The same rows; a text is read up to its first full stop, not split at all of them.
_FOUND_ROWS = _FOUND.replace("split_part(", "substring_index(")
_WEIGHED = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest(string_split({fold_sql(c)}, ' ')) AS t FROM p" for c, w in search.WEIGHTS.items())


_RANKED = f"""
WITH p AS ({_FOUND_SQL}), w AS (SELECT * FROM ({_WEIGHED}) WHERE t <> ''),
l AS (SELECT p.id, count(t) AS n FROM p LEFT JOIN w ON p.id = w.id GROUP BY 1), s AS (SELECT count(*) AS total, avg(n) AS mean FROM l),
f AS (SELECT id, q, sum(w)::DOUBLE AS f FROM w JOIN (VALUES ('lic'), ('the')) v(q) ON starts_with(t, q) GROUP BY 1, 2),
i AS (SELECT q, greatest(1e-6, ln(((SELECT total FROM s) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM f GROUP BY 1),
r AS (SELECT id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / (SELECT mean FROM s)))), 9) AS score FROM f JOIN i USING (q) JOIN l USING (id) GROUP BY 1 HAVING count(*) = 2)"""


@query(f"{_RANKED} SELECT id, score FROM r JOIN p USING (id) WHERE live ORDER BY score, first_seen DESC, id LIMIT 20")
def bm25_search(spark, sf):
    found = search.search(view(spark, sf, _FOUND_ROWS), "Lic thé", F.col("live"), 20)
    return found.select("id", F.round("score", 9).alias("score"))


@query(f"{_RANKED} SELECT id, score FROM r")
def index_search(spark, sf):
    """Documents in a stored index, in two commits: first with their titles for texts, then as they are, which replaces
    every one; what is found reads postings alone."""
    from gristmill.operators.index import Index
    from gristmill.operators.store import Store

    docs = view(spark, sf, _FOUND_ROWS).select(F.col("id").cast("string").alias("id"), *search.WEIGHTS)
    index = Index(Store(spark, f"{shared_folder(spark)}/index_search_{uuid.uuid4().hex}"))
    index.update(docs.withColumn("description", F.col("title_raw")))
    index.update(docs)
    found = index.scores(search.query_terms(spark, "Lic thé"))
    return found.select(F.col("id").cast("long").alias("id"), F.round("score", 9).alias("score"))


#: An event's number as the address of a host, in six spellings.
_ADDRESSES = ("concat('https://', CAST(n AS STRING), '/a')", "concat('https://', CAST(n DIV 16777216 AS STRING), '.', CAST(n % 16777216 AS STRING))",
    "concat('https://', CAST(n DIV 16777216 AS STRING), '.', CAST(n DIV 65536 % 256 AS STRING), '.', CAST(n DIV 256 % 256 AS STRING), '.', CAST(n % 256 AS STRING), ':443/')", "concat('https://0x', lower(hex(n)), '/')",
    "concat('https://[::ffff:', lower(hex(n DIV 65536)), ':', lower(hex(n % 65536)), ']/x')", "concat('https://0', conv(CAST(n AS STRING), 10, 8))")
_SPECIAL = "[(0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225480), (3221225483, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295)]"


@query(f"""WITH n AS (SELECT event_id, (event_id * 2654435761 + 3221225479) % 4294967296 AS wide, 3221225472 + event_id % 600 AS near FROM events), e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN near ELSE wide END AS n FROM n)
  SELECT event_id, len(list_filter({_SPECIAL}, lambda r: n BETWEEN r[1] AND r[2])) = 0 AS public FROM e""")
def public_addresses(spark, sf):
    n = "CASE WHEN event_id % 4 = 0 THEN 3221225472 + event_id % 600 ELSE (event_id * 2654435761 + 3221225479) % 4294967296 END"
    e = table(spark, sf, "events").select("event_id", F.expr(n).alias("n"))
    spelled = F.expr("CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ADDRESSES)) + " END")
    return e.select("event_id", urls.public_https_url(spelled).alias("public"))


@query("""SELECT user_id, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY 1""")
def stream_latest(spark, sf):
    """Events as a stream of files that come in no order, upserted batch by batch into the store: the greatest id stays."""
    from gristmill.operators.store import Store
    from gristmill.streaming.ingest import into_store

    root = f"{shared_folder(spark)}/stream_latest_{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    for i in (2, 0, 1):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    last = lambda b: b.select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("first_seen"), F.lit(None).cast("string").alias("duplicate_of"))
    store = Store(spark, f"{root}/db")
    into_store(stream, store, f"{root}/cp", last, "event_id").start().awaitTermination()
    return store.read("jobs").select(F.col("id").alias("user_id"), "event_id")
