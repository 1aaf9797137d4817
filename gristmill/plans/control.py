"""Registered queries of filters, maintenance, reports, planning and the register, over whole tables, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gristmill.functions import classify
from gristmill.operators import dedup, filters, merge, planning, registry, reports
from gristmill.sources import custom, html

from .adapters import JOBS, NOW, table, view
from .registry import fold_sql, now, query

NOW_SQL = f"TIMESTAMP '{NOW}'"
WITH_JOBS = f"WITH jobs AS ({JOBS})"

#: Closed orders as the quarantine, some with a reason that tells of internships; some are also among the postings.
QUARANTINE = f"""SELECT id, source, company, concat('t ', role) AS title_raw,
  CASE CAST(floor(price) AS INT) % 4 WHEN 0 THEN 'not-a-cs-role' WHEN 1 THEN 'unknown-cs-role' WHEN 2 THEN 'not-an-internship' ELSE 'out-of-scope-degree' END AS reason,
  first_seen, last_seen, concat('https://x.org/', place) AS apply_url_raw, place AS location_raw, location, CAST(NULL AS STRING) AS remote_scope, '' AS matched_phrase FROM ({JOBS}) WHERE status = 'closed'"""
#: Tombstones of every third order, a month before or after it was seen.
TOMBSTONES = f"SELECT id, source, first_seen + CASE WHEN CAST(floor(price) AS INT) % 2 = 0 THEN INTERVAL '30' DAY ELSE INTERVAL '-30' DAY END AS first_seen, TIMESTAMP '2001-01-01' AS purged_at FROM ({JOBS}) WHERE CAST(floor(price) AS INT) % 3 = 0"
#: Events as runs of 500, each kind of event a source.
RUN_SOURCES = """SELECT CAST(floor(event_id / 500.0) AS BIGINT) AS run_id, event_type AS source,
  CASE WHEN event_type = 'signup' AND max(event_id) > 5500 THEN 0 WHEN event_type = 'view' AND max(event_id) % 7 = 0 THEN -1 ELSE count(*) END AS stored, count(*) AS fetched, count(*) AS added, CAST(0 AS BIGINT) AS updated,
  CAST(0 AS BIGINT) AS closed, CAST(0 AS BIGINT) AS quarantined, CASE WHEN max(event_id) % 5 = 0 THEN 1 ELSE 0 END AS errors, sum(event_id % 3) AS requests, sum(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) AS not_modified, 0 AS tightenings,
  min(value) AS latency_p50_ms, max(value) AS latency_p95_ms, CASE WHEN min(event_id) % 6 = 0 OR event_type = 'click' THEN 2 ELSE 0 END AS deferred, event_type = 'error' OR min(event_id) % 11 = 0 AS blocked FROM events GROUP BY 1, 2"""
VISITED = """SELECT event_type AS source, CAST(user_id AS STRING) AS board, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS label, max(ts) AS last_attempt_at,
  max(CASE WHEN event_id % 5 < 2 THEN ts END) AS last_success_at, CASE WHEN max(event_id) % 4 = 0 THEN 3 ELSE 0 END AS consecutive_failures FROM events GROUP BY event_type, user_id"""
#: Customers as companies of the register.
COMPANIES = """SELECT c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'workday' END AS platform, concat('b', CAST(c_custkey AS STRING)) AS slug, c_custkey % 4 <> 0 AS enabled, '' AS fmt,
  CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE concat(CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'themuse' END, ':b', CAST(c_custkey % 50 AS STRING)) END AS board, concat('k', CAST(c_custkey AS STRING)) AS registry_key,
  CASE WHEN c_custkey % 8 = 0 THEN DATE '2001-07-01' WHEN c_custkey % 8 = 4 THEN DATE '2002-01-01' END AS recheck_after FROM customer"""


# Filters, joins and lists


@query(f"""WITH q AS ({QUARANTINE}) SELECT id, reason, CAST(CAST(first_seen AS DATE) AS STRING) AS seen FROM q WHERE reason = 'not-a-cs-role' AND source = 'lever' ORDER BY first_seen DESC, id LIMIT 50""")
def quarantine_list(spark, sf):
    q = filters.list_quarantined(view(spark, sf, QUARANTINE), filters.QuarantineFilters("not-a-cs-role", "lever"))
    return q.select("id", "reason", F.date_format("first_seen", "yyyy-MM-dd").alias("seen"))


@query(f"""{WITH_JOBS} SELECT id FROM jobs WHERE duplicate_of IS NULL AND status = 'open' AND location IN ('unknown', 'remote') AND language = 'bilingual' AND source = 'ashby' AND first_seen >= {NOW_SQL} - INTERVAL '700' DAY ORDER BY first_seen DESC, id LIMIT 40""")
def filtered_list(spark, sf):
    wanted = filters.JobFilters(location="unknown", language="bilingual", source="ashby", limit=40).within(700, datetime.fromisoformat(NOW))
    return filters.list_jobs(view(spark, sf, JOBS), wanted).select("id")


@query(f"""{WITH_JOBS}, j AS (SELECT *, CASE WHEN price > 200000 THEN '' ELSE 'x' END AS description, CASE WHEN CAST(floor(price) AS INT) % 2 = 0 THEN 'unknown' ELSE 'summer-2024' END AS term FROM jobs),
  d AS (SELECT id, CAST(floor(price) AS INT) % 3 <> 0 AS failed, CAST(floor(price) AS INT) % 5 AS attempts FROM jobs WHERE CAST(floor(price) AS INT) % 7 < 4)
  SELECT id FROM j LEFT JOIN d USING (id) WHERE source = 'lever' AND description = '' AND term = 'unknown' AND (failed IS NULL OR (failed AND attempts < 3)) ORDER BY first_seen DESC, id LIMIT 100""")
def detail_queue(spark, sf):
    j = view(spark, sf, JOBS)
    made = j.withColumn("description", F.when(F.col("price") > 200000, "").otherwise("x")).withColumn("term", F.expr("CASE WHEN CAST(floor(price) AS INT) % 2 = 0 THEN 'unknown' ELSE 'summer-2024' END"))
    d = j.filter("CAST(floor(price) AS INT) % 7 < 4").selectExpr("id", "CAST(floor(price) AS INT) % 3 <> 0 AS failed", "CAST(floor(price) AS INT) % 5 AS attempts")
    return filters.detail_queue(made, d, "lever", 100)


@query(f"""WITH v AS ({VISITED}) SELECT source, board FROM v WHERE NOT coalesce(last_success_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '48' HOUR, false)
  AND NOT coalesce(consecutive_failures >= 3 AND TIMESTAMP '2024-01-31 00:00:00' < last_attempt_at + INTERVAL '6' HOUR, false)""")
def due_boards(spark, sf):
    v = view(spark, sf, VISITED).withColumn("board", F.concat_ws("/", "source", "board"))
    due = filters.due(v.select("source", "board"), v, F.lit("2024-01-31").cast("timestamp"), 48)
    return due.select("source", F.substring_index("board", "/", -1).alias("board"))


@query(f"""{WITH_JOBS} SELECT j.id, array_to_string(list_sort(list(d.source || ' ' || d.id)), ',') AS duplicates FROM jobs j JOIN jobs d ON d.duplicate_of = j.id WHERE j.source = 'lever' GROUP BY 1""")
def duplicates_listed(spark, sf):
    j = view(spark, sf, JOBS)
    led = j.filter("duplicate_of is not null").select(F.col("duplicate_of").alias("id"), F.concat_ws(" ", "source", "id").alias("d"))
    return j.filter("source = 'lever'").select("id").join(led, "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("d")), ",").alias("duplicates"))


@query(f"""{WITH_JOBS}, w AS (SELECT DISTINCT company FROM jobs WHERE price > 100000), u AS (SELECT 0 AS prio, company, 'https://y.org/' || board_key AS url, last_seen FROM jobs WHERE duplicate_of IS NULL AND status = 'open'
    UNION ALL SELECT 1, company, apply_url_raw, last_seen FROM ({QUARANTINE})),
  b AS (SELECT company, url, min((prio, -epoch(last_seen), url)) AS turn FROM u WHERE company IN (SELECT company FROM w) GROUP BY 1, 2)
  SELECT company, CAST(place AS INT) AS place, url FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY turn) AS place FROM b) WHERE place <= 5""")
def apply_urls(spark, sf):
    j = view(spark, sf, JOBS).withColumn("apply_url_raw", F.concat(F.lit("https://y.org/"), "board_key"))
    return reports.apply_urls(j, view(spark, sf, QUARANTINE), j.filter("price > 100000").select("company").distinct())


# Maintenance


@query(f"""{WITH_JOBS}, q AS ({QUARANTINE}), t AS ({TOMBSTONES})
  SELECT 'dangling duplicate links' AS "check", count(*) AS "count" FROM jobs a LEFT JOIN jobs b ON a.duplicate_of = b.id WHERE a.duplicate_of IS NOT NULL AND b.id IS NULL
  UNION ALL SELECT 'duplicate chains', count(*) FROM jobs a JOIN jobs b ON a.duplicate_of = b.id WHERE b.duplicate_of IS NOT NULL
  UNION ALL SELECT 'same-source merges', count(*) FROM jobs a JOIN jobs b ON a.duplicate_of = b.id WHERE a.source = b.source
  UNION ALL SELECT 'postings in both tables', count(*) FROM jobs JOIN q USING (id)
  UNION ALL SELECT 'tombstoned rows re-ingested as new', count(*) FROM jobs j JOIN t USING (id) WHERE j.first_seen > t.first_seen
  UNION ALL SELECT 'open postings with no first_seen', count(*) FROM jobs WHERE first_seen IS NULL""")
def integrity_findings(spark, sf):
    return merge.integrity_findings(view(spark, sf, JOBS), view(spark, sf, QUARANTINE), view(spark, sf, TOMBSTONES))


_LINKED = f"""SELECT id, source, first_seen, CASE WHEN CAST(floor(price) AS INT) % 11 = 0 THEN 'gone' WHEN CAST(floor(price) AS INT) % 5 = 0 THEN concat(source, substr(coalesce(duplicate_of, id), instr(coalesce(duplicate_of, id), ':'))) ELSE duplicate_of END AS duplicate_of FROM ({JOBS})"""


@query(f"""WITH j AS ({_LINKED}), t AS ({TOMBSTONES}), s AS (SELECT a.id, CASE WHEN b.id IS NOT NULL AND a.source <> b.source THEN b.id END AS up FROM j a LEFT JOIN j b ON a.duplicate_of = b.id),
  e AS (SELECT s.id, CASE WHEN p.up IS NOT NULL THEN p.up ELSE s.up END AS up FROM s LEFT JOIN s p ON s.up = p.id)
  SELECT j.id, e.up AS duplicate_of, CAST(CAST(least(j.first_seen, coalesce(t.first_seen, j.first_seen)) AS DATE) AS STRING) AS first_seen FROM j JOIN e USING (id) LEFT JOIN t USING (id)""")
def repair_links(spark, sf):
    fixed = merge.repair(view(spark, sf, _LINKED), view(spark, sf, TOMBSTONES))
    return fixed.select("id", "duplicate_of", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


_KEY = "CAST(split_part(id, ':', 3) AS BIGINT)"


@query(f"""{WITH_JOBS}, left_ AS (SELECT * FROM jobs WHERE {_KEY} % 4 <> 1), h AS (SELECT duplicate_of, arg_min(id, (rank, id)) AS heir FROM left_ WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT id FROM left_) GROUP BY 1)
  SELECT l.id, CASE WHEN h.heir IS NULL THEN l.duplicate_of WHEN h.heir <> l.id THEN h.heir END AS duplicate_of FROM left_ l LEFT JOIN h ON l.duplicate_of = h.duplicate_of""")
def quarantine_promotes(spark, sf):
    j = view(spark, sf, JOBS)
    left, _ = merge.move_to_quarantine(j, j.limit(0), j.filter(f"{_KEY} % 4 = 1"), j.limit(0))
    return left.select("id", "duplicate_of")


@query(f"""{WITH_JOBS} SELECT id, CASE WHEN source = 'themuse' AND status = 'open' AND last_seen < TIMESTAMP '2000-01-01' THEN 'closed' ELSE status END AS status FROM jobs""")
def close_feed(spark, sf):
    return merge.close_source(view(spark, sf, JOBS), "themuse", F.lit("2000-01-01").cast("timestamp")).select("id", "status")


#: Stored postings and a run of one source over half of them and as many new ones, some of which are rejected.
_STORED = f"""SELECT id, source, board_key, rank, company AS company_fold, '' AS url, location, role AS title_key, 'unknown' AS term, language, '' AS title_canonical, status, first_seen, last_seen, duplicate_of FROM ({JOBS}) WHERE {_KEY} % 3 <> 0"""
_COMES = f"""SELECT id, source, board_key, rank, company AS company_fold, '' AS url, location, role AS title_key, 'unknown' AS term, language, '' AS title_canonical, 'open' AS status, {NOW_SQL} AS first_seen, {NOW_SQL} AS last_seen,
  CAST(NULL AS STRING) AS duplicate_of FROM ({JOBS}) WHERE source = 'lever' AND {_KEY} % 2 = 0"""
_SYNC_SQL = f"""WITH stored AS ({_STORED}), comes AS ({_COMES}),
  good AS (SELECT * FROM comes WHERE {_KEY} % 5 <> 0), bad AS (SELECT * FROM comes WHERE {_KEY} % 5 = 0),
  kept AS (SELECT coalesce(s.id, g.id) AS id, coalesce(s.source, g.source) AS source, coalesce(s.board_key, g.board_key) AS board, CASE WHEN g.id IS NULL THEN s.status ELSE 'open' END AS status,
    CASE WHEN g.id IS NULL THEN s.last_seen ELSE {NOW_SQL} END AS last_seen FROM stored s FULL JOIN good g USING (id) WHERE coalesce(s.id, g.id) NOT IN (SELECT id FROM bad)),
  done AS (SELECT *, source = 'lever' AND status = 'open' AND board = 'lever:b3' AS touched, source = 'lever' AND status = 'open' AND board <> 'lever:b3' AND board IN ('lever:b0', 'lever:b9', 'lever:b12', 'ashby:b1') AND last_seen < {NOW_SQL} AS gone FROM kept)"""


@query(f"""{_SYNC_SQL} SELECT 'lever' AS source, (SELECT count(*) FROM comes) AS fetched, (SELECT count(*) FROM good WHERE id NOT IN (SELECT id FROM stored)) AS added, (SELECT count(*) FROM good WHERE id IN (SELECT id FROM stored)) AS updated,
  count(*) FILTER (gone) AS closed, count(*) FILTER (touched) AS touched, (SELECT count(*) FROM bad) AS quarantined, count(*) FILTER (source = 'lever' AND status = 'open' AND NOT gone) AS stored FROM done""")
def sync_counts(spark, sf):
    return _synced(spark, sf)[2].drop("duplicates")


@query(f"""{_SYNC_SQL} SELECT id, CASE WHEN gone THEN 'closed' ELSE status END AS status, CAST(CAST(CASE WHEN touched THEN {NOW_SQL} ELSE last_seen END AS DATE) AS STRING) AS last_seen FROM done""")
def sync_batch(spark, sf):
    return _synced(spark, sf)[0].select("id", "status", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


def _synced(spark, sf):
    stored, comes = view(spark, sf, _STORED), view(spark, sf, _COMES)
    none = view(spark, sf, QUARANTINE).limit(0).select("id", "source", "first_seen", "last_seen")
    boards = lambda *b: spark.createDataFrame([(x,) for x in b], "board_key string")
    bad = comes.filter(f"{_KEY} % 5 = 0").select(*none.columns)
    batch = merge.Batch("lever", now(), comes.filter(f"{_KEY} % 5 <> 0"), bad, boards("lever:b3"), boards("lever:b0", "lever:b9", "lever:b12", "ashby:b1"), resolve=False)
    return merge.apply_batch(stored, none, none.select("id", "source", "first_seen"), batch)


_LINKS = "SELECT concat('a:x:', CAST(s_suppkey AS STRING)) AS id, concat('b:y:', CAST(s_suppkey - s_suppkey % 4 AS STRING)) AS duplicate_of FROM supplier WHERE s_suppkey % 4 IN (1, 2)"
_HELD = """SELECT concat('a:x:', CAST(s_suppkey AS STRING)) AS id, CASE WHEN s_suppkey % 8 = 3 THEN 'b:y:77' WHEN s_suppkey % 4 = 0 THEN concat('a:x:', CAST(s_suppkey + 1 AS STRING)) END AS duplicate_of, s_suppkey % 3 = 0 AS new FROM supplier
  UNION ALL SELECT concat('b:y:', CAST(s_suppkey AS STRING)), CASE WHEN s_suppkey % 2 = 0 THEN 'a:x:1' END, false FROM supplier"""


@query(f"""WITH h AS ({_HELD}), l AS ({_LINKS}), n AS (SELECT h.id, CASE WHEN h.id IN (SELECT duplicate_of FROM l) THEN NULL WHEN l.duplicate_of IS NOT NULL THEN l.duplicate_of WHEN new THEN NULL ELSE h.duplicate_of END AS up FROM h LEFT JOIN l ON h.id = l.id)
  SELECT n.id, CASE WHEN l.duplicate_of IS NOT NULL AND l.duplicate_of <> n.id THEN l.duplicate_of ELSE n.up END AS duplicate_of FROM n LEFT JOIN l ON n.up = l.id""")
def written_links(spark, sf):
    h = view(spark, sf, _HELD)
    return dedup.write_links(h.select("id", "duplicate_of"), h.filter("new").select("id"), view(spark, sf, _LINKS))


@query("""WITH o AS (SELECT user_id AS k, max(ts) AS b, min(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT user_id AS k, max(ts) AS b, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
  SELECT 'u' || coalesce(n.k, o.k) AS bucket, CAST(greatest(n.b, o.b) AS STRING) AS blocked_until, CASE WHEN n.k IS NOT NULL AND (o.b IS NULL OR n.b >= o.b) THEN 'new' ELSE 'old' END AS reason,
    CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS min_interval_override FROM o FULL JOIN n ON o.k = n.k""")
def rate_states(spark, sf):
    e = table(spark, sf, "events")
    side = lambda kind, said, v: e.filter(F.col("event_type") == kind).groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("bucket")).agg(F.max("ts").alias("blocked_until"), v("value").alias("min_interval_override")).withColumn("reason", F.lit(said))
    return merge.rate_states(side("view", "old", F.min), side("click", "new", F.max)).withColumn("blocked_until", F.col("blocked_until").cast("string"))


# Reports


@query(f"""WITH r AS ({RUN_SOURCES}), recent AS (SELECT * FROM r WHERE run_id IN (SELECT DISTINCT run_id FROM r ORDER BY 1 DESC LIMIT 12)), c AS (SELECT *, stored > -1 AND deferred = 0 AND NOT blocked AS counts FROM recent),
  p AS (SELECT *, CASE WHEN counts THEN row_number() OVER (PARTITION BY source, counts ORDER BY run_id DESC) END AS place FROM c),
  a AS (SELECT source, coalesce(max(stored) FILTER (place = 1), -1) AS latest, median(stored) FILTER (place > 1) AS m, greatest(count(place) - 1, 0) AS samples, count(place) AS n, bool_or(blocked) AS bl, bool_or(deferred > 0) AS de FROM p GROUP BY 1)
  SELECT source, latest, CASE WHEN samples >= 3 THEN m ELSE 0 END::DOUBLE AS baseline, samples, CASE WHEN samples < 3 THEN 'unproven' WHEN m <= 0 THEN 'healthy' WHEN latest = 0 THEN 'collapsed' WHEN latest < m * 0.5 THEN 'dropped' ELSE 'healthy' END AS verdict,
    CASE WHEN n = 0 AND bl THEN 'every run was blocked, which is a throttle not a drop' WHEN n = 0 AND de THEN 'every run deferred members, so rotation explains it' WHEN n = 0 THEN 'no run has recorded a stored count yet'
      WHEN samples < 3 THEN samples || ' comparable run(s), 3 needed' WHEN m <= 0 THEN 'has never stored anything' WHEN latest = 0 THEN 'stores nothing after a median of ' || CAST(round(m, 0) AS BIGINT) || ' across ' || samples || ' runs'
      WHEN latest < m * 0.5 THEN 'stores ' || latest || ' against a median of ' || CAST(round(m, 0) AS BIGINT) ELSE '' END AS detail FROM a""")
def volume_reasons(spark, sf):
    r = view(spark, sf, RUN_SOURCES)
    return reports.volume(r, r.select("run_id").distinct(), 12)


@query(f"""{WITH_JOBS}, r AS ({RUN_SOURCES}), v AS ({VISITED}), s AS (SELECT source, count(*) AS stored FROM jobs WHERE status = 'open' GROUP BY 1),
  l AS (SELECT source, arg_max(requests, run_id) AS requests, arg_max(errors, run_id) AS errors, arg_max(blocked, run_id) AS blocked FROM r GROUP BY 1),
  b AS (SELECT source, count(*) AS boards, count(*) FILTER (last_success_at IS NULL OR consecutive_failures > 0) AS failing, count(*) FILTER (last_success_at IS NOT NULL AND consecutive_failures = 0 AND last_success_at < TIMESTAMP '2024-01-31' - INTERVAL '14' DAY) AS stale FROM v GROUP BY 1)
  SELECT source, coalesce(stored, 0) AS stored, coalesce(requests, 0)::BIGINT AS requests, coalesce(errors, 0)::BIGINT AS errors, coalesce(blocked, false) AS blocked, coalesce(boards, 0) AS boards, coalesce(failing, 0) AS failing, coalesce(stale, 0) AS stale,
    CASE WHEN boards > 0 THEN round((boards - failing) / boards, 9) END AS success_rate FROM s FULL JOIN l USING (source) FULL JOIN b USING (source)""")
def source_health(spark, sf):
    r = view(spark, sf, RUN_SOURCES)
    h = reports.source_health(view(spark, sf, JOBS), view(spark, sf, VISITED), r.select("run_id").distinct(), r, F.lit("2024-01-31").cast("timestamp"), history=1000)
    return h.select("source", "stored", F.col("requests").cast("long").alias("requests"), F.col("errors").cast("long").alias("errors"), "blocked", "boards", "failing", "stale", F.round("success_rate", 9).alias("success_rate"))


@query(f"""WITH c AS ({COMPANIES}), d AS (SELECT count(*) AS n FROM c WHERE NOT enabled AND recheck_after <= DATE '2001-08-02')
  SELECT 2 AS problems, 1 AS alerts, 1 AS blocks, 7 + (SELECT n FROM d) AS warnings, false AS healthy""")
def health_verdict(spark, sf):
    health = spark.createDataFrame([("a", "dropped", 3, 1), ("b", "healthy", 0, 3), ("c", "unproven", 0, 0)], "source string, verdict string, failing long, stale long")
    findings = spark.createDataFrame([("x", 4), ("y", 0), ("z", 1)], "check string, count long")
    rate = spark.createDataFrame([("p", datetime(2001, 8, 3)), ("q", datetime(2001, 8, 1)), ("r", None)], "bucket string, blocked_until timestamp")
    v = reports.verdict(health, findings, rate, view(spark, sf, COMPANIES), now())
    return v.select(*[F.col(c).cast("long").alias(c) if c != "healthy" else c for c in v.columns])


_FACETED = f"SELECT *, 'unknown' AS term, CASE WHEN price > 200000 THEN 'phd' ELSE 'unknown' END AS degree_requirement FROM ({JOBS})"
_BUCKETS = "CASE location WHEN 'other' THEN 'international' WHEN 'remote' THEN 'unknown' ELSE location END"


@query(f"""WITH j AS ({_FACETED}), q AS ({QUARANTINE}), t AS ({TOMBSTONES}), c AS (SELECT * FROM j WHERE duplicate_of IS NULL)
  SELECT 'source' AS facet, source AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'location', {_BUCKETS}, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'role', role, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'term', term, count(*) FROM c GROUP BY ALL
  UNION ALL SELECT 'language', language, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'degree_requirement', degree_requirement, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'quarantined', reason, count(*) FROM q GROUP BY ALL
  UNION ALL SELECT 'total', 'jobs', count(*) FROM c UNION ALL SELECT 'total', 'duplicates', count(duplicate_of) FROM j UNION ALL SELECT 'total', 'tombstones', count(*) FROM t UNION ALL SELECT 'total', 'cached urls', count(*) FROM pages""")
def statistics(spark, sf):
    return reports.statistics(view(spark, sf, _FACETED), view(spark, sf, QUARANTINE), view(spark, sf, TOMBSTONES), table(spark, sf, "pages"))


@query(f"""{WITH_JOBS}, c AS ({COMPANIES}), n AS (SELECT board_key AS board, count(*) AS postings FROM jobs WHERE status = 'open' AND price > 490000 GROUP BY 1), v AS (SELECT 'lever:b' || board AS board, max(last_attempt_at) AS a, max(last_success_at) AS s, max(consecutive_failures) AS f FROM ({VISITED}) GROUP BY 1)
  SELECT name AS company, platform, c.board, CASE WHEN c.board IS NULL THEN 'unroutable' WHEN coalesce(postings, 0) > 0 THEN 'producing' WHEN a IS NULL THEN 'never-reached' WHEN s IS NULL OR f > 0 THEN 'failing' WHEN s < TIMESTAMP '2024-02-05' - INTERVAL '14' DAY THEN 'stale' ELSE 'empty' END AS state,
    coalesce(postings, 0) AS postings FROM c LEFT JOIN n ON c.board = n.board LEFT JOIN v ON c.board = v.board WHERE enabled""")
def coverage_rows(spark, sf):
    v = view(spark, sf, VISITED).groupBy(F.concat(F.lit("lever:b"), "board").alias("board")).agg(F.max("last_attempt_at").alias("last_attempt_at"), F.max("last_success_at").alias("last_success_at"), F.max("consecutive_failures").alias("consecutive_failures"))
    rows = reports.coverage_rows(view(spark, sf, COMPANIES), view(spark, sf, JOBS).filter("price > 490000"), v, F.lit("2024-02-05").cast("timestamp"))
    return rows.select("company", "platform", "board", "state", "postings")


_REVIEWS = "SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat('Customer#', lpad(CAST(s_suppkey AS STRING), 9, '0')) ELSE concat(s_name, '!') END AS company, 'feed-only' AS disposition, 'seen' AS note, TIMESTAMP '2001-06-01' + CASE WHEN s_suppkey % 3 = 0 THEN INTERVAL '50' DAY ELSE INTERVAL '0' DAY END AS checked_on, CAST(NULL AS STRING) AS url FROM supplier"


@query(f"""WITH r AS ({_REVIEWS}), c AS ({COMPANIES}), m AS (SELECT r.*, c.enabled, c.platform, date_diff('day', checked_on, {NOW_SQL}) AS age FROM r LEFT JOIN c ON {fold_sql('r.company')} = {fold_sql('c.name')})
  SELECT company, disposition, contradiction FROM (SELECT *, CASE WHEN enabled THEN 'the registry now polls it on ' || platform WHEN platform IS NOT NULL THEN 'a disabled ' || platform || ' row exists for it' WHEN age >= 30 THEN 'the verdict is ' || age || ' days old and nothing has re-derived it' END AS contradiction FROM m)
  WHERE contradiction IS NOT NULL""")
def contradicted_reviews(spark, sf):
    return reports.contradicted(view(spark, sf, _REVIEWS), view(spark, sf, COMPANIES), now())


@query(f"""WITH r AS ({RUN_SOURCES}), s AS (SELECT run_id, sum(requests)::BIGINT AS requests, sum(added)::BIGINT AS added, count(*) FILTER (errors = 0 AND NOT blocked AND deferred = 0) AS good, count(*) FILTER (errors > 0) AS failed, count(*) FILTER (blocked) AS b, count(*) FILTER (deferred > 0) AS d FROM r GROUP BY 1)
  SELECT run_id, requests, added, CASE WHEN good = 0 AND failed + b > 0 THEN 'failure' WHEN failed + b + d > 0 THEN 'partial' ELSE 'success' END AS outcome,
    concat_ws('; ', CASE WHEN failed > 0 THEN failed || ' source(s) failed' END, CASE WHEN b > 0 THEN b || ' source(s) blocked' END, CASE WHEN d > 0 THEN d || ' source(s) stopped on their host budget' END) AS partial_reason FROM s""")
def run_totals(spark, sf):
    return reports.run_totals(view(spark, sf, RUN_SOURCES)).select("run_id", F.col("requests").cast("long").alias("requests"), F.col("added").cast("long").alias("added"), "outcome", "partial_reason")


@query(f"""WITH r AS ({RUN_SOURCES}) SELECT source, string_agg(stored || '/' || deferred || '/' || blocked, ',' ORDER BY run_id DESC) AS history FROM r WHERE run_id IN (SELECT DISTINCT run_id FROM r ORDER BY 1 DESC LIMIT 6) GROUP BY 1""")
def volume_history(spark, sf):
    r = view(spark, sf, RUN_SOURCES)
    h = reports.volume_history(r, r.select("run_id").distinct(), 6)
    return h.select("source", F.array_join(F.transform("history", lambda x: F.concat_ws("/", x["stored"].cast("string"), x["deferred"].cast("string"), x["blocked"].cast("string"))), ",").alias("history"))


@query(f"""WITH r AS ({RUN_SOURCES}), n AS (SELECT DISTINCT run_id FROM r ORDER BY 1 DESC LIMIT 16) SELECT source, sum(requests)::BIGINT AS spent FROM r WHERE run_id IN (SELECT run_id FROM n) AND run_id >= 6 GROUP BY 1""")
def spent_today(spark, sf):
    r = view(spark, sf, RUN_SOURCES)
    runs = r.select("run_id").distinct().withColumn("started_at", F.timestamp_seconds(F.col("run_id") * 3600))
    return reports.spent_since(r, runs, F.timestamp_seconds(F.lit(6 * 3600))).select("source", F.col("spent").cast("long").alias("spent"))


# Planning


_MEMBERS = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'themuse' END AS source, concat('h', CAST(c_custkey % 5 AS STRING)) AS bucket, concat('b', CAST(c_custkey AS STRING)) AS board,
  CASE c_custkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'workday' ELSE 'paginated' END AS default_profile, CASE WHEN c_custkey % 97 = 5 THEN 'moderate' WHEN c_custkey = 16 THEN 'conservative' END AS profile,
  CASE c_custkey % 3 WHEN 1 THEN 60 ELSE 0 END AS reserve, CAST(c_custkey % 4 AS BIGINT) AS page_budget, CASE c_custkey % 3 WHEN 1 THEN 60 ELSE 0 END AS detail_budget FROM customer"""
_PROFILE_SQL = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in planning.PROFILES.items())


@query(f"""WITH m AS ({_MEMBERS}), f(profile, c, i, r, h, b) AS (VALUES {_PROFILE_SQL}), a AS (SELECT source, default_profile AS profile FROM m UNION SELECT source, profile FROM m WHERE profile IS NOT NULL),
  s AS (SELECT source, min(c) AS c, max(i) AS i, min(r) AS r, max(h) AS h, min(b) AS b FROM a JOIN f USING (profile) GROUP BY 1), z AS (SELECT source, count(DISTINCT board) AS n, max(reserve) AS v FROM m GROUP BY 1),
  u AS (SELECT source, c, i, least(2000, greatest(r, n * b + v)) AS r, h, b FROM s JOIN z USING (source))
  SELECT bucket, min(c)::INT AS concurrency, max(i)::DOUBLE AS min_interval_s, min(r)::INT AS max_requests, max(h)::DOUBLE AS refresh_h, min(b)::INT AS per_board FROM u JOIN (SELECT DISTINCT source, bucket FROM m) USING (source) GROUP BY 1""")
def source_postures(spark, sf):
    return planning.source_postures(view(spark, sf, _MEMBERS))


@query(f"""WITH m AS ({_MEMBERS}), d AS (SELECT source, min(bucket) AS bucket, max(detail_budget) AS detail FROM m GROUP BY 1), e AS (SELECT bucket, sum(detail) AS detail FROM d GROUP BY 1), s AS (SELECT bucket, count(*) AS planned, sum(page_budget) AS pages, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM m GROUP BY 1)
  SELECT bucket, sources, planned, (pages + coalesce(detail, 0))::BIGINT AS worst_case, CASE WHEN bucket = 'h1' THEN 300 ELSE 500 END AS ceiling, pages + coalesce(detail, 0) > CASE WHEN bucket = 'h1' THEN 300 ELSE 500 END AS exceeded FROM s LEFT JOIN e USING (bucket)""")
def bucket_plans(spark, sf):
    known = spark.createDataFrame([(f"h{i}", 500) for i in (0, 2, 3, 4)], "bucket string, max_requests int")
    p = planning.bucket_plans(view(spark, sf, _MEMBERS), known)
    return p.select("bucket", F.array_join("sources", ",").alias("sources"), "planned", F.col("worst_case").cast("long").alias("worst_case"), "ceiling", "exceeded")


_ANSWERS = "SELECT concat('b', CAST(user_id % 20 AS STRING)) AS bucket, concat('h', CAST(CASE WHEN user_id % 20 < 5 THEN 0 ELSE event_id % 3 END AS STRING)) AS host, CASE WHEN event_type = 'error' AND event_id % 3 <> 1 AND user_id % 4 <> 1 THEN 403 WHEN event_type = 'error' AND event_id % 3 = 0 THEN 401 ELSE 200 END AS status FROM events"


@query(f"""WITH a AS ({_ANSWERS}), b AS (SELECT bucket, count(DISTINCT host) AS hosts, count(DISTINCT CASE WHEN status IN (401, 403) THEN host END) AS r FROM a GROUP BY 1) SELECT bucket, 1800 AS defer_s FROM b WHERE r >= 2 OR (hosts = 1 AND r = 1)""")
def denied_buckets(spark, sf):
    return planning.denied(view(spark, sf, _ANSWERS))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END AS status, event_id % 4 + 1 AS attempt, CASE WHEN event_id % 5 = 0 THEN value END AS wait FROM events)
  SELECT event_id, CASE WHEN (status IS NULL OR status = 429 OR status BETWEEN 500 AND 599) AND attempt < 3 THEN coalesce(wait, CAST(pow(2, attempt - 1) AS DOUBLE)) END AS wait_s FROM e""")
def retry_waits(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.expr("CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END"))
    return e.select("event_id", planning.retry(F.col("status"), (F.col("event_id") % 4 + 1).cast("int"), F.when(F.col("event_id") % 5 == 0, F.col("value"))).alias("wait_s"))


@query("""SELECT page_id, regexp_matches(url, '^https://[^/]*\\.example\\.(com|net)(/|$)') AND regexp_extract(url, '^https://([^/?#]*)', 1) IN (SELECT DISTINCT regexp_extract(url, '^https://([^/?#]*)', 1) FROM pages WHERE page_id % 2 = 0) AS allowed,
  CASE WHEN page_id % 3 = 0 THEN 'unchanged' ELSE 'full' END AS expected FROM pages WHERE regexp_matches(url, '^https?://[^/]*\\.example\\.(com|net)')""")
def planned_requests(spark, sf):
    p = table(spark, sf, "pages").filter(F.col("url").rlike(r"^https?://[^/]*\.example\.(com|net)"))
    hosts = [r[0] for r in p.filter("page_id % 2 = 0").select(F.regexp_extract("url", "^https://([^/?#]*)", 1)).distinct().collect() if r[0]]  # as an adapter names them
    known = p.filter("page_id % 3 = 0").select("url", F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified")).dropDuplicates(["url"])
    told = planning.dry_run(p.select("page_id", "url"), known)
    return told.select("page_id", planning.allowed(F.col("url"), hosts).alias("allowed"), F.when(F.col("page_id") % 3 == 0, F.col("expected")).otherwise("full").alias("expected"))


@query(f"""WITH c AS ({COMPANIES}) SELECT platform, min(registry_key) AS registry_key FROM c WHERE enabled AND platform <> 'workday' GROUP BY 1""")
def canary_probes(spark, sf):
    return planning.probes(view(spark, sf, COMPANIES)).select("platform", "registry_key")


_OFFERED = "SELECT concat('t', CAST(p_partkey % 40 AS STRING)) AS tenant, 's' AS site, CASE p_partkey % 3 WHEN 0 THEN 'workerSubType' WHEN 1 THEN 'jobFamily' ELSE 'other' END AS parameter, concat('f', CAST(p_partkey AS STRING)) AS facet_id, CASE WHEN p_size % 5 = 0 THEN concat('Intern (', p_type, ')') WHEN p_size % 5 = 1 THEN 'Internal Audit Intern' ELSE p_name END AS descriptor FROM part"


@query(f"""WITH o AS ({_OFFERED}), m AS (SELECT *, CASE parameter WHEN 'workerSubType' THEN 1 WHEN 'jobFamily' THEN 2 END AS turn FROM o WHERE descriptor LIKE 'Intern (%'), b AS (SELECT tenant, min(turn) AS turn FROM m WHERE turn IS NOT NULL GROUP BY 1)
  SELECT tenant, parameter, string_agg(facet_id, ' ' ORDER BY facet_id) AS facet_ids FROM m JOIN b USING (tenant, turn) GROUP BY ALL""")
def facet_choice(spark, sf):
    f = planning.resolve_facets(view(spark, sf, _OFFERED), ["intern", "internship"], ["workerSubType", "jobFamily"], ["internal audit"])
    return f.select("tenant", "parameter", F.array_join("facet_ids", " ").alias("facet_ids"))


# The register


_APPLIED = "SELECT concat('co', CAST(o_custkey % 300 AS STRING)) AS company, CASE o_orderkey % 4 WHEN 0 THEN concat('https://jobs.lever.co/x', CAST(o_orderkey % 50 AS STRING)) WHEN 1 THEN concat('https://x', CAST(o_orderkey % 40 AS STRING), '.bamboohr.com/jobs') WHEN 2 THEN concat('https://boards.greenhouse.io/g', CAST(o_orderkey % 30 AS STRING)) ELSE 'https://example.org/' END AS url FROM orders WHERE o_orderkey % 3 <> 0"


@query(f"""WITH a AS ({_APPLIED}), p AS (SELECT company, CASE WHEN url LIKE '%lever%' THEN 2 WHEN url LIKE '%greenhouse%' THEN 1 WHEN url LIKE '%bamboohr%' THEN 3 END AS turn,
    coalesce(nullif(regexp_extract(url, 'lever\\.co/(.*)$', 1), ''), nullif(regexp_extract(url, 'greenhouse\\.io/(.*)$', 1), ''), regexp_extract(url, '//([^.]*)\\.', 1)) AS slug FROM a)
  SELECT company, ['greenhouse', 'lever', 'bamboohr'][turn] AS platform, min(slug) AS slug FROM p WHERE turn IS NOT NULL GROUP BY company, turn QUALIFY row_number() OVER (PARTITION BY company ORDER BY turn) = 1""")
def direct_boards(spark, sf):
    return registry.direct_boards(view(spark, sf, _APPLIED), ["greenhouse", "lever", "bamboohr"])


@query("""SELECT s_suppkey, CASE WHEN c IS NULL THEN 'miss' WHEN c = 0 THEN 'empty' WHEN c < lo OR c > hi THEN 'rejected' WHEN board = '' THEN 'unverified' WHEN board LIKE 'Other%' THEN 'rejected' ELSE 'match' END AS verdict FROM (
  SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 5 * 100 END AS c, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 END AS lo, CASE s_suppkey % 3 WHEN 0 THEN 300 WHEN 1 THEN 3000 END AS hi,
    CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Other Firm' ELSE 'Acme Robotics Inc.' END AS board FROM supplier)""")
def probe_verdicts(spark, sf):
    k = F.col("s_suppkey")
    size = F.when(k % 3 == 0, "startup").when(k % 3 == 1, "mid")
    board = F.when(k % 4 == 0, "").when(k % 4 == 1, "Other Firm").otherwise("Acme Robotics Inc.")
    v = registry.probe_verdict(F.lit("Acme Robotics"), board, F.when(k % 6 != 0, k % 5 * 100), size)
    return table(spark, sf, "supplier").select("s_suppkey", v["verdict"].alias("verdict"))


@query("""SELECT p_partkey, p_size % 5 < 3 AND NOT (p_size % 5 = 0) AS division FROM part""")
def divisions(spark, sf):
    more = F.element_at(F.array(*map(F.lit, ("", " Canada", " Digital Services", " Blue Rings", " Canada Foods"))), (F.col("p_size") % 5 + 1).cast("int"))
    parent = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Works Ltd"))
    name = F.concat(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Works")), more, F.lit(" Inc."))
    return table(spark, sf, "part").select("p_partkey", registry.is_division(parent, name).alias("division"))


_PROBED = "SELECT o_orderkey AS at, concat('Co ', CAST(o_custkey % 200 AS STRING)) AS company, CASE o_orderkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS platform, concat('S', CAST(o_orderkey % 120 AS STRING)) AS slug, CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'unverified' ELSE 'rejected' END AS verdict, CAST(o_orderkey % 4 AS BIGINT) AS job_count FROM orders WHERE o_orderkey < 1000"


@query(f"""WITH p AS (SELECT *, platform || '/' || lower(slug) AS k FROM ({_PROBED})), n AS (SELECT * FROM p WHERE verdict = 'unverified' AND job_count > 0 AND k NOT IN ('lever/s4', 'ashby/s7'))
  SELECT platform, slug, arg_min(company, "at") AS company, arg_min(job_count, "at") AS job_count FROM n GROUP BY 1, 2""")
def adoption_review(spark, sf):
    known = spark.createDataFrame([("Co 3", "lever", "S4"), ("Co 9", "ashby", "s7")], "name string, platform string, slug string")
    return registry.adopt(known, view(spark, sf, _PROBED))[1].select("company", "platform", "slug", "job_count")


# Readers


_WALKED = "SELECT concat('u', CAST(user_id AS STRING)) AS board, CAST(event_id AS INT) AS page, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN array('a') ELSE array(concat('x', CAST(event_id % 9 AS STRING)), concat('y', CAST(event_id AS STRING))) END AS marks FROM events"


@query("""WITH RECURSIVE p AS (SELECT 'u' || user_id AS board, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ['a'] ELSE ['x' || (event_id % 9), 'y' || event_id] END AS marks FROM events),
  w AS (SELECT board, turn, marks, len(coalesce(marks, [])) AS n, CASE WHEN marks IS NULL THEN 'unchanged' WHEN len(marks) < 2 THEN 'short' END AS why FROM p WHERE turn = 1
    UNION ALL SELECT p.board, p.turn, list_concat(w.marks, p.marks), w.n + len(coalesce(p.marks, [])), CASE WHEN p.marks IS NULL THEN 'unchanged' WHEN list_has_all(w.marks, p.marks) THEN 'repeated' WHEN len(p.marks) < 2 THEN 'short' WHEN w.n + len(p.marks) > 12 THEN 'cap' END FROM w JOIN p ON p.board = w.board AND p.turn = w.turn + 1 WHERE w.why IS NULL)
  SELECT board, coalesce(max(why), 'open') AS why, count(*) FILTER (why IS NULL OR why IN ('short', 'cap')) AS kept FROM w GROUP BY 1""")
def page_walks(spark, sf):
    kept, ends = custom.walk_pages(view(spark, sf, _WALKED), 2, 12)
    return ends.select("board", "why").join(kept.groupBy("board").agg(F.count("*").alias("kept")), "board", "left").fillna(0, ["kept"])


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS href, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS said FROM pages),
  i AS (SELECT *, unnest(range(len(href))) AS i FROM l) SELECT page_id, i AS place, replace(replace(href[i + 1], '&quot;', '"'), '&amp;', '&') AS link, trim(replace(replace(said[i + 1], '&quot;', '"'), '&amp;', '&')) AS said FROM i""")
def html_list(spark, sf):
    rows = html.html_rows(table(spark, sf, "pages").select("page_id", "html"), "nav ul li", {"link": "a::attr(href)", "said": "a"}, payload_col="html")
    return rows.select("page_id", F.col("at").cast("long").alias("place"), "link", "said")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS loc FROM pages), t AS (SELECT page_id, loc, regexp_extract(loc, '([^/]*)$', 1) AS tail FROM u)
  SELECT page_id, loc, tail AS id, string_split(loc, '/')[-2] AS path2 FROM t""")
def sitemap_paths(spark, sf):
    loc = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<urlset><url><loc>"), loc, F.lit("</loc></url></urlset>")).alias("payload"))
    m = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return custom.sitemap_rows(p).select("page_id", m("loc"), m("id"), m("path2"))


@query(f"""SELECT doc_id, {fold_sql("coalesce(source, '')")} AS c, CASE WHEN regexp_matches({fold_sql("coalesce(source, '')")}, '^[a-z]') THEN left({fold_sql("coalesce(source, '')")}, 1) ELSE 'other' END AS shard FROM documents""")
def registry_shards(spark, sf):
    s = F.coalesce("source", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", classify.fold(s).alias("c"), registry.shard(s).alias("shard"))

