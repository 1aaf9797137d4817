"""The engine end to end, entity resolution against brute force, maintenance to a fixpoint, streams."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gristmill.engine import Engine
from gristmill.operators import dedup, merge, planning, registry, reports, schedule
from gristmill.operators.filters import JobFilters, QuarantineFilters
from gristmill.operators.store import Store
from gristmill.plans import registry as plans
from gristmill.plans.adapters import view
from gristmill.streaming import ingest, state

SF = "/root/testdata/sf0.01"


def at(day, month=6):
    return datetime(2024, month, day)


def greedy(rows, pairs, incoming=None):
    """Pairs in order, one after another."""
    info = {r["id"]: r for r in rows}
    key = lambda i: (info[i]["rank"], i)
    cluster = {i: frozenset([i]) for i in info}

    def join(a, b):
        both = cluster[a] | cluster[b]
        for i in both:
            cluster[i] = both

    for r in rows:
        if r.get("duplicate_of") in info:
            join(r["id"], r["duplicate_of"])
    for a, b in sorted(pairs, key=lambda p: (key(p[0]), key(p[1]))):
        if incoming is not None and a not in incoming and b not in incoming or cluster[a] is cluster[b] or cluster[a] == cluster[b]:
            continue
        if any({info[i][k] for i in cluster[a]} & {info[i][k] for i in cluster[b]} for k in ("source", "board")):
            continue
        join(a, b)
    return {i: min(cluster[i], key=key) for i in info if min(cluster[i], key=key) != i}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_merge_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    n, sources = 60, 5
    rows = [{"id": f"s{s}:b{b}:{i}", "source": f"s{s}", "board": f"s{s}:b{b}", "rank": s} for i in range(n) for s, b in [(rng.randrange(sources), rng.randrange(3))]]
    ids = sorted(rows, key=lambda r: (r["rank"], r["id"]))
    pairs = sorted({(ids[a]["id"], ids[b]["id"]) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(150))})
    incoming = None if seed % 2 else set(rng.sample([r["id"] for r in rows], 20))
    for r in rows:
        r["duplicate_of"] = None
    if seed > 1:
        rows[3]["duplicate_of"], rows[9]["duplicate_of"] = rows[5]["id"], rows[3]["id"]
    jobs = spark.createDataFrame([tuple(r.values()) for r in rows], "id string, source string, board string, rank int, duplicate_of string")
    new = None if incoming is None else spark.createDataFrame([(i,) for i in incoming], "id string")
    got = {r["id"]: r["duplicate_of"] for r in dedup.resolve(jobs, spark.createDataFrame(pairs, "a string, b string"), new).collect()}
    assert got == greedy(rows, pairs, incoming)


def test_clusters_of_the_whole_table(spark):
    rows = [r.asDict() for r in view(spark, SF, plans._PARTS_JOBS).collect()]
    pairs = [(r["a"], r["b"]) for r in plans.QUERIES["dedup_pairs"](spark, SF).collect()]
    got = {r["id"]: r["duplicate_of"] for r in plans.QUERIES["dedup_clusters"](spark, SF).collect()}
    assert got == greedy(rows, pairs) and got


def test_first_listed_urls_decide_alone(spark):
    cols = "id string, source string, board string, rank int, url string, company_fold string, location string, title_key string, term string, language string, title_canonical string"
    base = ("acme", "canada", "dev intern", "unknown", "EN", "")
    rows = [("s0:b:1", "s0", "s0:b", 0, "u", *base), ("s0:b:2", "s0", "s0:b", 0, "u", *base), ("s1:b:1", "s1", "s1:b", 1, "u", *base), ("s2:b:1", "s2", "s2:b", 2, "v", *base)]
    got = {(r["a"], r["b"], r["rule"]) for r in dedup.candidate_pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("s0:b:1", "s2:b:1", "same-language"), ("s0:b:2", "s2:b:1", "same-language"), ("s1:b:1", "s2:b:1", "same-language")}


def postings(spark, rows):
    cols = "id string, source string, company string, title_raw string, description string, location_raw string, apply_url_raw string, category string, employment_type string, first_seen timestamp, last_seen timestamp"
    return spark.createDataFrame([(i, i.split(":")[0], c, t, "", "Toronto, ON", u, "", "", d, d) for i, c, t, u, d in rows], cols)


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    first = [("lever:a:1", "Acme", "Software Developer Intern", "https://acme.org/1", at(1)), ("lever:a:2", "Acme", "Data Intern", "", at(1)), ("lever:a:3", "Acme", "Senior Developer", "", at(1)), ("lever:b:1", "Bolt", "QA Intern", "", at(1))]
    counts = e.sync("lever", postings(spark, first), F.lit(at(1))).first().asDict()
    assert counts == {"source": "lever", "fetched": 4, "added": 3, "updated": 0, "closed": 0, "touched": 0, "quarantined": 1, "duplicates": 0, "stored": 3}
    # A feed tells of the same posting later; it follows the board's, and the list shows it once.
    counts = e.sync("themuse", postings(spark, [("themuse:x:9", "ACME", "Intern, Software Developer", "https://acme.org/1?utm=1", at(2))]), F.lit(at(2))).first()
    assert (counts["added"], counts["duplicates"]) == (1, 1)
    page, total = e.list_jobs(now=at(3))
    assert [r["id"] for r in page.collect()] == ["lever:a:1", "lever:a:2", "lever:b:1"] and total == 3
    assert e.list_jobs(now=at(25))[1] == 0 and e.list_jobs(JobFilters(role="data"), None)[1] == 1
    detail = e.get_posting("lever:a:1").first()
    assert [d["id"] for d in detail["duplicates"]] == ["themuse:x:9"] and e.get_posting("themuse:x:9").first()["canonical"]["id"] == "lever:a:1" and e.get_posting("none").count() == 0
    page, total = e.search("develop")
    assert [r["id"] for r in page.collect()] == ["lever:a:1"] and total == 1 and e.search("&")[1] == 0 and e.search("intern dat")[1] == 1
    page, total = e.list_quarantined(QuarantineFilters(reason="not-an-internship"))
    assert [(r["id"], r["matched_phrase"]) for r in page.collect()] == [("lever:a:3", "senior")] and total == 1
    # Board a answers whole and lacks 2; board b says that nothing changed; 3 is now an internship.
    boards = lambda *b: spark.createDataFrame([(x,) for x in b], "board_key string")
    again = [("lever:a:1", "Acme", "Software Developer Intern", "https://acme.org/1", at(4)), ("lever:a:3", "Acme", "Developer Intern", "", at(4))]
    counts = e.sync("lever", postings(spark, again), F.lit(at(4)), boards("lever:b"), boards("lever:a")).first()
    assert tuple(counts)[1:] == (2, 1, 1, 1, 1, 0, 1, 3)  # the stored link is found again
    seen = {r["id"]: (r["status"], r["first_seen"], r["last_seen"]) for r in e.table("jobs").collect()}
    assert seen["lever:a:2"] == ("closed", at(1), at(1)) and seen["lever:a:3"] == ("open", at(1), at(4)) and seen["lever:b:1"][2] == at(4) and e.table("quarantine").count() == 0
    before = sorted(map(tuple, e.table("jobs").collect()), key=str)
    e.sync("lever", postings(spark, again), F.lit(at(4)), boards("lever:b"), boards("lever:a"))
    assert sorted(map(tuple, e.table("jobs").collect()), key=str) == before
    # The canonical row expires and its duplicate takes its place; coming back, it keeps the date it was first seen.
    gone = e.purge(F.lit(datetime(2024, 6, 15, 12)))
    left = {r["id"]: r["duplicate_of"] for r in e.table("jobs").collect()}
    assert left == {"themuse:x:9": None} and gone["purged"] == 4 and e.table("tombstones").count() == 4
    e.sync("lever", postings(spark, [("lever:a:1", "Acme", "Software Developer Intern", "", at(20))]), F.lit(at(20)))
    assert {r["id"]: r["first_seen"] for r in e.table("jobs").collect()}["lever:a:1"] == at(1)
    health, findings, verdict = e.doctor(F.lit(at(21)))
    assert {r["source"]: r["stored"] for r in health.collect()} == {"lever": 1, "themuse": 1} and verdict.first()["healthy"]
    assert findings.filter("count > 0").count() == 0 and {r["value"]: r["n"] for r in e.stats().filter("facet = 'total'").collect()}["tombstones"] == 4
    e.record_run(spark.createDataFrame([(at(4), at(5), "success")], "started_at timestamp, finished_at timestamp, outcome string"), spark.createDataFrame([("lever", *([1] * 10), 1.0, 1.0, 1.0, 0, False, 5)], "source string, fetched long, added long, updated long, closed long, quarantined long, errors long, requests long, not_modified long, retries long, tightenings long, latency_p50_ms double, latency_p95_ms double, elapsed_ms double, deferred long, blocked boolean, stored long"))
    assert e.run_history().first()["sources"][0]["source"] == "lever" and e.last_sync_at() == at(5)
    e.export(str(tmp_path / "out"), "csv", JobFilters(status=None))
    assert e.clear(rate=True, validators=True) == {"rate_state": 0, "validators": 0}
    e.classify(spark.createDataFrame([("Zed", "feed-only", "n", at(1), None)], "company string, disposition string, note string, checked_on timestamp, url string"))
    rows, lacking, wrong = e.coverage(F.lit(at(25)))
    # The feed's row is by now a duplicate of the board's, and only canonical rows count.
    assert {r["company"] for r in lacking.collect()} == {"Acme"} and wrong.count() == 0 and rows.count() == 0
    with pytest.raises(ValueError):
        e.classify(spark.createDataFrame([("!!", "feed-only", "n", at(1), None)], "company string, disposition string, note string, checked_on timestamp, url string"))


def test_rescreen_reaches_a_fixpoint(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.sync("lever", postings(spark, [("lever:a:1", "Acme", "Software Developer Intern", "https://x.org/1", at(1)), ("lever:a:2", "Acme", "QA Intern", "", at(1)), ("lever:a:9", "Acme", "Barista Intern", "", at(1))]), F.lit(at(1)))
    e.sync("themuse", postings(spark, [("themuse:x:1", "Acme", "Software Developer Intern", "https://x.org/1", at(1))]), F.lit(at(1)))
    jobs, quarantine, tombstones = e.store.read_all("jobs", "quarantine", "tombstones")
    worse = jobs.withColumn("title_raw", F.when(F.col("id").isin("lever:a:1", "themuse:x:1"), "Senior Developer").otherwise(F.col("title_raw"))).withColumn("location", F.lit("usa"))
    held = quarantine.withColumn("title_raw", F.lit("Barista Software Intern"))
    new, q, done = merge.rescreen(worse, held, tombstones, F.lit(at(2)))
    assert done == {"examined": 2, "updated": 1, "quarantined": 2, "released": 1}
    assert {r["id"]: r["location"] for r in new.collect()} == {"lever:a:2": "canada", "lever:a:9": "canada"}
    assert {r["id"] for r in q.collect()} == {"lever:a:1", "themuse:x:1"}


def test_chains_end_and_rings_are_told(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "id long, duplicate_of long")
    assert {r["duplicate_of"] for r in merge.flatten_chains(links).collect()} == {0}
    with pytest.raises(RuntimeError):
        merge.flatten_chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, duplicate_of long"), 6)


def test_register(spark, tmp_path):
    rows = ['{"name":"A","platform":"lever","slug":"a","enabled":false,"paused_until":"2024-01-01"}', '{"name":"B","platform":"lever","slug":"dup"}', '{"name":"C","platform":"lever","slug":"DUP"}', '{"name":"","platform":"lever","slug":"x"}', '{"name":"D","platform":"ashby","slug":"d d"}', '{"name":"Éa","platform":"ashby","slug":"ok"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join(rows))
    good, bad = registry.read_registry(spark, str(tmp_path / "in"), F.lit("2024-02-01").cast("date"))
    assert {(r["name"], r["enabled"]) for r in good.collect()} == {("A", True), ("Éa", True)} and {r["why"] for r in bad.collect()} == {"board listed twice", "no name", "no usable slug"}
    registry.write_registry(good, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {"shard=a", "shard=e"}
    data = spark.createDataFrame([('{"rows":[{"name":"Acme","ats_links":"https://jobs.lever.co/acme","countries":["Canada"]},{"name":"Acme Canada","ats_links":["https://acmeca.bamboohr.com","x"]},{"name":"Acme Foods","ats_links":{"a":"https://jobs.lever.co/foods"}},{"name":"Bolt","ats_links":["https://jobs.lever.co/acme2"],"countries":"canada"},{"name":"Zip","ats_links":["https://jobs.lever.co/acme2"]},{"x":1}]}',)], "payload string")
    entries = registry.parse_dataset(data)
    assert {r["name"]: r["links"] for r in entries.collect()}["Acme Foods"] == ["https://jobs.lever.co/foods"]
    seeds = spark.createDataFrame([("Acme Inc.",), ("Bolt",), ("Zip",)], "name string")
    got, contested = registry.crossref(seeds, entries)
    assert {(r["entry"], r["label"], r["related"]) for r in got.collect()} == {("Acme", "lever/acme", False), ("Acme Canada", "bamboohr/acmeca", True)}
    assert [r["label"] for r in contested.collect()] == ["lever/acme2"]
    mined = registry.mine_country(entries, "CANADA", spark.createDataFrame([("lever/other",)], "label string"))
    assert {r["name"] for r in mined.collect()} == {"Acme", "Bolt"}
    told = registry.verify(good, spark.createDataFrame([("A", "rejected", "two\nlines"), ("Éa", "match", "")], "company string, verdict string, detail string"), F.lit("2024-02-03").cast("date"))
    assert {r["name"]: (r["enabled"], r["notes"]) for r in told.collect()} == {"A": (False, "2024-02-03: two"), "Éa": (True, None)}
    probed = spark.createDataFrame([(1, "N1", "lever", "n1", "match", 3), (2, "N1", "ashby", "other", "match", 3), (3, "N2", "lever", "N1", "match", 2), (4, "N3", "lever", "zero", "match", 0), (5, "N4", "ashby", "rev", "unverified", 4)], "at int, company string, platform string, slug string, verdict string, job_count long")
    adopted, review = registry.adopt(good, probed)
    assert [(r["company"], r["slug"]) for r in adopted.collect()] == [("N1", "n1")] and [r["slug"] for r in review.collect()] == ["rev"]


def test_one_run_at_a_time(spark, tmp_path):
    with planning.run_lock(spark, str(tmp_path / "db"), "one"):
        with pytest.raises(RuntimeError), planning.run_lock(spark, str(tmp_path / "db"), "two"):
            pass
    with planning.run_lock(spark, str(tmp_path / "db"), "three"):
        pass


def test_settled_rates(spark):
    old = spark.createDataFrame([("a", None, 2.0, 0), ("b", None, None, 4), ("c", at(1), None, 6)], "bucket string, blocked_until timestamp, min_interval_override double, consecutive_failures int")
    run = spark.createDataFrame([("a", 1.0, 2.0, 0, ""), ("b", 1.0, 1.0, 5, "429"), ("d", 1.0, 4.0, 0, "")], "bucket string, base_interval_s double, ended_interval_s double, failures int, reason string")
    got = {r["bucket"]: (r["blocked_until"], r["min_interval_override"], r["reason"]) for r in planning.settle(old, run, F.lit(at(1))).collect()}
    assert got == {"a": (None, 1.4, ""), "b": (datetime(2024, 6, 1, 0, 5), None, "429"), "c": (at(1), None, ""), "d": (None, 4.0, "")}


def test_percentiles_of_one_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [("one", 3.0), ("none", None), (None, 4.0)]
    got = {r["k"]: (r["p50"], r["p95"], r["n"]) for r in schedule.nearest_rank_by(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}).filter("k is not null").collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (hot[round(0.5 * 2999)], hot[round(0.95 * 2999)], 3000), "one": (3.0, 3.0, 1)}


def write_batches(spark, path, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)


def test_streamed_sync_keeps_first_seen(spark, tmp_path):
    store, names = Store(spark, str(tmp_path / "db")), "id string, source string, first_seen timestamp, last_seen timestamp"
    cols = "id string, source string, board_key string, rank int, company_fold string, url string, location string, title_key string, term string, language string, title_canonical string, status string, first_seen timestamp, last_seen timestamp, duplicate_of string"
    store.commit(jobs=spark.createDataFrame([], cols), quarantine=spark.createDataFrame([], names), tombstones=spark.createDataFrame([("lever:a:1", "lever", at(1), at(9))], "id string, source string, first_seen timestamp, purged_at timestamp"))
    row = lambda i, d: (i, "lever", "lever:a", 1, "", "", "unknown", "", "unknown", "EN", "", "open", d, d, None)
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame([row("lever:a:1", at(20)), row("lever:a:2", at(20))], cols), spark.createDataFrame([row("lever:a:2", at(21)), row("lever:a:3", at(21))], cols)])
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.sync_stream(stream, store, str(tmp_path / "cp"), lambda b: merge.Batch("lever", F.lit(at(21)), b), F.lit(at(22))).start().awaitTermination()
    assert {r["id"]: r["first_seen"] for r in store.read("jobs").collect()} == {"lever:a:2": at(20), "lever:a:3": at(21)}  # the first was 14 days old at once
    assert {r["id"]: r["first_seen"] for r in store.read("tombstones").collect()} == {"lever:a:1": at(1)} and store.read("counts").agg(F.sum("added")).first()[0] == 3


def run_to_end(stream, tmp_path, name):
    out = []
    stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return out


def test_crawls_resume_and_end(spark, tmp_path):
    schema = "board string, at timestamp, offset long, total long, ids array<string>, facet string, malformed boolean"
    ids = lambda a, n: [f"p{a + i}" for i in range(n)]
    one = [("x", at(1), 0, 50, ids(0, 20), "f", False), ("y", at(1), 0, 25, ids(0, 20), "f", False), ("z", at(1), 0, 90, ids(0, 20), "f", False)]
    two = [("x", at(2), 20, 50, ids(20, 20), "f", False), ("x", at(3), 40, 50, ids(40, 10), "f", False), ("y", at(2), 20, 26, ids(20, 5), "f", False), ("z", at(2), 0, 40, ids(0, 20), "g", False), ("z", at(3), 60, 40, ids(60, 20), "g", False)]
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame(b, schema) for b in (one, two)])
    got = run_to_end(state.crawls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), tmp_path, "cp")
    last = {r["board"]: (r["state"], r["next_offset"], r["seen"]) for r in got if r["id"] is None}
    assert last == {"x": ("complete", 0, 50), "y": ("discarded", 0, 0), "z": ("open", 20, 20)}
    assert sorted(r["id"] for r in got if r["id"]) == sorted(ids(0, 50))
    jobs = spark.createDataFrame([("p3", "open", at(1)), ("q", "open", at(1)), ("p4", "closed", at(1))], "id string, status string, last_seen timestamp")
    assert {r["id"]: r["last_seen"] for r in ingest.bump_seen(jobs, spark.createDataFrame(got, "board string, next_offset long, total long, seen long, state string, id string"), F.lit(at(2))).collect()} == {"p3": at(2), "q": at(1), "p4": at(1)}


def test_a_crawl_that_rests_expires(spark, tmp_path):
    schema = "board string, at timestamp, offset long, total long, ids array<string>, facet string, malformed boolean"
    page = lambda board, day, offset, n: (board, at(day), offset, 90, [f"{board}{offset + i}" for i in range(n)], "f", False)
    one, two, three = [page("a", 1, 0, 20), page("b", 1, 0, 20)], [page("b", 6, 20, 20)], [page("b", 12, 40, 20)]
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame(b, schema) for b in (one, two)])
    read = lambda: state.crawls(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = run_to_end(read(), tmp_path, "cp")
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame(three, schema)])
    got += run_to_end(read(), tmp_path, "cp")  # the query is started again where it stopped
    said = [(r["board"], r["state"], r["next_offset"], r["seen"]) for r in got]
    assert ("a", "expired", 0, 0) in said and ("b", "open", 60, 60) in said and not any(s[0] == "b" and s[1] == "expired" for s in said)


def test_breaker_relaxes_when_it_rests(spark, tmp_path):
    schema = "host string, bad boolean, ts timestamp"
    batches = [[("h", True, at(1)), ("h", True, at(1))], [("k", False, at(10))], [("k", False, at(18))], [("k", False, at(26))]]
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame(b, schema) for b in batches])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r["failures"], round(r["interval_s"], 3)) for r in run_to_end(state.breaker(stream, "host", "bad", base_s=0.25), tmp_path, "cp") if r["host"] == "h"]
    assert got[0] == (2, 1.0) and got[1:3] == [(0, 0.7), (0, 0.49)]


def test_breaker_and_changes_and_log(spark, tmp_path):
    schema = "host string, bad boolean, ts timestamp"
    write_batches(spark, str(tmp_path / "in"), [spark.createDataFrame([("h", True, at(i)) for i in range(1, 5)], schema), spark.createDataFrame([("h", True, at(5)), ("h", True, at(6)), ("k", False, at(1))], schema)])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["host"]: (r["failures"], r["block_s"]) for r in run_to_end(state.breaker(stream(), "host", "bad"), tmp_path, "cp")}
    assert got == {"h": (6, 600.0), "k": (0, 0.0)}
    ingest.event_log({"a": stream().select("host", "ts"), "b": stream()}, str(tmp_path / "log"), str(tmp_path / "cp2")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("source").count().count() == 2
    cols = "url string, etag string, last_modified string"
    told = ingest.changed_only(spark.createDataFrame([("u", "1", None), ("v", "2", None), ("w", None, "m"), ("x", None, None)], cols), spark.createDataFrame([("u", "1", None), ("v", "1", None), ("w", None, "m"), ("x", None, None)], cols))
    assert {r["url"] for r in told.collect()} == {"v", "x"}


def test_reports_say_why(spark):
    runs = spark.createDataFrame([(i,) for i in range(1, 7)], "run_id long")
    row = lambda s, i, n, d=0, b=False: (i, s, n, d, b)
    data = [row("drop", i, 10) for i in range(1, 6)] + [row("drop", 6, 4)] + [row("gone", i, 10) for i in range(1, 6)] + [row("gone", 6, 0)] + [row("blocked", i, 5, 0, True) for i in range(1, 7)] + [row("rot", i, 5, 2) for i in range(1, 7)] + [row("few", 5, 5), row("few", 6, 5)] + [row("zero", i, 0) for i in range(1, 7)] + [row("unrec", 6, -1)]
    got = {r["source"]: (r["verdict"], r["detail"]) for r in reports.volume(spark.createDataFrame(data, "run_id long, source string, stored long, deferred long, blocked boolean"), runs).collect()}
    assert {k: v[0] for k, v in got.items()} == {"drop": "dropped", "gone": "collapsed", "blocked": "unproven", "rot": "unproven", "few": "unproven", "zero": "healthy", "unrec": "unproven"}
    assert got["drop"][1] == "stores 4 against a median of 10" and got["blocked"][1].startswith("every run was blocked") and got["rot"][1].startswith("every run deferred") and got["few"][1] == "1 comparable run(s), 3 needed" and got["unrec"][1].startswith("no run has")
