"""The stored index against a rebuild and against search over the texts; the engine's search on it."""

import random
import re
from collections import defaultdict
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.engine import Answers, Engine
from gristmill.operators import index as stored
from gristmill.operators import search
from gristmill.operators.filters import JobFilters
from gristmill.operators.index import Index
from gristmill.operators.store import Store

COLUMNS = list(search.WEIGHTS)
SCHEMA = "id string, " + ", ".join(f"{c} string" for c in COLUMNS)
WORDS = ["data", "dater", "Développeur", "développement", "dev", "the", "stagiaire", "intern", "intern", "a1", "zebra", "Zürich", "c++"]


def rows_of(rng, ids):
    said = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return {i: (said(3) or None, said(5), said(5), "", said(3), said(30)) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame([(i, *texts) for i, texts in docs.items()], SCHEMA)


def plain(rows):
    return {r["id"]: round(r["score"], 9) for r in rows.collect()}


def test_ten_changes_equal_a_rebuild(spark, tmp_path):
    rng, docs = random.Random(4), {}
    index = Index(Store(spark, str(tmp_path / "db")))
    for turn in range(10):
        changed = rows_of(rng, [f"j{rng.randrange(30)}" for _ in range(12)]) | {i: docs[i] for i in list(docs)[:2]}
        gone = [i for i in docs if rng.random() < 0.1 and i not in changed]
        docs = {i: t for i, t in docs.items() if i not in gone} | changed
        index.update(frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "id string"))
        if turn in (4, 9):
            for query in ("dev the", "data", "stag", "zeb intern", "nothing", "é"):
                terms = search.query_terms(spark, query)
                assert plain(index.scores(terms)) == plain(search.bm25(frame(spark, docs), terms)), (turn, query)
    anew = Index(Store(spark, str(tmp_path / "anew")))
    anew.update(frame(spark, docs))
    held = lambda x: sorted((r["token"], r["id"], r["weight"], r["words"]) for r in x.live(x.store.versions()).collect())
    assert held(index) == held(anew) and held(anew)
    facts = index._facts(index.store.versions())
    assert facts["documents"] == len(docs) and facts["segments"] - facts["oldest"] < 8


def test_unchanged_texts_add_no_postings_and_ranges_prune(spark, tmp_path):
    docs = rows_of(random.Random(1), [f"j{i}" for i in range(50)])
    index = Index(Store(spark, str(tmp_path / "db")))
    index.update(frame(spark, docs))
    before = index.live(index.store.versions()).count()
    index.update(frame(spark, docs))
    assert index.live(index.store.versions()).count() == before and index._facts(index.store.versions())["documents"] == 50
    only = index.live(index.store.versions(), {"z"}, (F.col("token") >= "z") & (F.col("token") < "z{"))
    assert only.inputFiles() and all("head=z" in f for f in only.inputFiles())
    assert "GreaterThanOrEqual(token,z)" in only._jdf.queryExecution().toString()
    assert index.scores([]).count() == 0 and Index(Store(spark, str(tmp_path / "none"))).scores(["a"]).count() == 0


def test_words_are_counted_before_they_are_dealt_out(spark, tmp_path):
    index = Index(Store(spark, str(tmp_path / "db")))
    plan = index.delta(frame(spark, rows_of(random.Random(2), ["a", "b"]))).append["postings"][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan and "HashAggregate" not in plan


def test_blocks_count_every_word_of_every_row(monkeypatch):
    rng, factors = random.Random(6), [2.0, 1.0]
    pieces = ["ab", "a", "é", " ", "  ", "-", "B", "9", "漢字", "zz9"]
    texts = [["".join(rng.choice(pieces) for _ in range(rng.choice((0, 0, 1, 5, 40)))) for _ in range(60)] for _ in factors]
    ids, marks = [f"d{i}" for i in range(60)], list(range(60))
    every = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks, pa.int64()), *map(pa.array, texts)], ["id", "mark", "t0", "t1"])
    wanted, words = defaultdict(float), {}
    for i, *row in zip(ids, *texts, strict=True):
        said = [(t, w) for text, w in zip(row, factors, strict=True) for t in re.findall("[0-9a-z]+", text)]
        words[i] = len(said)
        for t, w in said:
            wanted[t, i] += w
    for most, cuts in ((1, [0, 60]), (200, [0, 7, 31, 60]), (1 << 20, [0, 60]), (1 << 20, [0, 1, 1, 60])):
        monkeypatch.setattr(stored, "BLOCK_BYTES", most)
        rows = [r for b in stored._blocks(factors)(every.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)) for r in b.to_pylist()]
        docs = [d for r in rows if r["token"] is None for d in zip(r["ids"], r["words"], r["marks"], strict=True)]
        assert docs == [(i, words[i], m) for i, m in zip(ids, marks, strict=True)]
        held = [(r["token"], i, w, n) for r in rows if r["token"] is not None for i, w, n in zip(r["ids"], r["weights"], r["words"], strict=True)]
        assert sorted(held) == sorted((t, i, w, words[i]) for (t, i), w in wanted.items())
        assert max(len(r["ids"]) for r in rows if r["token"] is not None) <= stored.RUN


def test_large_batches_of_small_blocks_equal_search_over_texts(spark, tmp_path):
    docs = rows_of(random.Random(9), [f"j{i}" for i in range(40)]) | {"none": (None,) * 6, "empty": ("",) * 6}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = Index(Store(spark, str(tmp_path / "db")))
        index.update(frame(spark, docs))
        terms = search.query_terms(spark, "dev the")
        assert plain(index.scores(terms)) == plain(search.bm25(frame(spark, docs), terms))
        assert index._facts(index.store.versions())["documents"] == 42
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def at(day):
    return datetime(2024, 6, day)


def postings(spark, rows):
    cols = "id string, source string, company string, title_raw string, description string, location_raw string, apply_url_raw string, category string, employment_type string, first_seen timestamp, last_seen timestamp"
    return spark.createDataFrame([(i, i.split(":")[0], "Acme", t, d, "Toronto, ON", "", "", "", at(day), at(day)) for i, t, d, day in rows], cols)


def test_engine_keeps_index_visits_and_runs_in_one_commit(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    board = lambda *rows: spark.createDataFrame(rows, "source string, board string, label string, at timestamp, succeeded boolean, error string")
    fetched = spark.createDataFrame([("https://a/1", "lever", "e1", None, at(1)), ("https://a/2", "lever", None, None, at(1)), ("https://a/3", "lever", "e3", None, at(1))], "url string, source string, etag string, last_modified string, fetched_at timestamp")
    run = spark.createDataFrame([(at(1), at(1), "success")], "started_at timestamp, finished_at timestamp, outcome string")
    told = spark.createDataFrame([("lever", *([1] * 10), 1.0, 1.0, 1.0, 0, False, 2)], "source string, fetched long, added long, updated long, closed long, quarantined long, errors long, requests long, not_modified long, retries long, tightenings long, latency_p50_ms double, latency_p95_ms double, elapsed_ms double, deferred long, blocked boolean, stored long")
    first = Answers(
        visits=board(("lever", "lever:a", "Acme", at(1), True, None), ("lever", "lever:b", "Bolt", at(1), False, "timeout")), fetched=fetched,
        degraded=spark.createDataFrame([("https://a/3",)], "url string"), details=spark.createDataFrame([("lever:a:1", "lever", at(1), True, False)], "id string, source string, fetched_at timestamp, resolved boolean, failed boolean"),
        facets=spark.createDataFrame([("t", "s", "jobFamily", ["f1"], "Intern", at(1), False), ("u", "s", "jobFamily", ["f2"], "Intern", at(1), True)], "tenant string, site string, parameter string, facet_ids array<string>, descriptor string, resolved_at timestamp, pinned boolean"),
        crawls=spark.createDataFrame([("wd:x", 40, 90, "jobFamily", ["f1"])], "board string, next_offset long, total long, facet_parameter string, facet_ids array<string>"),
        run=run, sources=told,
    )
    commits = e.store.last()
    e.sync("lever", postings(spark, [("lever:a:1", "Software Developer Intern", "we use sparkling water", 1), ("lever:a:2", "Data Intern", "tables", 1)]), F.lit(at(1)), answers=first)
    assert e.store.last() == commits + 1
    assert {r["url"] for r in e.table("validators").collect()} == {"https://a/1"}
    assert e.load_facets("t", "s").first()["facet_ids"] == ["f1"] and e.load_facets("u", "s").count() == 0
    assert e.load_crawls().first().asDict() == {"board": "wd:x", "next_offset": 40, "total": 90, "facet_parameter": "jobFamily", "facet_ids": ["f1"], "stored": 0}
    page, total = e.search("spark")
    assert [r["id"] for r in page.collect()] == ["lever:a:1"] and total == 1 and "description" in page.columns
    assert "description" not in e.index.scores(["spark"])._jdf.queryExecution().toString()
    # The second run changes a text, asks board b again with success, ends the crawl and tries the details again.
    second = Answers(
        visits=board(("lever", "lever:b", None, at(2), True, None), ("lever", "lever:a", None, at(2), False, "403")), ended=spark.createDataFrame([("wd:x",)], "board string"),
        details=spark.createDataFrame([("lever:a:1", "lever", at(2), True, False)], "id string, source string, fetched_at timestamp, resolved boolean, failed boolean"), forgotten=spark.createDataFrame([("t", "s")], "tenant string, site string"),
    )
    e.sync("lever", postings(spark, [("lever:a:1", "Software Developer Intern", "we use still water", 2)]), F.lit(at(2)), answers=second)
    assert e.search("spark")[1] == 0 and e.search("still wat")[1] == 1 and e.search("intern", JobFilters(role="data"))[1] == 1
    seen = {r["board"]: (r["label"], r["last_success_at"], r["consecutive_failures"], r["last_error"]) for r in e.table("visits").collect()}
    assert seen == {"lever:a": ("Acme", at(1), 1, "403"), "lever:b": ("Bolt", at(2), 0, None)}
    assert e.table("detail_fetches").first()["attempts"] == 2 and e.load_crawls().count() == 0 and e.load_facets("t", "s").count() == 0
    health, _, verdict = e.doctor(F.lit(at(3)))
    told = {r["source"]: (r["stored"], r["boards"], r["failing"]) for r in health.collect()}
    assert told == {"lever": (2, 2, 1)} and verdict.first()["warnings"] == 1
    rebuilt = plain(e.index.scores(["wat"]))
    e.reindex()
    assert plain(e.index.scores(["wat"])) == rebuilt and e.expire(1) > 0 and e.search("tab")[1] == 1
    e.purge(F.lit(datetime(2024, 7, 30)))
    assert e.search("intern")[1] == 0 and e.table("jobs").count() == 0


def test_only_one_run_at_a_time(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    with e.exclusive("first"), pytest.raises(RuntimeError), e.exclusive("second"):
        pass
    with e.exclusive("third"):
        pass
