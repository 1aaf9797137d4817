"""Plans that must not gather most of a table under one key, nor send pairs through a shuffle."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gristmill.functions import classify
from gristmill.operators import dedup, merge
from gristmill.plans import registry
from gristmill.plans.adapters import view


def largest_share(df, key):
    """The share of rows that the fullest of 16 tasks gets by ``key``."""
    task = F.pmod(F.hash(key), F.lit(16)).alias("task")
    n = sorted(r["count"] for r in df.groupBy(task).count().collect())
    return n[-1] / sum(n)


def hashed_by(df):
    return re.findall(r"hashpartitioning\(([^)]*(?:\([^)]*\))?[^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def left_keys(df):
    return re.findall(r"Join \[([^\]]*)\], \[[^\]]*\], LeftOuter", df._jdf.queryExecution().executedPlan().toString())


def jobs(spark, n=400):
    rows = spark.range(n).select(
        F.concat(F.lit("s"), F.col("id") % 3, F.lit(":b:"), "id").alias("id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") % 3).cast("int").alias("rank"),
        F.when(F.col("id") % 10 == 1, F.concat(F.lit("s"), (F.col("id") - 1) % 3, F.lit(":b:"), F.col("id") - 1)).alias("duplicate_of"), F.lit("b").alias("board_key"),
        F.lit("open").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"),
    )
    return rows


def test_rows_without_a_link_are_spread(spark):
    j = jobs(spark)
    assert largest_share(j, F.coalesce("duplicate_of", "id")) < 0.2 < largest_share(j, F.col("duplicate_of"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone = j.filter(~F.col("id").endswith("0"))
        none = spark.createDataFrame([], "id string, first_seen timestamp")
        linked = j.filter("duplicate_of is not null").select("id", "duplicate_of")
        for df in (merge.promote_orphans(gone), merge.repair(j, none), dedup.write_links(j.select("id", "duplicate_of"), j.limit(0).select("id"), linked)):
            assert left_keys(df) and not [x for x in left_keys(df) if re.fullmatch(r"(duplicate_of|now)#\d+", x)]
        assert {r["duplicate_of"] for r in merge.promote_orphans(gone).collect()} == {None}
        assert merge.repair(j, none).filter("duplicate_of is not null").count() == 40
        boards = spark.createDataFrame([("b",)], "board_key string")
        assert not [x for x in hashed_by(merge.touch(j.repartition(3), boards, F.current_timestamp())) if "board" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_not_shuffled(spark):
    pairs = dedup.candidate_pairs(view(spark, "/root/testdata/sf0.01", registry._PARTS_JOBS))
    assert not [x for x in hashed_by(pairs) if "a_id" in x or "b_id" in x]
    assert pairs.groupBy("a", "b").count().filter("count > 1").count() == 0


def test_screens_fold_and_search_a_text_once(spark):
    t = F.col("t")
    none = F.lit("")
    df = spark.createDataFrame([("Software Developer Intern",)], "t string")
    for c, most in ((classify.screen(t, none, none, none), 4), (classify.classify_role(t, none, none), 3), (classify.screen_degree(t, none), 2), (classify.resolve_eligibility(t, none), 1)):
        assert df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("[^0-9a-z]+") <= most
    plan = registry.QUERIES["scr_screen"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_pairs_of_one_key_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 16, raising=False)
    rng = random.Random(8)
    cols = "id string, source string, board string, rank int, url string, company_fold string, location string, title_key string, term string, language string, title_canonical string"
    row = lambda i, s, hot: (
        f"s{s}:{i}", f"s{s}", f"s{s}:b{rng.randrange(3)}", s, rng.choice(("", "u1", f"v{i}", f"w{i % 150}")), "acme" if hot else rng.choice(("acme", "bolt", None)), "canada" if hot else rng.choice(("canada", "unknown", None)),
        "dev" if hot else rng.choice(("dev", "qa", "")), rng.choice(("fall-2025", "unknown")), rng.choice(("EN", "FR", "unknown")), rng.choice(("swe", "")),
    )
    rows = [row(i, rng.randrange(4), i < 250) for i in range(330)]
    found = dedup.candidate_pairs(spark.createDataFrame(rows, cols)).select("*", F.spark_partition_id().alias("task")).collect()

    listed = Counter((r[1], r[4]) for r in rows)
    wrong = {url for (_, url), n in listed.items() if url and n > 1}
    known = lambda r: r[6] is not None and r[6] not in ("unknown", "international")
    spoken = lambda r: known(r) and r[8] != "unknown" and r[10] != "" and r[9] in ("EN", "FR")

    def rule(a, b):
        if a[2] == b[2] or (a[3], a[0]) >= (b[3], b[0]):
            return None
        if a[4] and a[4] == b[4]:
            return None if a[4] in wrong else "url"
        if a[5] is None or a[5] != b[5] or a[6] != b[6] or not known(a):
            return None
        if a[7] and a[7] == b[7]:
            return "same-language"
        return "cross-language" if spoken(a) and spoken(b) and a[8] == b[8] and a[10] == b[10] and a[9] != b[9] else None

    want = {(a[0], b[0], r) for a in rows for b in rows if (r := rule(a, b))}
    assert len(found) == len(want) and {(r["a"], r["b"], r["rule"]) for r in found} == want and {r for _, _, r in want} == set(dedup.RULES)
    # Most pairs are of one key; blocks of its rows are joined apart from each other.
    assert len({r["task"] for r in found if r["rule"] == "same-language"}) > 4
