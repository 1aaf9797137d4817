"""Column functions against plain Python on odd inputs."""

import html
import html.entities
import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from gristmill.functions import classify, text, urls
from gristmill.operators.store import Store


def words_of(chars):
    """What a run of characters folds to, each by its own decomposition: letters and digits, a space for the rest."""
    out = ""
    for c in chars:
        for x in unicodedata.normalize("NFKD", c):
            if 0x300 <= ord(x) < 0x370:
                continue
            out += "".join(y if y in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for y in x.casefold())
    return " ".join(out.split())


def test_fold_on_every_character(spark):
    said = [f"a{chr(c)}b" for c in (*range(1, 0xD800), *range(0xE000, 0x20000)) if chr(c) != "&"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.fold(F.col("s")).alias("f")).collect()
    assert [(r["s"], r["f"], words_of(r["s"])) for r in got if r["f"] != words_of(r["s"])] == []


def test_inclusive_suffixes_equal_plain_patterns(spark):
    rng = random.Random(8)
    pieces = ["abc", "ab", "a", "e", "es", "rice", "trices", "iennes", ".", "(", ")", "·", " ", "-", "7", "é", "x" * 29]
    said = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["abc.trices.e", "abc.tricesxyz.e", "abc.tricesxy.e", "x" * 31 + ".e", "x" * 70 + "·es"]
    short = "|".join(sorted((x for x in text.INCLUSIVE_SUFFIXES if len(x) < 6), key=len, reverse=True))
    tail = f"(?:(?:{short})(?![a-z])|(?:{'|'.join(x for x in text.INCLUSIVE_SUFFIXES if len(x) == 6)}))"
    plain = lambda s: re.sub(rf"([a-z]{{3,30}})[.(]{tail}\)?", r"\1", re.sub(rf"([a-z]{{3,30}})\s*·\s*{tail}", r"\1", s))
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.collapse_inclusive(F.col("s")).alias("c")).collect()
    assert [(r["s"], r["c"], plain(r["s"])) for r in got if r["c"] != plain(r["s"])] == [] and sum(r["s"] != r["c"] for r in got) > 200


def test_fold_of_phrases(spark):
    want = {
        "Étudiant·e": "etudiant", "Ingénieur(e) & Développeur.euse": "ingenieur and developpeur", "Engineer(s)": "engineer s", "ﬁn ½ Œuvre ß": "fin 1 2 uvre ss", "étudiant(trices)": "etudiant",
        "conseiller·ère en TI": "conseiller en ti", "": "", "a & b": "a and b", "AT&T": "at and t", "Technicien · ne": "technicien", "le·la": "le la", "développeur.xyz": "developpeur xyz", "𝐃𝐚𝐭𝐚 ①": "data 1",
        "auteur.rices": "auteur", "auteur.ricesque": "auteur ricesque", "auteur(ieresx)": "auteur ieresx", "\u0416 123": "123",
    }
    got = spark.createDataFrame([(s,) for s in want], "s string").select("s", text.fold(F.col("s")).alias("f")).collect()
    assert {r["s"]: r["f"] for r in got} == want


def test_texts_of_markup(spark):
    want = {
        "<p>Hi</p>\n": "Hi", "<script>a</script>b<STYLE>c</style >d<script>open": "b dopen", " a  \n\n\n\n b\t\n<br/>c<br>d</ul>e<ul class='x'>f": "a\n\n b\n\nc\ndef", "x<>y<a <b>z": "x<>yz", "1 < 2 and 3 > 2": "1  2",
        "a\u00a0\u3000": "a", "<p>Hi&nbsp;&amp;lt;b&gt;</p><ul><li>one</li></ul>": "Hi\u00a0<b>\none", "<style>p{}</style>t<style>q": "tq", "<" + "a" * 4096 + ">x": "x", "<" + "a" * 4097 + ">x": "<" + "a" * 4097 + ">x", "tab\there": "tab\there", "\x00b\x07": "b",
    }
    got = spark.createDataFrame([(s,) for s in want], "s string").select("s", text.strip_html(F.col("s")).alias("x")).collect()
    assert [(r["s"][:40], r["x"][:40]) for r in got if r["x"] != want[r["s"]]] == []


def test_characters_read_as_the_standard_library_reads_them(spark):
    rng = random.Random(4)
    parts = ["&amp;", "&lt", "&notit;", "&#38;", "&#x80;", "&#0;", "&eacute", "&copy2", "&#128512;", "&#xD800;", "&#1;", "&#13;", "&", ";", "&#", "&NotEqualTilde;", "&#1234567890123;", "&#x1F600", "x", " ", "lt;", "#38;", "&unknown;"]
    said = ["".join(rng.choice(parts) for _ in range(6)) for _ in range(400)] + [f"&{n}" for n in html.entities.html5]
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.unescape(F.col("s")).alias("x")).collect()
    assert [(r["s"], r["x"]) for r in got if r["x"] != html.unescape(r["s"])] == []


def test_hostile_markup_takes_linear_time(spark):
    for shape in ("<script>" * 30_000, "<" * 300_000, "&" * 300_000, " " * 300_000 + "x", "<a" * 100_000 + ">"):
        df = spark.createDataFrame([(shape,)], "s string").select(F.length(text.strip_html(F.col("s"))).alias("n"))
        df.collect()  # code is made
        began = time.time()
        df.collect()
        assert time.time() - began < 5, shape[:9]


def test_classification_and_urls(spark):
    one = spark.range(1)
    c = lambda col: one.select(col.alias("x")).first()["x"]
    lit = F.lit
    assert c(classify.resolve_term(lit("Intern (Summer of 2026)"), lit(None).cast("array<string>"), lit(""))) == "summer-2026"
    assert c(classify.resolve_term(lit("Intern, spring boot 2026"), lit(None).cast("array<string>"), lit("Fall 2025"))) == "fall-2025"
    assert c(classify.resolve_term(lit("Summer 2026 or Fall 2026"), lit(None).cast("array<string>"), lit(""))) == "unknown"
    assert tuple(c(classify.resolve_location(lit("Montréal, QC; Remote")))) == ("montreal", "unspecified")
    assert tuple(c(classify.resolve_location(lit("San Francisco, CA")))) == ("usa", None)
    assert c(classify.classify_role(lit("Data Engineer, IT"), lit(""), lit(""))) == "data"
    assert c(classify.title_canonical(lit("Nurse"))) == ""
    assert c(classify.required_degree(lit("Intern"), lit("PhD required."))) == "phd"
    assert c(urls.canonical_apply_url(lit("HTTP://Jobs.Lever.co:80/en-US/acme/1/?x=1#y"))) == "https://jobs.lever.co/acme/1"
    assert c(urls.canonical_apply_url(lit("https://x.grnh.se/a"))) == "" == c(urls.canonical_apply_url(lit("ftp://a/b")))
    assert tuple(c(urls.identify(lit("https://boards.greenhouse.io/acme/jobs/1"))))[:2] == ("greenhouse", "acme")
    assert tuple(c(urls.workday_target(lit("Acme"), lit("Site_1"), lit("WD5")))) == ("acme.wd5.myworkdayjobs.com", "/wday/cxs/acme/Site_1/jobs") and c(urls.workday_target(lit("a b"), lit("x"), lit("wd1"))) is None
    french = classify._SAID["french_only_markers"][0]
    assert c(classify.screen_internship(lit(f"{french.title()} en développement logiciel"), lit(""))) is None and c(classify.screen_internship(lit(f"{french.title()} door keeper"), lit(""))) == classify.NO_MARKER
    assert c(classify.screen_internship(lit("Developer"), lit("Internship"))) is None and c(text.summary(lit("\n\n first line of it \nsecond"), 8)) == "first l…"
    assert [c(classify.location_agrees(lit(a), lit(b))) for a, b in (("canada", "canada"), ("unknown", "unknown"), ("usa", "canada"))] == [True, False, False]
    assert [c(urls.public_https_url(lit(u))) for u in ("https://a.org/", "http://a.org", "https://u:p@a.org", "https://10.0.0.1/", "https://localhost/")] == [True, False, False, False, False]
    assert c(text.name_matches(lit("Acme Software Inc."), lit("ACME"))) and not c(text.name_matches(lit("Global Bank"), lit("Bank")))
    assert c(text.slug_candidates(lit("Acme Robotics Ltd"))) == ["acmerobotics", "acme-robotics", "acme"]
    assert c(text.stable_component(lit("A/1"))) == "a-1~412f31"


def test_store_commits_tables_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.commit(jobs=spark.range(3), dead=spark.range(1))
    store.commit(jobs=store.read("jobs").union(spark.range(2)))
    assert store.read("jobs").count() == 5 and store.read("dead").count() == 1


def test_stream(spark):
    from gristmill.plans import registry

    got = registry.QUERIES["stream_latest"](spark, "/root/testdata/sf0.001").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("e")).collect()
    assert {r["user_id"]: r["event_id"] for r in got} == {r["user_id"]: r["e"] for r in want}


def test_thousands_of_phrases_in_one_pass(spark):
    import random
    import time

    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(5000)})
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", "none of them", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", text.phrase_hits(F.col("t"), phrases).alias("hits"))
    began = time.time()
    df._jdf.queryExecution().optimizedPlan()
    assert time.time() - began < 1
    got = {r["i"]: r["hits"] for r in df.collect()}
    for i, t in enumerate(rows):
        held = [p for p in phrases if f" {p} " in f" {t or ''} "]
        assert (got[i] or []) == sorted(held, key=lambda p: (-len(p), p))

def test_names_without_a_semicolon_are_read(spark):
    import html

    texts = ["a &amp&amp;</h1>b", "the&amp;&amp</p>", "x &lt y &copy z", "&ampx &notit;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.unescape(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in got] == [html.unescape(t) for t in texts]
