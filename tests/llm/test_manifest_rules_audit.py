"""The manifest, the tokenizer rules and the filter audit against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gristmill.llm import fertility, filter_audit, merkle
from gristmill.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, part string, mask long, key string, id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "Zeta", "ETA", "theta$", "iota", "kappa"]
    texts = [None, "", " \t\n ", "a", "één été \U0001f600 x", "the of and " * 5000, "x" * 20000, "SHOUT " * 60, "a | b # c", "one two three four five " * 4]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    texts += ["same text"] * 5 + ["w1 w2 w3 w4 w5 w6\n\nw1 w2 w3 w4 w5 w6\n \nw7"]
    rows = [(i * 3 - 5, t, ["en", None, "fr", "é", ""][i % 5 if i % 3 else 0], ["a", None, "", "é"][i % 4], None if i % 6 == 0 else i, "g", 1, "p", 2, "k", 9) for i, t in enumerate(texts)]
    return [*rows, *[rows[20]] * 7, (rows[30][0], "another text of that id", *rows[30][2:]), (None, "no id at all", "en", "a", 3, "g", 1, "p", 2, "k", 9), (None, "same text", None, None, None, "g", 1, "p", 2, "k", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i * 3 - 5, i % 2, int(i % 5 == 0)) for i in range(0, 70, 2)]
    return spark.createDataFrame([*rows, (rows[3][0], 1, 1), (None, 1, 1), (999, None, 1)], "doc_id long, quality int, toxic int")


def sha(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row[:5]
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, None if n is None else n + more, text)))


def grown(nodes):
    """Root and paths by rebuilding the levels one after the other."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for j in range(0, len(nodes), 2):
            pair = nodes[j : j + 2]
            for k, side in ((0, "R"), (1, "L")):
                for i in members[j + k] if j + k < len(nodes) else ():
                    paths[i].append((side, pair[1 - k]) if len(pair) == 2 else ("", ""))
            up.append(sha(*pair))
            held.append(sum(members[j : j + 2], []))
        nodes, members = up, held
    return nodes[0], paths


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r), leaf(r, 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else None))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for k in order:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        inner[k] = grown([x[1] for x in groups[k]])
    root, outer = grown([inner[k][0] for k in order])
    out = Counter()
    for k, above in zip(order, outer, strict=True):
        for (i, own, changed), path in zip(groups[k], inner[k][1], strict=True):
            whole, h = path + above, changed or own
            for side, beside in whole:
                h = sha(beside, h) if side == "L" else sha(h, beside)
            out[i, own, inner[k][0], root, sha(*[x for _, x in whole]), h, h == root] += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest(odd, depth):
    got = merkle.manifest(odd, depth=depth).collect()
    assert Counter(map(tuple, got)) == manifest_by_hand(odd_rows())
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_documents_and_of_few_rows(spark, given, none):
    rows = [tuple(r) for r in given.collect()]
    assert Counter(map(tuple, merkle.manifest(given).collect())) == manifest_by_hand(rows)
    assert merkle.manifest(none).count() == 0
    one = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(one).first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == sha()
    copies = spark.createDataFrame([(4, "t", None, "s", 1)] * 37, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.manifest(copies, depth=2).collect())) == manifest_by_hand([(4, "t", None, "s", 1)] * 37)


def audit_by_hand(rows, told):
    first, good, toxic = {}, set(), set()
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in told:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for i, text, _, source, *_ in rows:
        t, part = text or "", source or ""
        w = WORD.findall(t)
        fails = dict(zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and t in first and i > first[t]), strict=True))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                n = out[part, order, step]
                here, gone_before = fails[f] and not gone, gone
                gone |= fails[f]
                n[0] += not gone
                n[1] += here
                n[2] += fails[f] and gone_before
                n[3] += fails[f] and sum(fails.values()) == 1
                n[4] += here and i is not None and i in good
                n[5] += here and i is not None and i in toxic
                shapley[part, f] += here
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(odd, labels, given, none, spark):
    got = filter_audit.audit(odd, labels).collect()
    assert set(map(tuple, got)) == audit_by_hand(odd_rows(), [tuple(r) for r in labels.collect()]) and len(got) == 600 * 3
    said = spark.read.parquet(f"{SF}/labels.parquet")
    got = filter_audit.audit(given, said).collect()
    assert set(map(tuple, got)) == audit_by_hand([tuple(r) for r in given.collect()], [tuple(r) for r in said.collect()])
    assert filter_audit.audit(none, labels).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(odd, labels.limit(0)).collect()} == {0}


def test_parity_sums_invert_exactly(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.randrange(32)) for i in range(3000)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "doc_id long, part string, mask int"), spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["label"]): r["c"] for r in sums.select("part", "label", filter_audit.cells(F.col("sums")).alias("c")).collect()}
    want = Counter((p, m) for _, p, m in rows)
    assert all(got[p, "all"] == [want[p, m] for m in range(32)] for p in "ab")
    assert sum(got[rows[5][1], "good"]) == 1 and not any(k[1] == "toxic" for k in got)


def base_by_hand(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    held = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held)


def test_quality_base_and_measures(odd, given, none):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df, rows in ((odd, odd_rows()), (given, [tuple(r) for r in given.collect()])):
        want = Counter()
        for i, text, *_ in rows:
            base = base_by_hand(text)
            ids = [x for w in WORD.findall(text or "") for x in model.encode(w)]
            n = len(ids)
            told = (n and base[1] / n, n and sum(map(model.is_byte, ids)) / n, n and -sum(c / n * math.log2(c / n) for c in Counter(ids).values()))
            want[(i, *base, base[0] < 10 or 100 * base[4] > 20 * base[0], *[round(float(x), 9) + 0.0 for x in told])] += 1
        got = fertility.judge(df, (MODEL,)).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert Counter((r["doc_id"], *[r[c] for c in names], *[round(r[f"{k}_0"], 9) + 0.0 for k in fertility.KINDS]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert fertility.judge(none, (MODEL,)).count() == 0


def test_repeated_words_of_random_texts():
    import numpy as np

    rng = random.Random(11)
    for _ in range(300):
        codes = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(0, 60))]
        for window in (5, 2, 7):
            runs = [tuple(codes[i : i + window]) for i in range(len(codes) - window + 1)]
            often = {x for x, n in Counter(runs).items() if n > 1}
            want = len({i + k for i, x in enumerate(runs) if x in often for k in range(window)})
            assert fertility.repeated_words(np.array(codes, dtype="int32"), window) == want


def fences_by_hand(judged, langs, k, fence, least):
    """Bands of one measure: quartiles of the kept rows of a group by nearest rank."""
    groups = defaultdict(list)
    for r, n in judged:
        if not r["base_failed"]:
            for g in (f"={langs[r['doc_id']]}" if langs[r["doc_id"]] is not None else None, f"~{r['script']}"):
                groups[g, n.bit_length() - 1].append(round(r[f"{fertility.KINDS[k]}_0"] * 1000))
    out = {}
    for g, xs in groups.items():
        if g[0] and len(xs) >= least:
            xs.sort()
            q1, q3 = (xs[math.ceil(len(xs) * q) - 1] / 1000 for q in (0.25, 0.75))
            beyond = fence * max(q3 - q1, fertility.LEAST_WIDTH[fertility.KINDS[k]])
            out[g] = (q1 - beyond, q3 + beyond)
    return out


def test_quality_bands_and_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    got = fertility.judge(docs, (MODEL,), least=20).collect()
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [(r, max(1, round(r["word_chars"] / r["chars_per_token_0"])) if r["word_chars"] else 1) for r in got]
    bands = [fences_by_hand(rows, langs, k, fertility.FENCE, 20) for k in range(3)]
    for r, n in rows:
        out = []
        for k, kind in enumerate(fertility.KINDS):
            near = n.bit_length() - 1
            low, high = bands[k].get((f"={langs[r['doc_id']]}", near)) or bands[k].get((f"~{r['script']}", near)) or (-math.inf, math.inf)
            if not low <= r[f"{kind}_0"] <= high:
                out.append(f"{kind}_0")
        assert r["reasons"] == ",".join(out) and r["kept"] == (not r["base_failed"] and not out)


def test_quality_tells_junk_from_prose(spark):
    """Of documents labelled good nearly all stay; of texts with a sign after each word most go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    told = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1").select("doc_id")
    got = fertility.judge(docs, (MODEL,)).filter("not base_failed")
    good = got.join(told, "doc_id")
    assert good.filter("kept").count() >= 0.99 * good.count()
    signed = got.filter("n_symbols > 2 * n_words")
    assert signed.filter("not kept").count() > 0.5 * signed.count() > 50


def test_byte_level_vocabulary_measures_too(spark):
    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    got = fertility.judge(spark.createDataFrame([(1, "plain words here", "en"), (2, "\U0001f9ff\U0001f9ff 一龘", None)], "doc_id long, text string, lang string"), (MODEL, byte_level)).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["byte_share_1"] == 0 and by[2]["byte_share_1"] > 0.5 and by[2]["byte_share_0"] > 0.3 and by[2]["script"] == "cjk"


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_merkle_manifest", "op13_filter_audit"):
        df, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert Counter(map(tuple, df.select(*want.columns).collect())) == Counter(want.fetchall())


def test_every_public_vocabulary_measures(spark, monkeypatch):
    import os

    held = Q.fertility_vocabularies()
    folder = os.path.dirname(held[0])
    there = {f for f in os.listdir(folder) if f.endswith((".json", ".model", ".tiktoken"))}
    assert {os.path.basename(p) for p in held} == there - {"byte_bpe_50k.json"}  # the .tiktoken of that name again
    words = ["plain", "words", "naïve", "\U0001f9ff一龘", "don't", "a1!", "<|endoftext|>"]
    ranks, merges = (fertility._Vocabulary(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("tiktoken", "json"))
    assert ranks.split(words) == merges.split(words)
    monkeypatch.setattr(fertility, "KNOWN_WORDS", 4)
    assert [merges.split(words[i : i + 3]) for i in (0, 2, 4, 0)] == [ranks.split(words[i : i + 3]) for i in (0, 2, 4, 0)]
    assert (ranks.of_bytes == merges.of_bytes[: len(ranks.of_bytes)]).all()
    got = Q.op12_quality_rules(spark, SF)
    assert {f"{k}_{v}" for k in fertility.KINDS for v in range(len(held))} <= set(got.columns)
    assert got.filter("n_words > 0 and least(chars_per_token_0, chars_per_token_1, chars_per_token_2, chars_per_token_3) <= 0").count() == 0
