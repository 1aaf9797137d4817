"""Secret scan: known forms by pattern, others by a battery of randomness tests.

Long runs of letters and digits are candidates. For the encoding that a candidate's characters infer
(hex, base32, lower-case or full alphanumeric, base64) three statistics are taken: chi-squared
uniformity over its alphabet, the number of runs of character classes, and the serial correlation of
neighbours. What people write differs from a uniform alphabet by an amount that grows with length, so
the first two become one score for "not written text", in which a short candidate cannot score high;
candidates whose neighbours are correlated (sequences, repetitions), or that lack a mix of letters and
digits or cases, have a p-value of 1: they are never reported but count among the tests. In each class of
lengths the Benjamini-Hochberg rule over all candidates of the corpus sets the score from which a
candidate is reported. Column expressions only; the corpus is read twice and nothing but a histogram
of scores is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import RUN, let, running

#: Kinds in their listed order, and the method's own.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough; shorter ones are never kept
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: (name, whole-token pattern, alphabet in order of value, chance that neighbours
#: in written text change class, excess of written text over uniform, per character, in chi-squared)
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef", 0.15, 0.6),
    ("base32", "[A-Z2-7]+", _LOWER + "234567", 0.12, 1.2),
    ("alnum36", "[0-9a-z]+", _DIGITS + _LOWER, 0.12, 1.4),
    ("base64", ".+", _LOWER.upper() + _LOWER + _DIGITS + "+/_-", 0.2, 3.2),
)
#: Length classes begin here; each has a false-discovery rate of its own.
STRATA = (20, 32, 64)
RATE = 0.001
#: Neighbours' correlation, in its standard errors under randomness, beyond which a candidate is no secret.
SERIAL = 3.3
BINS_A_UNIT, TOP = 20, 40


_SPAN = "array<struct<start:bigint,k:int,end:bigint,token:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _positions(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, k, end, token) of the matches of ``pattern``, in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(both):
        m, gap = both["m"], both["gap"]
        steps = F.transform(m, lambda x, i: (F.length(F.get(gap, i)) + F.length(x)).cast("long"))
        placed = lambda ends: F.transform(m, lambda x, i: F.struct(
            (F.get(ends, i) + F.length(F.get(gap, i))).alias("start"), F.lit(kind).alias("k"), F.get(ends, i + 1).alias("end"), x.alias("token"),
        ))
        return let(running(steps, lambda a, x: a + x, F.lit(0)), placed).cast(_SPAN)

    return let(F.struct(found.alias("m"), between.alias("gap")), spans)


def base_spans(text: Column) -> Column:
    """Spans of the three known forms in order of start, then kind."""
    long_ = lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 2)) >= 8
    parts = (
        F.when(text.rlike(ASSIGN), F.filter(_positions(text, ASSIGN, 0), long_)),
        F.when(text.contains("AKIA"), F.filter(_positions(text, ACCESS, 1), lambda x: F.length(x["token"]) >= 16)),
        F.when(text.rlike(HEX), _positions(text, HEX, 2)),
    )
    return F.array_sort(F.concat(*[F.coalesce(p, _none()) for p in parts]))


def rebuilt(text: Column, spans: Column, put) -> Column:
    """``text`` with ``put(start, end, done)`` in place of every span, in order of start; done: the greatest end before
    it, before which nothing is put again.

    A block of spans looks at its own part of the text alone, so the time does not grow with the square of the spans.
    """

    def of(x):
        s, done = x["s"], x["done"]

        def block(first):
            last = F.least(first + RUN, F.size(s)) - 1
            begin = F.get(done, first)
            part = F.substring(text, (begin + 1).cast("int"), F.greatest(F.get(s, last)["start"] - begin, F.lit(0)).cast("int"))
            piece = lambda body: lambda j: F.concat(
                F.substring(body, (F.get(done, j) - begin + 1).cast("int"), F.greatest(F.get(s, j)["start"] - F.get(done, j), F.lit(0)).cast("int")),
                put(F.get(s, j)["start"], F.get(s, j)["end"], F.get(done, j)),
            )
            return let(part, lambda body: F.array_join(F.transform(F.sequence(first, last), piece(body)), ""))

        heads = F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(RUN)), block)
        return F.concat(F.array_join(heads, ""), F.substring(text, (F.element_at(done, -1) + 1).cast("int"), F.length(text)))

    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    return let(spans, lambda s: F.when(F.size(s) > 0, let(F.struct(s.alias("s"), ends(s).alias("done")), of)).otherwise(text))


def _blanked(text: Column, spans: Column) -> Column:
    return rebuilt(text, spans, lambda start, end, done: F.repeat(F.lit(" "), F.greatest(end - F.greatest(start, done), F.lit(0)).cast("int")))


def randomness(token: Column) -> Column:
    """Score of a candidate: standard deviations away from written text towards a uniform alphabet; null, which is a
    p-value of 1, if it has no letter or no digit or case change, or if its neighbours are correlated."""
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]") | token.rlike("[a-z][A-Z].*[a-z][A-Z].*[a-z][A-Z]")
    encoding = F.lit(None)
    for name, pattern, alphabet, change, excess in reversed(ENCODINGS):
        same_case = F.lower(token) if name in ("hex", "base32") else token
        facts = F.struct(F.split(same_case, "").alias("chars"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("a"), F.lit(change).alias("change"), F.lit(excess).alias("excess"))
        encoding = F.when(token.rlike("^(" + pattern + ")$"), facts).otherwise(encoding)
    return F.when(mixed, let(encoding, _battery))


def _battery(e: Column) -> Column:
    """The three tests of a token's characters against the alphabet of its encoding, as one score."""
    a, change, excess = e["a"], e["change"], e["excess"]

    def tests(s):
        v, k = s["v"], s["k"]
        n = F.size(v).cast("double")
        total = lambda items, of: F.aggregate(items, F.lit(0.0), lambda t, x: t + of(x))
        counts = F.transform(F.array_distinct(v), lambda u: F.size(F.filter(v, lambda y: y == u)).cast("double"))
        chi = total(counts, lambda x: x * x) * a / n - n
        off = n * excess
        z_chi = (off + (a - 1) - chi) / F.sqrt(2 * (a - 1) + 4 * off)
        pairs = F.sequence(F.lit(1), F.size(v) - 1)
        changes = total(pairs, lambda i: F.when(F.element_at(k, i) != F.element_at(k, i + 1), 1.0).otherwise(0.0))
        z_runs = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))

        def correlated(mean):
            var = total(v, lambda x: (x - mean) * (x - mean))
            cov = total(pairs, lambda i: (F.element_at(v, i) - mean) * (F.element_at(v, i + 1) - mean))
            return F.when(var > 0, F.abs(cov / var) * F.sqrt(n))

        serial = let(total(v, lambda x: x) / n, correlated)
        return F.when(serial <= SERIAL, (z_chi + z_runs) / 1.4142135623730951)

    value = F.transform(e["chars"], lambda x: F.instr(e["alphabet"], x).cast("double"))
    classes = F.transform(e["chars"], lambda x: F.when(x.between("0", "9"), 0).when(x.between("A", "Z"), 1).when(x.between("a", "z"), 2).otherwise(3))
    return let(F.struct(value.alias("v"), classes.alias("k")), tests)


def candidates(text: Column) -> Column:
    """(start, k, end, score) of every candidate of a text, which are the runs that its known spans leave. Those that a
    gate holds back score 0, below what may be reported: they are tests all the same, so the rate's count has them."""
    spans = F.when(text.rlike(CANDIDATE), _positions(text, CANDIDATE, 3))
    scored = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), F.coalesce(randomness(x["token"]), F.lit(0.0)).alias("score")))
    return F.coalesce(scored, F.array().cast("array<struct<start:bigint,k:int,end:bigint,score:double>>"))


def _known(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with secret_known, the spans of known forms, and secret_rest, the text with blanks in their place. Each
    is a column of its own, so that the plan stays shallow."""
    known = F.when(text.rlike(ASSIGN) | text.contains("AKIA") | text.rlike(HEX), base_spans(text))
    return docs.withColumn("secret_known", F.coalesce(known, _none())).withColumn("secret_rest", _blanked(text, F.col("secret_known")))


def _stratum(n: Column) -> Column:
    return sum(((n >= s).cast("int") for s in STRATA[1:]), F.lit(0))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution by its continued fraction; 0.5 below z = 0.5, where nothing is reported."""
    part = z
    for k in (5, 4, 3, 2, 1):
        part = z + F.lit(float(k)) / part
    return F.when(z < 0.5, 0.5).otherwise(F.exp(-z * z / 2) / (2.5066282746310002 * part))


def cutoffs(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[int, float]:
    """For each length class the least score that is reported; none where nothing may be.

    Spans of known forms are no candidates, so they raise no rank; every other candidate counts, gated or not.
    Benjamini-Hochberg over the scores' histogram: at most TOP x BINS_A_UNIT sums for each of the
    length classes, however many candidates there are. A bin counts by its lower edge, the larger p.
    """
    slim = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    rest = _known(slim, F.col("text")).select("secret_rest").filter(F.col("secret_rest").rlike(CANDIDATE))
    seen = rest.select(F.explode(candidates(F.col("secret_rest"))).alias("c"))
    bins = seen.groupBy(_stratum(F.col("c.end") - F.col("c.start")).alias("stratum"), F.floor(F.least(F.greatest("c.score", F.lit(0.0)), F.lit(float(TOP))) * BINS_A_UNIT).alias("bin")).agg(F.count("*").alias("n"))
    from_top = W.partitionBy("stratum").orderBy(F.col("bin").desc())
    edge = F.col("bin") / F.lit(float(BINS_A_UNIT))
    ranked = bins.withColumn("rank", F.sum("n").over(from_top)).withColumn("m", F.sum("n").over(W.partitionBy("stratum")))
    held = ranked.filter((tail(edge) <= rate * F.col("rank") / F.col("m")) & (edge >= 0.5)).groupBy("stratum").agg(F.min(edge).alias("least"))
    return {r["stratum"]: r["least"] for r in held.collect()}


def with_spans(docs: DataFrame, text: Column, least: dict[int, float]) -> DataFrame:
    """``docs`` with secret_spans: (start, k, end) of known forms, and of candidates beside them at or above their
    class's cut-off."""
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    found, known, rest = _known(docs, text), F.col("secret_known"), F.col("secret_rest")
    spans = plain(known)
    if least:
        ok = lambda x: F.coalesce(*[F.when(_stratum(x["end"] - x["start"]) == k, x["score"] >= v) for k, v in least.items()], F.lit(False))
        spans = F.when(rest.rlike(CANDIDATE), F.array_sort(F.concat(spans, plain(F.filter(candidates(rest), ok))))).otherwise(spans)
    return found.withColumn("secret_spans", spans).drop("secret_known", "secret_rest")


def _said(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of ``docs``.

    spans: ``kind:start:end`` in code points, end exclusive, by start, then kind, comma-joined;
    base_sha256 is over the known kinds alone, joined likewise. A null text is an empty one and has no
    spans. Repeated rows are judged alike; other columns are not looked at; an empty table gives none.
    """
    least = cutoffs(docs, text_col, rate)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_spans(slim, F.col("text"), least).select("id", F.col("secret_spans").alias("s"))
    n = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_random"),
        F.sha2(_said(F.filter("s", lambda x: x["k"] < 3)), 256).alias("base_sha256"), _said(F.col("s")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``mark``; spans that overlap become one.

    Texts without spans, and null texts, stay as they are; all columns pass through. Column names that
    begin with ``secret_`` are the operator's own.
    """
    least = cutoffs(docs, text_col, rate)
    text, spans = F.col(text_col), F.col("secret_spans")
    marked = rebuilt(text, spans, lambda start, end, done: F.when(start >= done, F.lit(mark)).otherwise(""))
    return with_spans(docs, text, least).withColumn(text_col, marked).select(*docs.columns)
