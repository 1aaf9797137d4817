"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text tells the longest match from any place of another
text. A text is parsed greedily into longest matches; the language that needs the fewest phrases, per
letter, is the text's. Phrases do not cross white space here: a word is parsed with a space before and
after it, so its number of phrases is a property of the word, and a frequent word is parsed once.

Only the labelled text is sampled, to a documented bound; every whole text is parsed.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, sized, small_batches

#: Labelled characters learned from in each language, and documents they are taken from, at most.
SAMPLE_CHARS, SAMPLE_DOCS = 30_000, 200
#: Labelled characters learned from in all: of very many languages each has an equal share, and ``LEAST_CHARS`` at least.
MODEL_CHARS, LEAST_CHARS = 3_000_000, 400
#: Words kept with their phrases in a worker.
KEPT_WORDS = 120_000
#: Words longer than this are parsed one by one, others of one length together.
LONG = 256
#: Bits of a count where several are kept in one number.
_BITS = 48
#: Common characters that are no letters become spaces, so that most of what stands between spaces is a word.
_MARKS = ".,;:!?()\"'-"
_LETTERS = regex.compile(r"\p{L}+")


class SuffixAutomaton:
    """States of the shortest machine that accepts every substring of a text; ``next[s]`` maps a letter to a state."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = array("i", [-1]), array("i", [0]), 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def phrases(self, text: str) -> int:
        """Longest matches, one after another, that the text parses into; a letter never seen is one alone."""
        n, state, begun, steps = 0, 0, False, self.next
        for c in text:
            to = steps[state].get(c)
            if to is None:
                n += begun
                to = steps[0].get(c)
                if to is None:
                    n, state, begun = n + 1, 0, False
                    continue
            state, begun = to, True
        return n + begun


def plain_words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", chars: int = SAMPLE_CHARS, sample: int = SAMPLE_DOCS, model: int = MODEL_CHARS) -> dict[str, str]:
    """Up to ``chars`` labelled characters for each language, as words between spaces, from the heads of at most
    ``sample`` distinct documents chosen by a hash of their text, each with an equal share. Every label that a text
    with letters has is learned; of more than ``model`` / ``chars`` labels each has an equal share of ``model``.
    Null labels and texts without letters teach nothing.

    A head is cut before it is shuffled, to eight times its share, so that what short texts leave free has takers.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = known.select("lang", F.xxhash64("text", F.lit(11)).bitwiseAND((1 << 40) - 1).alias("h"), F.substring("text", 1, chars).alias("text"))
    counts = cut(hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    labels = counts.count()
    if not labels:
        return {}
    chars = min(chars, max(LEAST_CHARS, model // labels))
    # Twice the share that is wanted, so that copies of one text may be passed over.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.greatest("n", F.lit(1)))
    head = F.least(F.lit(chars), F.ceil(F.lit(8 * chars) / F.least(F.greatest("n", F.lit(1)), F.lit(sample)))).cast("int")
    limits = counts.select("lang", (share * (1 << 40)).cast("long").alias("limit"), head.alias("head"))
    taken = hashed.join(sized(limits, labels), "lang").filter(F.col("h") < F.col("limit")).groupBy("lang", "h").agg(F.min(F.substr("text", F.lit(1), F.col("head"))).alias("text"))
    texts: dict[str, list[str]] = {}
    for r in taken.orderBy("lang", "h").collect():  # of each language at most 2 x sample heads, 16 x chars characters
        said = " ".join(plain_words(r["text"]))
        if said and len(texts.setdefault(r["lang"], [])) < sample:
            texts[r["lang"]].append(said)
    return {k: " " + " ".join(_heads(v, chars)) + " " for k, v in sorted(texts.items()) if v}


def _heads(texts: list[str], chars: int) -> list[str]:
    """The head of each text, of one length for all that are longer; at most ``chars`` characters with a space for
    each. What short texts leave free goes to the longer ones; a word is cut only if it is a head's first."""
    heads, room = {}, chars - 1
    for left, (i, said) in zip(range(len(texts), 0, -1), sorted(enumerate(texts), key=lambda x: len(x[1]))):
        share = max(0, room // left - 1)
        head = said[:share]
        if share < len(said) and said[share] != " ":
            head = head.rpartition(" ")[0] or head
        if head:
            heads[i] = head
            room -= len(head) + 1
    return [heads[i] for i in sorted(heads)]


def predict(docs: DataFrame, samples: dict[str, str], *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rate.

    lang_score: by how much the second language needs more phrases than the winner, from 0 (a tie) to 1.
    lang_rate: the winner's phrases per letter. A text without letters, or null, is ``und`` with 0 and
    null; so is every text if nothing was learned. Equal counts go to the first language by name.
    """
    spark = docs.sparkSession
    if not samples:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("lang_score", F.lit(0.0)).withColumn("lang_rate", F.lit(None).cast("double"))
    small_batches(spark)
    told = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("pred string, score double, rate double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        names, phrases = _model(told.value)
        langs = range(len(names))
        out = []
        split = [spaced(text).split() if text else [] for text in texts]
        phrases.meet(set().union(*split))
        for said in split:
            counts = sum(map(phrases.__getitem__, said))
            letters = counts & ((1 << _BITS) - 1)
            if not letters:
                out.append(("und", 0.0, None))
                continue
            sums = [counts >> (_BITS * (i + 1)) & ((1 << _BITS) - 1) for i in langs]
            order = sorted(langs, key=sums.__getitem__)
            best = sums[order[0]]
            second = sums[order[1]] if len(order) > 1 else 2 * best
            out.append((names[order[0]], min(1.0, (second - best) / second), best / letters))
        phrases.forget()
        return pd.DataFrame(out, columns=["pred", "score", "rate"])

    # Marked so that a filter on the outcome is not pushed below the projection, which would judge every text twice.
    judge = judge.asNondeterministic()
    return docs.withColumn("lang_", judge(F.col(text_col))).select(*docs.columns, F.col("lang_.pred").alias("lang_pred"), F.col("lang_.score").alias("lang_score"), F.col("lang_.rate").alias("lang_rate"))


def spaced(text: str) -> str:
    text = text.lower()
    for mark in _MARKS:
        text = text.replace(mark, " ")
    return text


class _Steps:
    """A suffix automaton as sorted arrays, by which many words of one length are parsed at a time."""

    def __init__(self, machine: SuffixAutomaton):
        self.alphabet = np.array(sorted(map(ord, machine.next[0])), dtype=np.int64)
        self.width = len(self.alphabet) + 1  # code 0 is a character never seen
        code = {chr(c): i for i, c in enumerate(self.alphabet.tolist(), 1)}
        pairs = sorted((s * self.width + code[c], to) for s, step in enumerate(machine.next) for c, to in step.items())
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.to = np.array([t for _, t in pairs] + [0], dtype=np.int64)
        self.first = np.full(self.width, -1, dtype=np.int64)
        self.first[self.keys[self.keys < self.width]] = self.to[: len(self.alphabet)]

    def phrases(self, points: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``points``, a word's code points from top to bottom."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[at] == points, at + 1, 0)
        state, n = np.zeros(points.shape[1], dtype=np.int64), np.zeros(points.shape[1], dtype=np.int64)
        begun = np.zeros(points.shape[1], dtype=bool)
        for c in codes:
            key = state * self.width + c
            i = np.searchsorted(self.keys, key)
            hit = self.keys[i] == key
            n += begun & ~hit
            to = np.where(hit, self.to[i], self.first[c])
            begun = to >= 0
            n += ~begun
            state = np.where(begun, to, 0)
        return n + begun


class _Phrases(dict):
    """By what stands between white space: its letters and the phrases of its words in each language, in one
    number of 48 bits each, the letters lowest."""

    def __init__(self, samples: dict[str, str]):
        self.samples = samples
        self.steps = [_Steps(SuffixAutomaton(t)) for t in samples.values()]
        self.machines: list[SuffixAutomaton] = []  # made when the first long word is met, then kept
        self.brief: set[str] = set()

    def meet(self, said: set[str]) -> None:
        """Counts what is not known yet."""
        new = said - self.keys()
        mixed = {x: _LETTERS.findall(x) for x in new if not x.isalpha()}
        by_length: dict[int, list[str]] = {}
        for word in (new - mixed.keys()) | (set().union(*mixed.values()) - self.keys()):
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            words.sort()
            for at in range(0, len(words), 1 << 14):
                some = words[at : at + (1 << 14)]
                self.update(zip(some, self._count(some, length), strict=True))
                self.brief.update(some)
        for x, words in mixed.items():
            self[x] = sum(map(self.__getitem__, words))
        self.brief.update(mixed)

    def forget(self) -> None:
        """Lets what was met last go again, as far as there is more than is to be kept."""
        for x in list(self.brief)[: max(0, len(self) - KEPT_WORDS)]:
            del self[x]
        self.brief.clear()

    def _count(self, words: list[str], length: int) -> list[int]:
        if length > LONG:
            self.machines = self.machines or [SuffixAutomaton(t) for t in self.samples.values()]
            columns = [[m.phrases(f" {w} ") for w in words] for m in self.machines]
        else:
            flat = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            points = np.ascontiguousarray(flat.reshape(len(words), length + 2).T.astype(np.int64))
            columns = [s.phrases(points).tolist() for s in self.steps]
        packed = [length] * len(words)
        for i, column in enumerate(columns, 1):
            packed = [x | n << _BITS * i for x, n in zip(packed, column, strict=True)]
        return packed


def _model(samples: dict[str, str]):
    return held(("language", tuple(samples.items())), lambda: (list(samples), _Phrases(samples)))


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row: rows whose id's CRC-32 leaves 2 modulo 4 are held out
    of what is learned (a null id is not; its row teaches nothing). Repeated rows are judged alike;
    other columns are not looked at."""
    held_out = F.coalesce(fold_of(F.col(id_col)) == 2, F.lit(False))
    samples = learn(docs.filter(fold_of(F.col(id_col)) != 2), text_col=text_col, lang_col=lang_col)
    slim = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return predict(slim, samples, text_col="text").select(id_col, "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that have no language, which are those without a letter, nulls included.

    The label of a row that has none becomes the predicted language; given labels stay. If nothing was
    learned, every row with a letter stays as it is.
    """
    samples = learn(docs, text_col=text_col, lang_col=lang_col)
    if not samples:
        small_batches(docs.sparkSession)

        @F.pandas_udf("boolean")
        def lettered(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(t and _LETTERS.search(t)) for t in texts], dtype=bool)

        return docs.filter(lettered(F.col(text_col)))
    kept = predict(docs, samples, text_col=text_col).filter(F.col("lang_rate").isNotNull())
    return kept.withColumn(lang_col, F.coalesce(F.col(lang_col), F.col("lang_pred"))).select(*docs.columns)
