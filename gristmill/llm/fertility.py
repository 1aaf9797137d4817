"""Quality by tokenizer fertility: how well public vocabularies fit a text.

Each vocabulary splits the words of a text into tokens. Characters a token, the share of tokens that stand
for bytes and not for characters, and the entropy of the tokens are compared with bands of the text's
language, or of its script where no language is given. Bands come from all documents that the base rules
keep: fences around the quartiles among documents of the same language and about the same length.

A text has one measure a vocabulary and kind; it is kept if the base rules keep it and every measure lies
within its band. Plain rules (too short, repeated passages) are the base; symbols and repeated lines are
counted beside them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, held, sized, small_batches

KINDS = ("chars_per_token", "byte_share", "entropy")
#: Steps of a measure in a histogram, a unit.
STEPS = 1000
#: A fence stands so many times the distance of the quartiles from them, which counts as ``LEAST_WIDTH`` at least.
FENCE = 3.0
LEAST_WIDTH = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.1}
#: Documents that a band needs; with fewer the script's bands hold, and without these none.
LEAST_DOCUMENTS = 50
#: Distinct words of a batch that a vocabulary splits in one call.
SPLIT_AT_ONCE = 10_000
#: Words of a batch whose tokens are measured at once, those of a whole text at least.
MEASURED_AT_ONCE = 100_000
#: Words that are kept with their tokens from batch to batch, some 300 bytes each.
KNOWN_WORDS = 400_000

_SYMBOLS = "[#*$%&|<>]"
_FEW = re.compile("[^ \t-\r]")
_MEASURED = "id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens array<long>, measures array<double>"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in shown else next(rest)): b for b in range(256)}


def _broken(token: bytes) -> bool:
    """Whether a token's bytes make no whole characters."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


#: Words that ``_ending_words`` splits: visible characters below U+0250, which are lower-cased alike everywhere.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"


def _ending_words(path: str, slow, letters: dict[str, int]):
    """A splitter for a lower-casing vocabulary whose words end in ``</w>``, as ``tiktoken`` splits; None for others.

    The end is written as ``A``, which no lower-cased text holds. Each byte with an end comes before all merges, so
    it is joined first; other words than plain ones go to ``slow``.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre = said["model"], said.get("pre_tokenizer") or {}
    steps, split = (said.get("normalizer") or {}).get("normalizers", []), pre.get("pretokenizers", [{}])[0]
    ids = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", []))]
    ends = [model["vocab"].get(c + _END, -1) for c in letters]
    known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PIECES} and split.get("invert") and split.get("behavior") == "Removed"
    ordered = ids and all(x < y for x, y in zip(ids, ids[1:], strict=False)) and min(ends) > 255 and max(ends) < ids[0] and all(model["vocab"].get(c, 256) < 256 for c in letters)
    if not (known and ordered and model.get("end_of_word_suffix") == _END and not model.get("unk_token")):
        return None
    import regex
    import tiktoken

    special = {x["id"] for x in said.get("added_tokens") or []}
    bare = lambda token: bytes(letters[c] for c in token)
    ranks = {bare(t.removesuffix(_END)) + b"A" * t.endswith(_END): i for t, i in model["vocab"].items() if i not in special}
    ordinary = tiktoken.Encoding("own", pat_str="[^A]+A", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ended, plain = regex.compile(_PIECES).sub, _PLAIN.fullmatch

    def split_all(words):
        out = [ordinary(w.lower() + "A" if w.isalpha() else ended(r"\g<0>A", w.lower())) if plain(w) else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, slow([words[i] for i in rest]) if rest else (), strict=True):
            out[i] = x
        return out

    return split_all


class _Vocabulary:
    """A splitter of words; ``of_bytes`` tells which ids stand for bytes that make no character."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = lambda words: pieces.encode(words, num_threads=1)
            self.of_bytes = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
        elif path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
            ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.split = lambda words: [ordinary(" " + w) for w in words]
            self.of_bytes = np.zeros(max(ranks.values()) + 1, dtype=bool)
            for token, i in ranks.items():
                self.of_bytes[i] = _broken(token)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t, letters = Tokenizer.from_file(path), _byte_letters()
            t.encode_special_tokens = True
            slow = lambda words: [x.ids for x in t.encode_batch([" " + w for w in words], add_special_tokens=False)]
            self.split = _ending_words(path, slow, letters) or slow
            self.of_bytes = np.zeros(t.get_vocab_size(), dtype=bool)
            for token, i in t.get_vocab().items():
                self.of_bytes[i] = _broken(bytes(letters.get(c, 32) for c in token))

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all ``words`` one after the other, and where those of each begin and how many they are."""
        ids, sizes = [np.empty(0, "int32")], [np.empty(0, "int64")]
        for at in range(0, len(words), SPLIT_AT_ONCE):
            some = self.split(words[at : at + SPLIT_AT_ONCE])
            ids.append(np.fromiter(chain.from_iterable(some), "int32"))
            sizes.append(np.fromiter(map(len, some), "int64", len(some)))
        size = np.concatenate(sizes)
        return np.concatenate(ids), np.cumsum(size) - size, size

    def measure(self, tokens, words: np.ndarray, owner: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text its tokens, characters a token, share of byte tokens and entropy in bits; ``words`` are the
        numbers of all texts' words, ``owner`` the texts that have them, ``chars`` the texts' characters."""
        ids, begin, size = tokens
        sizes, texts = size[words], len(chars)
        n = np.bincount(owner, sizes, texts).astype("int64")
        total = int(sizes.sum())
        own = ids[np.arange(total) + np.repeat(begin[words] - np.cumsum(sizes) + sizes, sizes)]
        own = np.sort(np.repeat(owner, sizes) << 32 | own)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts, text, token = np.diff(first, append=total), own[first] >> 32, own[first] & 0xFFFFFFFF
        of_bytes, spread = (np.bincount(text, x, texts) for x in (counts * self.of_bytes[token], counts * np.log2(counts)))
        some, none = np.maximum(n, 1), n == 0
        return n, *(np.where(none, 0.0, x) for x in (chars / some, of_bytes / some, np.log2(some) - spread / some))


class _Words:
    """Words with their lengths and their tokens by each vocabulary, kept from batch to batch: up to ``KNOWN_WORDS`` of
    them, then it begins anew with the words at hand."""

    def __init__(self, vocabularies: list[_Vocabulary]):
        self.vocabularies = vocabularies
        self._begin_anew()

    def _begin_anew(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = np.empty(0, "int64")
        self.tokens = [(np.empty(0, "int32"), np.empty(0, "int64"), np.empty(0, "int64")) for _ in self.vocabularies]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of the distinct ``words``, by which ``lengths`` and ``tokens`` have it."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self._begin_anew()
            new = words
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), "int64", len(new))])
        for k, v in enumerate(self.vocabularies):
            (ids, begin, size), (more, at, sizes) = self.tokens[k], v.tokens(new)
            self.tokens[k] = np.concatenate([ids, more]), np.concatenate([begin, at + len(ids)]), np.concatenate([size, sizes])
        return np.fromiter(map(self.known.__getitem__, words), "int64", len(words))

    def measure(self, words: list[str], codes: list[np.ndarray]):
        """For each text its characters in words, and by vocabulary its numbers of tokens and its measures in turn;
        ``codes`` are the places of its words in ``words``."""
        numbers, sizes = self.numbers(words), np.fromiter(map(len, codes), "int64", len(codes))
        ends, i = np.cumsum(sizes), 0
        while i < len(codes):
            k = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + MEASURED_AT_ONCE, "right")))
            at, owner = numbers[np.concatenate(codes[i:k])], np.repeat(np.arange(k - i), sizes[i:k])
            chars = np.bincount(owner, self.lengths[at], k - i).astype("int64")
            got = [v.measure(t, at, owner, chars) for v, t in zip(self.vocabularies, self.tokens, strict=True)]
            yield from zip(chars.tolist(), np.stack([x[0] for x in got], 1).tolist(), np.stack([y for x in got for y in x[1:]], 1).tolist(), strict=True)
            i = k


def split_words(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of ``texts``, and for each text the numbers of its words in turn."""
    for c in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, c, " ")
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(parts).to_numpy())
    if "" in words:
        full = codes != words.index("")
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
        codes = codes[full]
    return words, np.split(codes, ends[:-1]) if len(ends) else []


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype="uint64")


def repeated_words(codes: np.ndarray, window: int = 5) -> int:
    """Words that lie in a ``window`` of words which the text holds twice or more; ``codes`` has a number for each word.

    Equal windows have equal sums, so a text without equal sums has none; else the windows themselves are compared.
    """
    n = len(codes) - window + 1
    if n < 2:
        return 0
    sums = np.zeros(n, dtype="uint64")
    for k in range(window):
        sums += (codes[k : k + n].astype("uint64") + np.uint64(1)) * _ODD[k % len(_ODD)] ** np.uint64(1 + k // len(_ODD))
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    runs, k = np.unique(codes.astype("int64"), return_inverse=True)[1], 1
    while k < window:  # a window from two that begin and end it, and may overlap
        grow = min(k, window - k)
        left, right = runs[: len(runs) - grow], runs[grow:]
        runs, k = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1], k + grow
    twice = np.flatnonzero(np.bincount(runs)[runs] > 1)
    marks = np.zeros(len(codes) + 1, dtype="int64")
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _FEW.search(x)]
    return len(lines) - len(set(lines))


class _Scripts(dict):
    """The script that a character's name begins with, for letters; else none."""

    def __missing__(self, c: str) -> str:
        self[c] = out = unicodedata.name(c, "").split(" ")[0].split("-")[0].lower() if c.isalpha() else ""
        return out


_scripts = _Scripts()
_NO_LETTERS = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())


def script(text: str) -> str:
    """The script of most letters, the first in the alphabet of those; none without letters."""
    if 2 * len(text.encode("ascii", "ignore").translate(None, _NO_LETTERS)) > len(text):
        return "latin"  # A to Z alone are more than half
    counts: dict[str, int] = {}
    for c in set(text):
        if name := _scripts[c]:
            counts[name] = counts.get(name, 0) + text.count(c)
    return min(counts, key=lambda k: (-counts[k], k)) if counts else ""


def measure(docs: DataFrame, vocabularies: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: its counts, and KINDS for each vocabulary in turn as ``measures``."""

    def counted(batches):
        known = held(("fertility", vocabularies), lambda: _Words([_Vocabulary(p) for p in vocabularies]))
        for b in batches:
            filled = pc.fill_null(b["text"], "")
            words, codes = split_words(filled)
            out = [
                (script(text), len(own), chars, duplicate_lines(text), repeated_words(own), n, measures)
                for text, own, (chars, n, measures) in zip(filled.to_pylist(), codes, known.measure(words, codes), strict=True)
            ]
            rest = dict(zip(("script", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_tokens", "measures"), zip(*out, strict=True), strict=True)) if out else {}
            rest["n_symbols"] = pc.count_substring_regex(filled, _SYMBOLS)
            yield pa.RecordBatch.from_arrays([b["id"], b["lang"]] + [pa.array(rest.get(f.name, []), f.type) for f in made[2:]], schema=pa.schema(made))

    made = [
        pa.field("id", pa.int64()), pa.field("lang", pa.string()), pa.field("script", pa.string()),
        *[pa.field(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        pa.field("n_tokens", pa.list_(pa.int64())), pa.field("measures", pa.list_(pa.float64())),
    ]
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(counted, _MEASURED)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _length(tokens: Column) -> Column:
    """Documents of about the same length: the number of binary digits of their tokens."""
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def bands(measured: DataFrame, n_vocabularies: int, *, fence: float = FENCE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(grp, k, length, low, high): the fences of measure k for each language (``=en``), script (``~latin``) and length.

    Quartiles are those of all rows that the base rules keep, in steps of a 1,000th, from counts by step:
    a few thousand rows a group at most, whatever the number of its documents.
    """
    each = measured.filter(~base_failed()).select(
        F.explode(F.array_compact(F.array(F.concat(F.lit("="), "lang"), F.concat(F.lit("~"), "script")))).alias("grp"), "n_tokens", "measures"
    ).select("grp", "n_tokens", F.posexplode("measures").alias("k", "measure"))
    step = F.round(F.col("measure") * STEPS).cast("long")
    hist = each.groupBy("grp", "k", _length(F.get("n_tokens", F.floor(F.col("k") / len(KINDS)).cast("int"))).alias("length"), step.alias("step")).agg(F.count("*").alias("n"))
    run = W.partitionBy("grp", "k", "length")
    ranked = hist.withColumn("upto", F.sum("n").over(run.orderBy("step"))).withColumn("whole", F.sum("n").over(run)).filter(F.col("whole") >= least)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("whole") * q), F.col("step"))) / STEPS
    quartiles = ranked.groupBy("grp", "k", "length").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    widths = F.get(F.array(*[F.lit(LEAST_WIDTH[k]) for k in KINDS]), F.col("k") % len(KINDS))
    beyond = fence * F.greatest(F.col("q3") - F.col("q1"), widths)
    return quartiles.select("grp", "k", "length", (F.col("q1") - beyond).alias("low"), (F.col("q3") + beyond).alias("high"))


def judge(docs: DataFrame, vocabularies: tuple[str, ...], *, fence: float = FENCE, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row for each document: doc_id, the counts of the base rules, base_failed, kept, the measures and why it goes.

    A null text has no words. Without a language the bands of the script hold, also where a language has
    fewer than ``least`` documents of the length; where the script has as few, or the text no letters, the
    measures do not reject. Repeated rows are judged each, and each counts in the bands. An empty table
    gives no rows. Whole texts are read once; the bands and verdicts read what was measured.
    """
    rows = cut(measure(docs, vocabularies).withColumn("key", F.monotonically_increasing_id()))
    table = cut(bands(rows, len(vocabularies), fence=fence, least=least).groupBy("grp", "length").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("low", "high")))).alias("fences")))
    small = table.count()
    n = len(vocabularies) * len(KINDS)

    def with_bands(df: DataFrame, grp: Column, name: str) -> DataFrame:
        for v in range(len(vocabularies)):
            ours = table.select(F.col("grp").alias("_grp"), F.col("length").alias("_length"), F.col("fences").alias(f"{name}{v}"))
            df = df.join(sized(ours, small), (grp == F.col("_grp")) & (_length(F.get("n_tokens", F.lit(v))) == F.col("_length")), "left").drop("_grp", "_length")
        return df

    banded = with_bands(with_bands(rows, F.concat(F.lit("="), F.col("lang")), "own"), F.concat(F.lit("~"), F.col("script")), "script")

    def outside(k: int) -> Column:
        v = k // len(KINDS)
        band = F.coalesce(F.try_element_at(F.col(f"own{v}"), F.lit(k)), F.try_element_at(F.col(f"script{v}"), F.lit(k)))
        m = F.get("measures", F.lit(k))
        return F.coalesce((m < band["low"]) | (m > band["high"]), F.lit(False))

    said = [f"{KINDS[k % len(KINDS)]}_{k // len(KINDS)}" for k in range(n)]
    reasons = F.array_compact(F.array(*[F.when(outside(k), said[k]) for k in range(n)]))
    judged = banded.withColumn("base_failed", base_failed()).withColumn("reasons", reasons)
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "script",
        *[F.get("measures", F.lit(k)).alias(said[k]) for k in range(n)], F.array_join("reasons", ",").alias("reasons"),
    )
