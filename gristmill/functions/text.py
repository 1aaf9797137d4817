"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of French inclusive spellings, without accents.
INCLUSIVE_SUFFIXES = (
    "e", "es", "a", "as", "se", "ses", "euse", "euses", "eure", "eures", "ere", "eres", "rice", "rices", "trice", "trices", "fe", "fes", "ne", "nes",
    "le", "les", "ive", "ives", "ale", "ales", "ienne", "iennes", "onne", "onnes", "elle", "elles", "ete", "etes", "iere", "ieres",
)
# Words that a company's name may end in or share with others without meaning.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "sas", "sarl",
    "nv", "bv", "pty", "ulc", "ltee",
)
GENERIC_TOKENS = (
    "bank", "blue", "capital", "central", "cloud", "data", "digital", "energy", "financial", "first", "general", "global", "green", "group",
    "health", "international", "labs", "media", "national", "new", "north", "one", "open", "power", "security", "software", "solutions", "systems",
    "tech", "technologies",
)
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one character, what to, and those that fold to several: compatibility decomposition
    without combining marks, case folded, for every character of the planes that hold letters."""
    one, to, many = [], [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) < 0x370).casefold()
        if folded == c or 0x300 <= ord(c) < 0x370:
            continue
        if len(folded) == 1 and ord(folded) < 0x80 or folded == "·":
            one.append(c)
            to.append(folded)
        elif any(ord(x) < 0x80 for x in folded):
            many[c] = folded
    return "".join(one), "".join(to), many


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed, and written into the plan, once."""
    return F.transform(F.array(value), body)[0]


def fixed_list(words) -> Column:
    """A constant array of texts without ``|``, one literal however many they are."""
    return F.split(F.lit("|".join(words)), r"\|") if len(words) else F.array().cast("array<string>")


def fixed_map(pairs: dict[str, str]) -> Column:
    """A constant map; one literal, however many entries, where an expression for each would slow every plan."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def unaccent(s: Column) -> Column:
    """Compatibility characters as their plain ones, accents gone, lower case; other scripts as they are. Texts of
    plain ASCII, by far the most, only pass one test."""
    one, to, many = _folding()
    plain = F.translate(F.regexp_replace(s, r"[\x{300}-\x{36F}]+", ""), one, to)
    spelled, letters = F.split(F.lit("".join(many)), ""), fixed_map(many)
    there = lambda t: F.array_intersect(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0)), spelled)
    spell = lambda t: F.aggregate(there(t), t, lambda acc, c: F.replace(acc, c, F.try_element_at(letters, c)))
    rest = let(plain, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), spell(t)).otherwise(t))
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.lower(rest)).otherwise(F.lower(s))


def collapse_inclusive(s: Column) -> Column:
    """``ingenieur·e``, ``etudiant(e)`` and ``etudiant.e`` without their suffix. Of texts without such a sign only the
    sign is looked for; in others a word is tried once, from its start or where the last suffix ended."""
    short = "|".join(sorted((x for x in INCLUSIVE_SUFFIXES if len(x) < 6), key=len, reverse=True))
    long_ = "|".join(x for x in INCLUSIVE_SUFFIXES if len(x) == 6)
    tail, word = rf"(?:(?:{short})(?![a-z])|(?:{long_}))", r"((?:\G|(?<![a-z]))[a-z]{3,}+)"
    dotted = let(s, lambda t: F.when(F.contains(t, F.lit("·")), F.regexp_replace(t, rf"{word}\s*·\s*{tail}", "$1")).otherwise(t))
    return let(dotted, lambda t: F.when(t.rlike(rf"[.(](?<=[a-z]{{3}}[.(]){tail}"), F.regexp_replace(t, rf"{word}[.(]{tail}\)?", "$1")).otherwise(t))


def spelled(s: Column) -> Column:
    """The canonical form before its words are parted: what is not of 0-9a-z stands between words."""
    return collapse_inclusive(unaccent(F.replace(s, F.lit("&"), F.lit(" and "))))


def fold(s: Column) -> Column:
    """The canonical form: ``&`` as and, no accents, no case, no inclusive suffixes, words of 0-9a-z one space apart."""
    return F.trim(F.regexp_replace(spelled(s), "[^0-9a-z]+", " "))


def bare(s: Column) -> Column:
    return F.regexp_replace(unaccent(s), "[^a-z]+", "")


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def ngrams(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` words."""
    return let(words, lambda t: F.when(F.size(t) > 0, _runs(t, F.sequence(F.lit(0), F.size(t) - 1), most)).otherwise(_no_texts()))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _runs(words: Column, starts: Column, most: int) -> Column:
    """Runs of up to ``most`` words that begin at ``starts``; ``words`` must be a value, as it is looked at for each."""
    run = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i)), lambda n: F.array_join(F.slice(words, i + 1, n), " "))
    return F.flatten(F.transform(starts, run))


def phrase_hits(folded: Column, phrases: list[str]) -> Column:
    """Phrases that a folded text holds as whole words, longest first, then by name.

    One pass finds any number of phrases: runs of words are only made where a phrase's first word stands, and
    looked up by hash. The phrases are one literal of the plan.
    """
    most = max((p.count(" ") + 1 for p in phrases), default=1)
    firsts, every = fixed_list(sorted({p.split(" ")[0] for p in phrases})), fixed_list(list(dict.fromkeys(phrases)))

    def at_firsts(x):
        t, begins = x["t"], x["begins"]
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.array_contains(begins, F.get(t, i)))
        return F.when(F.size(begins) > 0, longest_first(F.array_intersect(_runs(t, starts, most), every))).otherwise(_no_texts())

    return let(let(tokens(folded), lambda t: F.struct(t.alias("t"), F.array_intersect(t, firsts).alias("begins"))), at_firsts)


def longest_first(hits: Column) -> Column:
    return F.transform(F.array_sort(F.transform(hits, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])


def of_list(hits: Column, phrases: list[str]) -> Column:
    """Those of ``hits``, found for several lists at once, that are in one list; their order stays."""
    return F.array_intersect(hits, fixed_list(phrases))


def first_phrase(folded: Column, phrases: list[str]) -> Column:
    return F.get(phrase_hits(folded, phrases), F.lit(0))


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, CONTROL, "")


#: White space as Python's ``str.split`` knows it, without the control characters.
_WHITE = r"\x20\t\n\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ENDS = rf"^[{_WHITE}]+|(?<![{_WHITE}])[{_WHITE}]++\z"


def strip(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(s, _ENDS, "")


def collapse_whitespace(s: Column) -> Column:
    return strip(F.regexp_replace(sanitize(s), f"[{_WHITE}]+", " "))


@lru_cache(maxsize=1)
def _entities() -> tuple[dict[str, str], list[str]]:
    """HTML's named characters by what stands between ``&`` and the end, and those that need no semicolon."""
    return html5, sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)


# Numbers that name no character of their own, as browsers read them.
_READ_AS = dict(zip(range(0x80, 0xA0), "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178", strict=True))
_COMMON = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "rsquo;", "ndash;", "mdash;", "eacute;", "egrave;", "agrave;", "ccedil;", "bull;", "hellip;")


def unescape(s: Column) -> Column:
    """Named and numbered characters of HTML read once, from left to right; what is none stays."""
    named, bare_names = _entities()
    pattern = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};|(?:" + "|".join(bare_names) + "))"
    table = lambda keys: fixed_map({k: named[k] for k in keys})
    prefix, read_as = table(bare_names), fixed_map({str(k): v for k, v in _READ_AS.items()})

    def number(e):
        hexa = F.regexp_extract(e, "[xX]0*([0-9a-fA-F]*)", 1)
        tens = F.regexp_extract(e, "#0*([0-9]*)", 1)
        far = F.lit(0x110000).cast("long")
        n = F.when(F.substring(e, 3, 1).isin("x", "X"), F.when(F.length(hexa) > 8, far).otherwise(F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("long")))
        n = n.otherwise(F.when(F.length(tens) > 9, far).otherwise(F.concat(F.lit("0"), tens).cast("long")))
        wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        silent = n.between(1, 8) | n.isin(0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        read = F.try_element_at(read_as, n.cast("string"))
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(wrong, "\ufffd").when(n == 0xD, "\r").when(n <= 0x9F, F.coalesce(read, F.when(silent, "").otherwise(char))).when(silent, "").otherwise(char)

    def name(e):
        key = F.substring(e, 2, 40)
        head = F.regexp_extract(e, "^&(" + "|".join(bare_names) + ")", 1)
        cut = F.when(head != "", F.concat(F.try_element_at(prefix, head), F.substring(e, F.length(head) + 2, F.length(e))))
        return F.coalesce(F.try_element_at(table(_COMMON), key), F.try_element_at(table(named), key), cut, e)

    read = lambda e: F.when(F.substring(e, 2, 1) == "#", number(e)).otherwise(name(e))

    def once(t):
        found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        joined = F.array_join(F.zip_with(between, F.transform(found, read), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(s, once)


def _without_scripts(s: Column) -> Column:
    """Scripts and styles up to their own closing tag are a space; what is never closed stays. Only what lies before
    the last closing tag is looked at, so that openings without end are not searched for again and again."""

    def once(t):
        def cut(closed):
            whole = F.regexp_replace(closed, r"(?is)<(script|style)\b[^>]{0,4096}>.*?</\1\s*>", " ")
            return F.concat(whole, F.substring(t, F.length(closed) + 1, F.length(t)))

        head = F.regexp_extract(t, r"(?is)^(.*</(?:script|style)\s*>)", 1)
        return F.when(t.rlike(r"(?i)</(?:script|style)\s*>"), let(head, cut)).otherwise(t)

    return let(s, once)


def _without_tags(s: Column) -> Column:
    """Tags of 1 to 4096 characters gone. What ends at one ``>`` begins at the first ``<`` that is near enough, so each
    part between two ``>`` is looked at once."""
    longest = 4096

    def part(x):
        tail = F.right(x, F.lit(longest + 1))
        at = F.instr(tail, "<")
        return F.when((at > 0) & (at < F.length(tail)), F.left(x, F.length(x) - F.length(tail) + at - 1)).otherwise(F.concat(x, F.lit(">")))

    def parts(p):
        return F.concat(F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), part), ""), F.element_at(p, -1))

    return let(s, lambda t: F.when(t.contains(">"), let(F.split(t, ">", -1), parts)).otherwise(t))


def strip_html(s: Column) -> Column:
    """Plain text of markup: scripts and styles a space, ends of blocks and ``br`` line ends, other tags of up to
    4096 characters gone, characters read before and after, no white space at line ends, at most one blank line in
    a row."""
    s = _without_scripts(unescape(s))
    s = F.regexp_replace(s, r"(?i)</(?:p|div|li|tr|h[1-6])>|<br\s*/?>", "\n")
    s = _without_tags(s)
    s = F.regexp_replace(sanitize(unescape(s)), r"(?<![ \t])[ \t]++(?=\n|\z)", "")
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def first_line(s: Column) -> Column:
    lines = F.transform(F.split(sanitize(s), r"\r\n|[\n\r\x{2028}\x{2029}]"), strip)
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def graphemes(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))


def truncate(s: Column, most: int) -> Column:
    """At most ``most`` graphemes, the last an ellipsis if any are cut."""
    clean = sanitize(s)
    g = graphemes(clean)
    return F.when(F.length(clean) <= most, clean).when(F.size(g) <= most, clean).otherwise(F.concat(F.array_join(F.slice(g, 1, max(most - 1, 0)), ""), F.lit("…")))


def summary(s: Column, most: int) -> Column:
    """The first line that says anything, at most ``most`` graphemes of it."""
    return truncate(first_line(s), most)


def name_root(name: Column) -> Column:
    """Folded name without its legal suffixes; the first word always stays."""
    return F.regexp_replace(fold(name), rf"(?<=\S)(?: (?:{'|'.join(LEGAL_SUFFIXES)}))+$", "")


def name_tokens(name: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(fold(name))), fixed_list(LEGAL_SUFFIXES))


def joined_name(name: Column) -> Column:
    legal = fixed_list(LEGAL_SUFFIXES)
    return F.array_join(F.filter(tokens(fold(name)), lambda t: ~F.array_contains(legal, t)), "")


def token_sets_match(a: Column, b: Column) -> Column:
    """One set of tokens within the other, sharing one that is not generic, or two, or all."""
    generic = fixed_list(GENERIC_TOKENS)
    shared = F.array_intersect(a, b)
    within = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & within & ((F.size(F.array_except(shared, generic)) > 0) | (F.size(shared) >= 2) | same)


def name_matches(a: Column, b: Column) -> Column:
    full = (F.size(name_tokens(a)) > 0) & (F.size(name_tokens(b)) > 0)
    return full & ((joined_name(a) == joined_name(b)) | token_sets_match(name_tokens(a), name_tokens(b)))


def slug_candidates(name: Column) -> Column:
    """Joined, hyphenated and first word of a name's root; a first word that is generic or under 4 letters is none."""
    words = F.split(name_root(name), " ")
    generic = fixed_list(GENERIC_TOKENS)
    head = F.get(words, F.lit(0))
    several = F.size(words) > 1
    offered = F.array(
        F.array_join(words, ""), F.when(several, F.array_join(words, "-")), F.when(several & ~F.array_contains(generic, head) & (F.length(head) >= 4), head)
    )
    return F.filter(F.array_distinct(F.array_compact(offered)), lambda x: x != "")


def search_terms(query: Column) -> Column:
    """Folded terms of a query: at most 32, of at most 48 characters."""
    return F.slice(F.transform(tokens(fold(query)), lambda t: F.substring(t, 1, 48)), 1, 32)


def formula_guard(s: Column) -> Column:
    """A cell that a spreadsheet would run begins with an apostrophe."""
    return F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)


def markdown_cell(s: Column) -> Column:
    return F.replace(F.replace(collapse_whitespace(s), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def stable_component(native: Column) -> Column:
    """A native id as it is if canonical, else its slug (or ``id``), ``~`` and its UTF-8 bytes in hex."""
    slug = slugify(native)
    return F.when(native.rlike("^[a-z0-9._-]+$") & (slug == native), native).otherwise(F.concat(F.when(slug == "", "id").otherwise(slug), F.lit("~"), F.lower(F.hex(F.encode(native, "UTF-8")))))


def posting_id(source: Column, board: Column, native: Column) -> Column:
    return F.concat_ws(":", source, slugify(board), stable_component(native))


def board_of(id_: Column, fallback: Column) -> Column:
    return F.when(F.size(F.split(id_, ":")) >= 3, F.substring_index(id_, ":", 2)).otherwise(fallback)
