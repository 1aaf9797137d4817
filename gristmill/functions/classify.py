"""Posting classification on columns: language, term, location, role, eligibility, and the three screens."""

from __future__ import annotations

import json
from dataclasses import dataclass
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fixed_list, fixed_map, fold, let, ngrams, of_list, phrase_hits, tokens
from .urls import canonical_apply_url

_SAID = json.loads(files("gristmill.data").joinpath("lexicon.json").read_text(encoding="utf-8"))
FRENCH, ENGLISH = _SAID["languages"]["french"], _SAID["languages"]["english"]
SEASONS = _SAID["seasons"]
FILLERS, NOT_SEASONS = _SAID["season_fillers"], _SAID["not_seasons"]
PLACES = _SAID["places"]


def _composed(lists: dict[str, list[str]], rules: dict[str, list[list[str]]]) -> dict[str, list[str]]:
    """``lists`` with every phrase that takes one word from each part of a rule, in order."""
    return {name: list(dict.fromkeys([*said, *(" ".join(x) for parts in rules.get(name, []) for x in product(*parts))])) for name, said in lists.items()}


ROLES = _composed(_SAID["roles"], _SAID["role_rules"])
CANADIAN_CODES, US_CODES = _SAID["canada_codes"], _SAID["usa_codes"]
MARKERS = _SAID["markers"]
DEGREES = _composed(_SAID["degree_required"], _SAID["degree_rules"])
#: Lists that a posting's texts are searched for, all in one pass over a text.
_SEARCHED = ("markers", "structured_internship", "disqualifiers", "blocked_bigrams", "phd_required", "degree_list_tokens", "phd_title_tokens", "graduate_title_tokens", "undergraduate_tokens", "work_auth_excluded", "excluded_titles", "technical_exceptions", "non_cs")
PHRASES = list(dict.fromkeys([*(p for k in _SEARCHED for p in _SAID[k]), *(p for said in (*ROLES.values(), *DEGREES.values()) for p in said)]))
#: What the screens say where no phrase of a posting tells why.
NO_MARKER, NO_ROLE = "no internship marker in title", "no matching CS role or source category"


def _words(xs) -> Column:
    return fixed_list(list(xs))


@dataclass(frozen=True)
class Said:
    """A folded text and the phrases of all lists that it holds, found once."""

    folded: Column
    hits: Column

    @classmethod
    def of(cls, text: Column) -> Said:
        return cls.folded_as(fold(text))

    @classmethod
    def folded_as(cls, folded: Column) -> Said:
        return cls(folded, phrase_hits(folded, PHRASES))

    def those(self, phrases: list[str]) -> Column:
        """Phrases of one list, longest first, then by name."""
        return of_list(self.hits, phrases)

    def first(self, phrases: list[str]) -> Column:
        return F.get(self.those(phrases), F.lit(0))

    def by_name(self, phrases: list[str]) -> Column:
        return F.array_min(self.those(phrases))


def once(text: Column, body) -> Column:
    """``body`` of the text's Said, whose folding and phrases are computed once a row however often ``body`` looks at
    them; as plain columns they would be written into the plan, and computed, at every use."""
    held = let(fold(text), lambda f: F.struct(f.alias("folded"), phrase_hits(f, PHRASES).alias("hits")))
    return let(held, lambda x: body(Said(x["folded"], x["hits"])))


def detect_language(title: Column, body: Column) -> Column:
    """EN, FR, bilingual or unknown, by distinct telling words: at least two, and twice the other's if both have two.

    A title under three words takes the first 40 of the body; an accented title adds one to French.
    """
    return _language(title, fold(title), fold(body))


def _language(title: Column, title_folded: Column, body_folded: Column) -> Column:
    seen = let(tokens(title_folded), lambda own: F.when((F.size(own) < 3) & (body_folded != ""), F.concat(own, F.slice(tokens(body_folded), 1, 40))).otherwise(own))
    accented = F.lower(title).rlike("[àâäçéèêëîïôöùûüÿœæ]").cast("int")

    def told(n):
        fr, en = n["fr"] + F.when(n["fr"] > 0, accented).otherwise(0), n["en"]
        return (
            F.when((fr >= 2) & (en >= 2), F.when(fr >= 2 * en, "FR").when(en >= 2 * fr, "EN").otherwise("bilingual"))
            .when(fr >= 2, "FR").when(en >= 2, "EN").otherwise("unknown")
        )

    hits = lambda s: F.struct(F.size(F.array_intersect(s, _words(FRENCH))).alias("fr"), F.size(F.array_intersect(s, _words(ENGLISH))).alias("en"))
    return let(let(seen, hits), told)


def seasons_in(text: Column) -> Column:
    """Array of struct(season, year): season words outside blocked pairs; the year is a 202x or 203x number up to
    three words ahead through fillers, else just behind."""
    return let(tokens(fold(text)), _seasons)


def _seasons(words: Column) -> Column:
    name = fixed_map({w: season for season, said in SEASONS.items() for w in said})
    year = lambda w: F.when(w.rlike(r"^20[23]\d$"), w.cast("int"))
    filler = lambda w: F.array_contains(_words(FILLERS), w)

    def at(i):
        word = lambda k: F.get(words, i + k)
        ahead = F.coalesce(year(word(1)), F.when(filler(word(1)), F.coalesce(year(word(2)), F.when(filler(word(2)), year(word(3))))))
        behind = F.when(i > 0, year(F.get(words, F.greatest(i - 1, F.lit(0)))))
        pairs = F.array(F.concat_ws(" ", word(0), word(1)), F.when(i > 0, F.concat_ws(" ", F.get(words, F.greatest(i - 1, F.lit(0))), word(0))))
        season = F.when(~F.coalesce(F.arrays_overlap(F.array_compact(pairs), _words(NOT_SEASONS)), F.lit(False)), F.try_element_at(name, word(0)))
        return F.struct(season.alias("season"), F.coalesce(ahead, behind).alias("year"))

    none = F.array().cast("array<struct<season:string,year:int>>")
    named = _words([w for said in SEASONS.values() for w in said])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(named, F.get(words, i)))
    return F.when(F.arrays_overlap(words, named), F.filter(F.transform(places, at), lambda x: x["season"].isNotNull())).otherwise(none)


def terms_in(text: Column) -> Column:
    return _terms(fold(text))


def _terms(folded: Column) -> Column:
    full = F.filter(let(tokens(folded), _seasons), lambda x: x["year"].isNotNull())
    return F.array_distinct(F.transform(full, lambda x: F.concat_ws("-", x["season"], x["year"].cast("string"))))


def resolve_term(title: Column, signals: Column, body: Column) -> Column:
    """The one term that signals and title agree on; the body speaks only if neither does; else unknown."""
    return _term(fold(title), signals, fold(body))


def _term(title_folded: Column, signals: Column, body_folded: Column) -> Column:
    spoken = F.array_union(_terms(title_folded), F.flatten(F.transform(F.coalesce(signals, F.array().cast("array<string>")), terms_in)))
    said = let(spoken, lambda s: F.when(F.size(s) > 0, s).otherwise(_terms(body_folded)))
    return let(said, lambda s: F.when(F.size(s) == 1, s[0]).otherwise("unknown"))


def resolve_location(raw: Column) -> Column:
    """struct(bucket, remote_scope): segments between ``/ ; | •`` and line ends; montreal before canada before usa
    before international; remote segments in Canada before those that name neither country before those in the USA.

    A place abroad is none where a longer phrase at home holds it (``new london``). Ambiguous names need
    Canada, a province or its code in the segment; codes count in upper case only, Canadian first; a
    phrase like ``vancouver wa`` takes the segment out of Canada.
    """
    most = max(p.count(" ") + 1 for said in PLACES.values() for p in said)
    home = [p for k in ("canada_cities", "canada_regions", "usa_cities", "usa_regions") for p in PLACES[k]]
    abroad = [p for k in ("international", "international_cities") for p in PLACES[k]]
    # For each place abroad, the longer phrases at home that hold it as whole words.
    held = {p: [h for h in home if len(h) > len(p) and f" {p} " in f" {h} "] for p in abroad}

    def flags(seg):
        def of(runs):
            has = {k: F.arrays_overlap(runs, _words(v)) for k, v in PLACES.items()}
            plain = F.arrays_overlap(runs, _words([p for p in abroad if not held[p]]))
            shadowed = [F.array_contains(runs, p) & ~F.arrays_overlap(runs, _words(hs)) for p, hs in held.items() if hs]
            outside = plain
            for x in shadowed:
                outside = outside | x
            codes = F.array_intersect(F.regexp_extract_all(seg, F.lit(r"\b[A-Z]{2}\b"), F.lit(0)), F.transform(runs, lambda t: F.upper(t)))
            code_ca = F.arrays_overlap(codes, _words(CANADIAN_CODES))
            code_us = F.arrays_overlap(codes, _words([x for x in US_CODES if x not in CANADIAN_CODES]))
            near = (has["canada_country"] | has["canada_regions"] | (code_ca & ~outside)) & ~has["canada_overrides"]
            montreal = (has["montreal"] & ~has["canada_overrides"]) | (has["montreal_ambiguous"] & near)
            canada = montreal | near | (has["canada_cities"] & ~has["canada_overrides"] & ~outside)
            usa = has["usa_country"] | ((has["usa_regions"] | has["usa_cities"] | code_us) & ~outside)
            return F.struct(montreal.alias("m"), canada.alias("ca"), usa.alias("us"), outside.alias("i"), has["remote"].alias("r"))

        return F.transform(F.array(ngrams(tokens(fold(seg)), most)), of)[0]

    segs = F.transform(F.filter(F.split(F.coalesce(raw, F.lit("")), r"[/;|•\n]+"), lambda s: F.trim(s) != ""), flags)

    def folded(all_):
        any_ = lambda k: F.exists(all_, lambda s: s[k])
        bucket = F.when(any_("m"), "montreal").when(any_("ca"), "canada").when(any_("us"), "usa").when(any_("i"), "international").otherwise("unknown")
        remote = F.filter(all_, lambda s: s["r"])
        scope = F.when(F.exists(remote, lambda s: s["ca"]), "canada").when(F.exists(remote, lambda s: ~s["ca"] & ~s["us"]), "unspecified").when(F.exists(remote, lambda s: s["us"]), "us")
        return F.struct(bucket.alias("bucket"), scope.alias("remote_scope"))

    return F.transform(F.array(segs), folded)[0]


def location_agrees(a: Column, b: Column) -> Column:
    """Equal buckets, neither unknown nor abroad."""
    silent = ("unknown", "international")
    return ~a.isin(*silent) & ~b.isin(*silent) & (a == b)


def term_agrees(a: Column, b: Column) -> Column:
    return (a != "unknown") & (b != "unknown") & (a == b)


_EVERY_ROLE = [p for said in ROLES.values() for p in said]


def _role_of(said: Said) -> Column:
    """Role of the longest phrase; general ones give way to any other; equal lengths to the earlier place, then the name."""
    kind = fixed_map({p: role for role, said in ROLES.items() for p in said})

    def best(x):
        hits = F.transform(x["roles"], lambda p: F.struct((-F.length(p)).alias("n"), F.instr(x["text"], p).alias("at"), F.try_element_at(kind, p).alias("role")))
        special = lambda hs: F.filter(hs, lambda h: h["role"] != "general-cs")
        first = lambda hs: F.get(F.array_sort(let(special(hs), lambda s: F.when(F.size(s) > 0, s).otherwise(hs))), F.lit(0))["role"]
        return F.when(F.size(x["roles"]) > 0, let(hits, first))

    return let(F.struct(said.folded.alias("text"), said.those(_EVERY_ROLE).alias("roles")), best)


def classify_role(title: Column, body: Column, declared: Column) -> Column:
    """Role of the longest phrase in the title, else in the body, else of the declared category, else unknown. General
    phrases give way to any other; equal lengths to the earlier place, then the name."""
    return once(title, lambda t: once(body, lambda b: _role(t, b, declared)))


def _role(title: Said, body: Said | None, declared: Column) -> Column:
    known = fixed_map(_SAID["source_roles"])
    return F.coalesce(_role_of(title), *([_role_of(body)] if body else []), F.try_element_at(known, fold(declared)), F.lit("unknown"))


def title_canonical(title: Column) -> Column:
    """Role of the title's longest phrase; '' if none, or if the longest ones name several roles."""
    kind = fixed_map({p: role for role, said in ROLES.items() for p in said})
    longest = lambda hits: F.filter(hits, lambda p: F.length(p) == F.length(hits[0]))
    roles = F.array_distinct(F.transform(let(phrase_hits(fold(title), _EVERY_ROLE), longest), lambda p: F.try_element_at(kind, p)))
    return let(roles, lambda r: F.when(F.size(r) == 1, r[0]).otherwise(""))


def required_degree(title: Column, body: Column) -> Column:
    return resolve_eligibility(title, body)["degree"]


def resolve_eligibility(title: Column, body: Column) -> Column:
    """struct(degree, work_auth, phrase): the highest degree that title or body asks for, whether they rule out who
    has no leave to work, and the phrase that said so first."""
    return once(F.concat_ws(" ", title, body), _eligibility)


def _eligibility(said: Said) -> Column:
    def of(x):
        own = Said(F.lit(""), x)
        hits = {level: own.first(phrases) for level, phrases in DEGREES.items()}
        degree = F.coalesce(*[F.when(h.isNotNull(), F.lit(level)) for level, h in hits.items()], F.lit("unknown"))
        barred = own.first(_SAID["work_auth_excluded"])
        return F.struct(degree.alias("degree"), barred.isNotNull().alias("work_auth"), F.coalesce(*hits.values(), barred, F.lit("")).alias("phrase"))

    return let(said.hits, of)


#: Characters on either side of a phrase in which another degree takes its force.
CLAUSE = 60


def restricted_phrase(folded: Column, phrases: list[str], alternatives: list[str]) -> Column:
    """The longest of ``phrases``, ties by name, that stands somewhere without one of the ``alternatives`` within
    CLAUSE characters; the stretch may begin or end inside a word."""
    return _restricted(folded, phrase_hits(folded, phrases), alternatives)


def _restricted(folded: Column, hits: Column, alternatives: list[str]) -> Column:
    most = max(p.count(" ") + 1 for p in alternatives)

    def first_free(x):
        padded = F.concat(F.lit(" "), x["text"], F.lit(" "))

        def free(phrase):
            def stands(p):
                def alone(i):
                    # Every part has a character or more, so so many of them always fill the stretch.
                    first = F.greatest(F.lit(1), i - CLAUSE // 2)
                    before = F.call_function("array_join", F.slice(p, first, i - first + 1), phrase)
                    after = F.call_function("array_join", F.slice(p, i + 1, F.lit(CLAUSE // 2 + 1)), phrase)
                    near = F.concat(F.right(before, F.lit(CLAUSE + 1)), phrase, F.left(after, F.lit(CLAUSE + 1)))
                    return ~F.arrays_overlap(ngrams(tokens(near), most), _words(alternatives))

                return F.when(F.size(p) > 1, F.exists(F.sequence(F.lit(1), F.size(p) - 1), alone)).otherwise(False)

            return let(F.split(padded, F.concat(F.lit("(?<= )"), phrase, F.lit("(?= )")), -1), stands)

        return F.get(F.filter(x["hits"], free), F.lit(0))

    return let(F.struct(folded.alias("text"), hits.alias("hits")), first_free)


def screen_internship(title: Column, employment: Column) -> Column:
    """Why a posting is no internship, or null: a phrase that rules it out; a marker only within a pair of words that
    means something else; no marker in the title nor among declared types. French-only markers need a French title."""
    return once(title, lambda t: _internship(title, t, employment))


def _internship(title: Column, said: Said, employment: Column) -> Column:
    listed = F.size(phrase_hits(fold(employment), _SAID["structured_internship"])) > 0

    def why(x):
        matched = F.when(x["french"], x["hits"]).otherwise(F.array_except(x["hits"], _words(_SAID["french_only_markers"])))
        blocked = x["blocked"]
        beside = F.exists(matched, lambda p: ~F.concat(F.lit(" "), blocked, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))
        return F.coalesce(x["ruled_out"], F.when(blocked.isNotNull() & ~beside, blocked), F.when((F.size(matched) == 0) & ~listed, F.lit(NO_MARKER)))

    french = _language(title, said.folded, F.lit("")).isin("FR", "bilingual")
    facts = F.struct(said.those(MARKERS).alias("hits"), said.by_name(_SAID["blocked_bigrams"]).alias("blocked"), said.by_name(_SAID["disqualifiers"]).alias("ruled_out"), french.alias("french"))
    return let(facts, why)


def screen_degree(title: Column, body: Column) -> Column:
    """The phrase that asks for a doctorate or names a graduate posting, or null."""
    return once(title, lambda t: once(F.concat_ws(" ", title, body), lambda both: _degree(t, both)))


def _degree(title: Said, both: Said) -> Column:
    required = _restricted(both.folded, both.those(_SAID["phd_required"]), _SAID["degree_list_tokens"])
    token = title.first(_SAID["phd_title_tokens"])
    graduate = F.coalesce(title.first(_SAID["graduate_title_tokens"]), token)
    return F.coalesce(required, F.when(title.first(_SAID["degree_list_tokens"]).isNull(), token), F.when(title.first(_SAID["undergraduate_tokens"]).isNull(), graduate))


def screen_role(title: Column, declared: Column) -> Column:
    """struct(reason, phrase) of a title outside computing, or null. A title of another field passes if it also has a
    technical word and a role of its own."""
    return once(title, lambda t: _field(t, declared))


def _field(title: Said, declared: Column) -> Column:
    facts = F.struct(
        (_role(title, None, declared) != "unknown").alias("role"), title.first(_SAID["technical_exceptions"]).isNotNull().alias("technical"),
        title.first(_SAID["excluded_titles"]).alias("excluded"), title.first(_SAID["non_cs"]).alias("other"),
    )

    def of(x):
        phrase = F.coalesce(F.when(~(x["technical"] & x["role"]), x["excluded"]), x["other"])
        return let(phrase, lambda p: _rejected("not-a-cs-role", p, _rejected("unknown-cs-role", F.when(~x["role"], F.lit(NO_ROLE)))))

    return let(facts, of)


def _rejected(reason: str, phrase: Column, otherwise: Column | None = None) -> Column:
    said = F.when(phrase.isNotNull(), F.struct(F.lit(reason).alias("reason"), phrase.alias("phrase")))
    return said if otherwise is None else F.coalesce(said, otherwise)


def screen(title: Column, body: Column, declared: Column, employment: Column) -> Column:
    """struct(reason, phrase) of the first screen that rejects, or null: no internship, wrong degree, no computing."""
    return once(title, lambda t: once(F.concat_ws(" ", title, body), lambda both: _screened(title, t, both, declared, employment)))


def _screened(title: Column, said: Said, both: Said, declared: Column, employment: Column) -> Column:
    marked = lambda reason, phrase: let(phrase, lambda p: _rejected(reason, p))
    return F.coalesce(marked("not-an-internship", _internship(title, said, employment)), marked("out-of-scope-degree", _degree(said, both)), _field(said, declared))


def normalize(postings: DataFrame) -> DataFrame:
    """``postings`` (title_raw, description, location_raw, apply_url_raw, signals' terms, category and employment_type)
    with all that is read off them, and ``rejection``, null for those that pass.

    A missing column counts as empty. Title, body and both together are folded and searched for the phrases
    of all lists once each.
    """
    have = set(postings.columns)
    get = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    title, body = get("title_raw"), get("description")
    signals = F.col("terms") if "terms" in have else F.lit(None).cast("array<string>")
    texts = {"_title": title, "_body": body, "_both": F.concat_ws(" ", title, body)}
    folded = postings.withColumns({c: fold(t) for c, t in texts.items()})
    out = folded.withColumns({f"{c}_hits": phrase_hits(F.col(c), PHRASES) for c in texts})
    of_title, of_body, of_both = (Said(F.col(c), F.col(f"{c}_hits")) for c in texts)
    out = out.withColumns({"_place": resolve_location(get("location_raw")), "_able": _eligibility(of_both)})
    return out.withColumns({
        "apply_url_canonical": canonical_apply_url(get("apply_url_raw")), "location": F.col("_place.bucket"), "remote_scope": F.col("_place.remote_scope"),
        "term": _term(of_title.folded, signals, of_body.folded), "role": _role(of_title, of_body, get("category")), "language": _language(title, of_title.folded, of_body.folded),
        "degree_requirement": F.col("_able.degree"), "work_auth_flag": F.col("_able.work_auth"), "rejection": _screened(title, of_title, of_both, get("category"), get("employment_type")),
    }).drop("_place", "_able", *texts, *[f"{c}_hits" for c in texts])


def split_screened(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of ``normalize``; the second with reason and matched_phrase. Where a posting is never counts."""
    kept = normalized.filter("rejection is null").drop("rejection")
    return kept, to_quarantined(normalized.filter("rejection is not null"))


QUARANTINE = ("id", "source", "company", "title_raw", "reason", "first_seen", "last_seen", "apply_url_raw", "location_raw", "location", "remote_scope", "matched_phrase")


def to_quarantined(rejected: DataFrame) -> DataFrame:
    """Rejected rows as rows of the quarantine; a column that is not there is empty."""
    named = rejected.withColumn("reason", F.col("rejection.reason")).withColumn("matched_phrase", F.col("rejection.phrase"))
    return named.select(*[F.col(c) if c in named.columns else F.lit("").alias(c) for c in QUARANTINE])
