"""Licence scan by sentence rules: known licence sentences become identifiers, ordered rules match their sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Licence sentences in normalised form (A-Z lower-cased, every run of other characters
# than a-z and 0-9 one space), by identifier.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-licensed": "licensed under the isc license",
    "apache2-licensed": "licensed under the apache license version 2 0",
    "apache2-licensed-the": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-licensed": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-licensed": "licensed under the gnu lesser general public license version 3",
    "agpl3-licensed": "licensed under the gnu affero general public license version 3",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-details": "see the gnu affero general public license for more details",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "licensed under the bsd 3 clause license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc4-licensed": "licensed under cc by nc 4 0",
    "cc-by4-licensed": "licensed under cc by 4 0",
    "cc-by-sa4-licensed": "licensed under cc by sa 4 0",
    "cc0-dedicated": "licensed under cc0 1 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-mpl2": "spdx license identifier mpl 2 0",
    "spdx-gpl2": "spdx license identifier gpl 2 0 only",
    "spdx-gpl2-later": "spdx license identifier gpl 2 0 or later",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-gpl3-later": "spdx license identifier gpl 3 0 or later",
    "spdx-lgpl21-later": "spdx license identifier lgpl 2 1 or later",
    "spdx-lgpl3-later": "spdx license identifier lgpl 3 0 or later",
    "spdx-agpl3-later": "spdx license identifier agpl 3 0 or later",
    "spdx-cc0": "spdx license identifier cc0 1 0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-gpl2-plain": "spdx license identifier gpl 2 0",
    "spdx-gpl3-plain": "spdx license identifier gpl 3 0",
    "spdx-lgpl21": "spdx license identifier lgpl 2 1 only",
    "spdx-lgpl3": "spdx license identifier lgpl 3 0 only",
    "spdx-agpl3": "spdx license identifier agpl 3 0 only",
    "spdx-epl2": "spdx license identifier epl 2 0",
    "mit-short": "licensed under mit",
    "apache2-short": "licensed under apache 2 0",
    "apache2-name": "licensed under the apache 2 0 license",
    "mpl2-licensed": "licensed under the mozilla public license version 2 0",
    "gpl3-short": "licensed under the gpl version 3",
    "gpl2-short": "licensed under the gpl version 2",
    "bsd2-licensed": "licensed under the bsd 2 clause license",
    "all-rights": "all rights reserved copyright",
    "all-rights-said": "all rights reserved",
}

# Fixed values: (licence, kind, identifiers in order). Earlier rules take their identifiers first.
RULES = (
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "permissive", ("mit-grant", "mit-notice")),
    ("MIT", "permissive", ("mit-released",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("MIT", "permissive", ("spdx-mit",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("ISC", "permissive", ("isc-licensed",)),
    ("ISC", "permissive", ("spdx-isc",)),
    ("Apache-2.0", "permissive", ("apache2-licensed-the", "apache2-use", "apache2-copy")),
    ("Apache-2.0", "permissive", ("apache2-licensed-the", "apache2-use")),
    ("Apache-2.0", "permissive", ("apache2-licensed-the",)),
    ("Apache-2.0", "permissive", ("apache2-licensed",)),
    ("Apache-2.0", "permissive", ("spdx-apache2",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-free",)),
    ("AGPL-3.0-or-later", "copyleft", ("spdx-agpl3-later",)),
    ("AGPL-3.0-only", "copyleft", ("agpl3-licensed",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-free",)),
    ("LGPL-3.0-or-later", "copyleft", ("spdx-lgpl3-later",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl3-licensed",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21-free",)),
    ("LGPL-2.1-or-later", "copyleft", ("spdx-lgpl21-later",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", "copyleft", ("gpl-free",)),
    ("GPL-3.0-or-later", "copyleft", ("spdx-gpl3-later",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-work",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-licensed",)),
    ("GPL-3.0-only", "copyleft", ("spdx-gpl3",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-free",)),
    ("GPL-2.0-or-later", "copyleft", ("spdx-gpl2-later",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-only-free",)),
    ("GPL-2.0-only", "copyleft", ("spdx-gpl2",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-licensed",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", "permissive", ("bsd-licensed",)),
    ("BSD-3-Clause", "permissive", ("spdx-bsd3",)),
    ("BSD-2-Clause", "permissive", ("spdx-bsd2",)),
    ("MPL-2.0", "copyleft", ("mpl2-subject",)),
    ("MPL-2.0", "copyleft", ("spdx-mpl2",)),
    ("EPL-2.0", "copyleft", ("epl2-terms",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc4-licensed",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa4-licensed",)),
    ("CC-BY-4.0", "permissive", ("cc-by4-licensed",)),
    ("CC0-1.0", "permissive", ("cc0-dedicated",)),
    ("CC0-1.0", "permissive", ("spdx-cc0",)),
    ("Unlicense", "permissive", ("unlicense-free",)),
    ("Unlicense", "permissive", ("spdx-unlicense",)),
    ("GPL-2.0-only", "copyleft", ("spdx-gpl2-plain",)),
    ("GPL-3.0-only", "copyleft", ("spdx-gpl3-plain",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-short",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-short",)),
    ("LGPL-2.1-only", "copyleft", ("spdx-lgpl21",)),
    ("LGPL-3.0-only", "copyleft", ("spdx-lgpl3",)),
    ("AGPL-3.0-only", "copyleft", ("spdx-agpl3",)),
    ("EPL-2.0", "copyleft", ("spdx-epl2",)),
    ("MIT", "permissive", ("mit-short",)),
    ("Apache-2.0", "permissive", ("apache2-short",)),
    ("Apache-2.0", "permissive", ("apache2-name",)),
    ("MPL-2.0", "copyleft", ("mpl2-licensed",)),
    ("BSD-2-Clause", "permissive", ("bsd2-licensed",)),
    ("proprietary", "restricted", ("all-rights",)),
)
#: Licence, kind and identifier that count only where no rule matched: open licences reserve all rights too.
OTHERWISE = ("proprietary", "restricted", "all-rights-said")

# What a text may say for "licensed", and what may stand after "under the".
VERBS = ("released", "distributed", "available", "provided", "published", "offered")
TERMS = ("terms of the", "terms and conditions of the", "conditions of the")

#: Every known sentence has one of these; texts that have none are not split.
TRIGGER = r"(?i)licen[sc]e|copyright|rights reserved|permission|redistribut|warranty|unencumbered"
# Sentences that have a full stop or a blank line inside, by the words before it.
STOPS_WITHIN = {"apache2-copy": "at", "mpl2-subject": "v", "epl2-terms": "v"}
#: Line ends, and marks of a comment or a list at the head of a line.
_LINE = r"\x0D\x0A|[\x0A-\x0D]"
_TAIL = r"(?m)[\x20\x09]*(?:\*+/|--+>|\*\))[\x20\x09]*$"
_MARK = r"(?m)^[\x20\x09]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--+|(?:dnl|rem)(?=[\x20\x09]|$))[\x20\x09]*)+"
#: A full stop, question or exclamation mark before white space, or a blank line, ends a sentence for good.
_STOP = r"[.!?]+[\"')\]\x{201D}\x{2019}]*(?=[\x20\x0A\x09]|$)|\x0A[\x20\x09]*(?=\x0A)"
#: A colon, semicolon, comma or line end may end one or lie within one.
_PAUSE = r"[:;,](?=[\x20\x0A\x09]|$)|\x0A"
#: The rest of a line behind a tag, to which its expression is held.
_TAG = r"(?<=spdx-license-identifier:[^\x0A]{0,300})"
#: Expressions of several licences become a tag for each: joined by AND or OR, with exceptions, ``+`` for later ones.
_EXPRESSION = ((rf"{_TAG}[\x20()]+with[\x20]+[a-z0-9.-]+", ""), (rf"{_TAG}(?<=gpl-[0-9.]{{3}})\+", "-or-later"), (rf"{_TAG}[\x20()]+(?:and|or)[\x20(]+", "\nspdx-license-identifier: "), (rf"{_TAG}[()]", " "))
#: A holder's name where the known sentence says copyright holder.
_HOLDER = r"(?<= neither (?:[LX] )?the (?:[LX] )?name (?:[LX] )?of )(?:[a-z0-9LX]+ ){1,12}?(?=(?:L )*nor (?:L )*the (?:L )*names)"


def _pattern(sentences: dict[str, str]) -> str:
    """Any of the sentences, from a word's start to a sentence's end; the longest that fits at a place."""

    def form(name: str, said: str) -> str:
        words = said.split()
        gaps = ["(?:[LX] )*" if STOPS_WITHIN.get(name) == w else "(?:L )*" for w in words[:-1]]
        return "".join(f"{w} {g}" for w, g in zip(words, gaps)) + words[-1]

    longest = sorted(sentences.items(), key=lambda x: -len(x[1]))
    spread = lambda words: words.replace(" ", " (?:L )*")
    named = "|".join(spread(said.removeprefix(_UNDER)) for _, said in longest if said.startswith(_UNDER))
    said_so = f"(?:{'|'.join(VERBS)}|licensed) (?:L )*under (?:L )*the (?:L )*(?:(?:{'|'.join(map(spread, TERMS))}) (?:L )*)?(?:{named})"
    return "(?<= )(?:" + "|".join(form(*x) for x in longest) + f"|{said_so})(?= [LX])"


_UNDER = "licensed under the "


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, also where they are wrapped, stand in comments or
    end a longer sentence. Of those that begin at one place the longest counts; they do not overlap."""
    known = F.create_map(*[F.lit(x) for name, said in sentences.items() for x in (said, name)])
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(text), _LINE, "\n"), _TAIL, ""), _MARK, "")
    tagged = reduce(lambda acc, x: F.regexp_replace(acc, *x), _EXPRESSION, lines)
    lines = F.when(lines.contains("spdx-license-identifier:"), tagged).otherwise(lines)
    # Nothing is upper-case any more, so X and L can stand for stops and pauses.
    marked = F.regexp_replace(F.regexp_replace(lines, _STOP, " X "), _PAUSE, " L ")
    plain = F.concat(F.lit(" "), F.regexp_replace(marked, "[^a-z0-9LX]+", " "), F.lit(" X "))
    plain = F.regexp_replace(plain, _HOLDER, "the copyright holder ")
    found = F.regexp_extract_all(plain, F.lit(_pattern(sentences)), F.lit(0))
    own_words = F.transform(found, lambda s: F.regexp_replace(s, "[LX] ", ""))
    usual = lambda s: F.regexp_replace(s, f"^(?:{'|'.join(VERBS)}|licensed) under the (?:(?:{'|'.join(TERMS)}) )?", _UNDER)
    return F.transform(own_words, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, usual(s))))


def match_rules(ids: Column, rules=RULES) -> Column:
    """Licences whose identifiers follow each other in ``ids`` (sentences that are not known may lie between),
    in the order of the rules; identifiers that a rule took are gone for later ones."""
    left = F.concat(F.lit(" "), F.array_join(F.filter(ids, lambda x: x != OTHERWISE[2]), "  "), F.lit(" "))
    found = []
    for licence, _, wanted in rules:
        said = "".join(f" {x} " for x in wanted)
        found.append(F.when(left.contains(said), F.lit(licence)))
        left = F.replace(left, F.lit(said), F.lit(" # "))
    hits = F.array_distinct(F.array_compact(F.array(*found)))
    reserved = F.when(F.array_contains(ids, OTHERWISE[2]), F.array(F.lit(OTHERWISE[0])))
    return F.coalesce(F.when(F.size(hits) > 0, hits), reserved, hits)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_sentences, sentence_ids, licenses, strictest) for every row of ``docs``.

    A null or empty text has no sentences. Texts without a known sentence have 0, '', '' and null.
    ``strictest`` is the first of restricted, noncommercial, copyleft, permissive among the matches.
    One pass over the rows without a shuffle; ties and repeated rows are judged alike; other columns
    are not looked at.
    """
    none = F.array().cast("array<string>")
    ids = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(TRIGGER), sentence_ids(F.col(text_col))).otherwise(none).alias("ids"))
    hits = ids.withColumn("hits", F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(none))
    kind = F.coalesce(*[
        F.when(F.arrays_overlap("hits", F.array(*[F.lit(x) for x in dict.fromkeys(n for n, k, _ in RULES if k == level)])), F.lit(level))
        for level in ("restricted", "noncommercial", "copyleft", "permissive")
    ])
    return hits.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("hits", ",").alias("licenses"), kind.alias("strictest"),
    )
