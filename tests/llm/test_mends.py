"""Many languages, heavy repeated rows, and licence headers as real files have them."""

import math
import random
from collections import Counter

import pytest

from gristmill.llm import language_id, license_scan, secret_scan, sharding

HEADERS = {
    "/* SPDX-License-Identifier: MIT */": "MIT",
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}": "MIT,Apache-2.0",
    "# SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nimport os": "MIT,GPL-2.0-only",
    "SPDX-License-Identifier: GPL-3.0+": "GPL-3.0-or-later",
    "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */\n#ifndef X": "GPL-2.0-only",
    " * SPDX-License-Identifier: GPL-2.0-or-later AND BSD-3-Clause\n": "GPL-2.0-or-later,BSD-3-Clause",
    "<!-- SPDX-License-Identifier: CC0-1.0 -->\n<p>": "CC0-1.0",
    "(* SPDX-License-Identifier: LGPL-2.1-or-later *)\nlet x = 1": "LGPL-2.1-or-later",
    "-- SPDX-License-Identifier: ISC": "ISC",
    "; SPDX-License-Identifier: AGPL-3.0-only\n": "AGPL-3.0-only",
    "Licensed under the MIT License, see LICENSE.": "MIT",
    "Distributed under the MIT License.": "MIT",
    "This project is released under the terms of the MIT license.": "MIT",
    "Available under the Apache License, Version 2.0.": "Apache-2.0",
    "Copyright 2019 Foo\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n": "Apache-2.0",
    "Copyright (c) 2020 Foo. All rights reserved.": "proprietary",
    "# Copyright (c) 2021, Bar Ltd.\n# All rights reserved.\n": "proprietary",
    "Code is licensed under MIT.": "MIT",
    "It is distributed under the terms of the GNU General Public License, version 3.": "GPL-3.0-only",
    "published under the Mozilla Public License, version 2.0.": "MPL-2.0",
    "All of it is provided under the BSD 2-Clause License.": "BSD-2-Clause",
    "licensed under the\n# BSD 3-Clause License": "BSD-3-Clause",
    "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy": "MPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License v. 2.0 which is": "",
    "/*\n * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n */": "LGPL-2.1-or-later",
    "%% This program is free software: you can redistribute it and/or modify\n%% it under the terms of the GNU Affero General Public License as published by\n%% the Free Software Foundation, either version 3 of the License, or\n%% (at your option) any later version.": "AGPL-3.0-or-later",
    "I read the MIT License and liked it.": "",
    "We take permission seriously; no license is meant here.": "",
    "The rights of all are reserved.": "",
}
BSD = """Copyright (c) 2009 The Go Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""


def test_headers_of_real_files(spark):
    rows = [*HEADERS.items(), (BSD, "BSD-3-Clause"), ("\n".join(f"// {x}" for x in BSD.split("\n")), "BSD-3-Clause"), (BSD.replace("Google Inc.", "the copyright holder"), "BSD-3-Clause")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(docs).collect()}
    for i, (text, want) in enumerate(rows):
        assert set(got[i].split(",")) == set(want.split(",")), (text, got[i])


def test_every_label_is_learned(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(30)] for i in range(120)}
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(k * 10 + j, say(words), lang) for k, (lang, words) in enumerate(tongues.items()) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.learn(docs, model=120 * 900)
    assert set(samples) == set(tongues) and all(len(t) <= 902 for t in samples.values())
    got = language_id.identify(docs).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 0


@pytest.mark.parametrize("shards", [16, 5])
def test_bytes_stay_even_with_heavy_repeated_rows(spark, shards):
    rng = random.Random(1)
    rows = [(7, "x" * 1000)] * 300 + [(i, "y" * rng.randrange(400)) for i in range(1000, 1600)] + [(9, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sharding.shard_report(docs, shards).collect()
    assert len(got) == len(rows)
    weight, slots = Counter(), {}
    for r in got:
        weight[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    share = sum(weight.values()) / shards
    assert len(weight) == shards and max(abs(w - share) for w in weight.values()) <= 1001 + 0.002 * share
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_gated_candidates_count_as_tests(spark):
    rng = random.Random(11)
    secrets = ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(20)) for _ in range(200)]
    plain = ["".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(4000)]
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    alone, among = (secret_scan.cutoffs(frame(t))[0] for t in (secrets, secrets + plain))
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    assert alone < among and tail(among) <= secret_scan.RATE * len(secrets) / (len(secrets) + len(plain)) < tail(alone)


def test_ending_vocabulary_splits_as_its_tokenizer():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from gristmill.llm import fertility

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(7)
    plain.encode_special_tokens = True
    some = lambda lo, hi: chr(rng.randrange(lo, hi))
    words = ["Don't", "A", "a1!", "<|endoftext|>", "naïve", "ΑΣ", "İx", "é", "</w>", "\x00A", "\U0001f9ff一龘"]
    words += ["".join(rng.choice([some(33, 127), some(0xA1, 0x250), "'S", "the", "ing", some(1, 0xD7FF)]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    words = [w for w in words if w.strip()]
    split = fertility._Vocabulary(path).split
    assert split.__name__ == "split_all"  # not the slow way
    assert split(words) == [x.ids for x in plain.encode_batch([" " + w for w in words], add_special_tokens=False)]


def test_words_are_split_once_over_batches(monkeypatch):
    import numpy as np

    from gristmill.llm import fertility

    class Letters:
        of_bytes, asked, tokens, measure = np.zeros(0x3000, dtype=bool), [], fertility._Vocabulary.tokens, fertility._Vocabulary.measure

        def split(self, words):
            self.asked += words
            return [list(map(ord, w)) for w in words]

    store = fertility._Words([Letters()])
    for at_once in (1, 100_000):
        monkeypatch.setattr(fertility, "MEASURED_AT_ONCE", at_once)
        for words, codes in ((["ab", "b"], [[0, 1, 1], [], [1]]), (["b", "cc"], [[1, 0]])):
            got = list(store.measure(words, [np.array(c, dtype="int32") for c in codes]))
            assert [(chars, n) for chars, n, _ in got] == [(sum(len(words[i]) for i in c), [sum(len(words[i]) for i in c)]) for c in codes]
            for (_, _, (per, _, entropy)), c in zip(got, codes, strict=True):
                letters = "".join(words[i] for i in c)
                shares = [letters.count(x) / len(letters) for x in set(letters)]
                assert per == (1.0 if letters else 0.0) and abs(entropy + sum(p * np.log2(p) for p in shares)) < 1e-12
    assert Letters.asked == ["ab", "b", "cc"]
    monkeypatch.setattr(fertility, "KNOWN_WORDS", 3)
    assert store.numbers(["b", "d"]).tolist() == [0, 1] and Letters.asked == ["ab", "b", "cc", "b", "d"]  # begun anew
