"""Licences, languages, encoding, quality, token files."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import crf_language, forced_bpe, license_scan, quality_rules, token_files
from tidewatch.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000 + "x" * 50000
ODD = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "  \n\t ", "en", "s", 5), (4, LONG, "en", "s", 1), (5, "Licensed under CC BY-NC 4.0.", "en", "s", 1), (5, "Licensed under CC BY-NC 4.0.", "en", "s", 1), (None, "été ß 123", "fr", "s", 1)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# licences

MIT = """Copyright (c) 2020 A. B.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO FITNESS."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


@pytest.mark.parametrize("text,want", [(MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), ("x.\nReleased under the MIT License.", ["MIT"]), ("a b\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]), ("// SPDX-License-Identifier: BSD-3-Clause\n", ["BSD-3-Clause"]), ("no such words", []), ("this license is odd.", [])])
def test_licences(text, want):
    assert license_scan.licences([x for _, x in license_scan.identifiers(text)]) == want


GPL = """This program is free software{sep} you can redistribute it and/or modify
it under the terms of the GNU {l}General Public License as published by
the Free Software Foundation{mid} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {l}General Public License for more details."""
BSD = """Copyright (c) 2020, A. B. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
THIRD = """3. Neither the name of {who} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
STANDARD = [
    ("GPL-2.0-or-later", GPL.format(sep=";", l="", mid=";", v=2)), ("GPL-3.0-or-later", GPL.format(sep=":", l="", mid=",", v=3)), ("LGPL-2.1-or-later", GPL.format(sep=";", l="Lesser ", mid=";", v="2.1").replace("program", "library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", BSD.format(third="")), ("BSD-3-Clause", BSD.format(third=THIRD.format(who="the copyright holder"))), ("BSD-3-Clause", BSD.format(third=THIRD.format(who="A. B. Inc."))),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY.'),
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("Apache-2.0", APACHE),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@pytest.mark.parametrize("licence,text", STANDARD)
def test_standard_texts(licence, text):
    commented = "/*\n" + "\n".join(f" * {x}".rstrip() for x in text.split("\n")) + "\n */"
    for form in (text, " ".join(re.sub(r"(?m)^# ?", "", text).split()), commented):
        assert license_scan.licences([x for _, x in license_scan.identifiers(form)]) == [licence], form


@pytest.mark.parametrize("text,want", [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR MIT", ["GPL-2.0-or-later", "MIT"]), ("SPDX-License-Identifier: odd-1.0", ["odd-1.0"]),
    ("# SPDX-License-Identifier: Apache-2.0\n" + APACHE, ["Apache-2.0"]), ("The code is under the MIT license.", ["MIT"]), ("BSD 3-Clause License\n\nCopyright (c) 2020", ["BSD-3-Clause"]), ("Released under the LGPL v2.1", ["LGPL-2.1-only"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("CC0 1.0 Universal\n\nx", ["CC0-1.0"]), ("Licensed under the GNU Affero General Public License v3.0", ["AGPL-3.0-only"]), ("available under the Artistic License 2.0", ["Artistic-2.0"]),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ["EPL-2.0"]), ("Dedicated work. It is released into the public domain.", ["public-domain"]),
])
def test_notices(text, want):
    assert list(dict.fromkeys(license_scan.licences([x for _, x in license_scan.identifiers(text)]))) == want


def test_known_sentences_have_critical_words():
    for pattern in [p for n, p in license_scan.SENTENCES if n != "free-software"] + [p for _, p in license_scan.NAMES]:
        for branch in pattern.split("|") if "(" not in pattern else [pattern]:
            assert license_scan.speaks(branch.replace("\\", "")), branch


@pytest.mark.parametrize("before", ["x" * 100_000, "word " * 20_000, "line without an end\n" * 5_000, "a;b " * 20_000])
def test_notices_at_any_place(before):
    for notice, want in (("Released under the MIT License.", "MIT"), (" ".join(MIT.split()), "MIT"), (GPL.format(sep=";", l="", mid=";", v=2), "GPL-2.0-or-later")):
        for after in ("", " more words" * 1000):
            assert license_scan.licences([x for _, x in license_scan.identifiers(f"{before} {notice}{after}")]) == [want]


def brute_identifiers(text):
    """Paragraphs, sentences and known sentences by trying every pattern at every place."""
    signs, out, k = set(" \t\r#*/|;%-"), [], 0
    paragraphs, held = [], []
    for line in text.split("\n"):
        if set(line) <= signs and held and k:
            paragraphs.append("\n".join(held))
            held = []
        else:
            held.append(line)
        k += 1
    paragraphs.append("\n".join(held))
    known = [(f"{n}", re.compile(rf"(?:{p})(?![\w-])")) for n, p in license_scan.SENTENCES]
    end, bare = r"(?![\w+-]|\.\d)", license_scan.NAMES + license_scan.SHORT
    article, terms = "(?:the |a |an )?", "(?:terms (?:and conditions )?of )?(?:either (?:of )?|both )?"
    verb = "(?:licensed|released|distributed|available|published|provided|offered)"
    names = [(f"notice:{n}", re.compile(rf"(?:under|by|subject to) {article}{terms}{article}(?:{p}){end}")) for n, p in license_scan.NAMES]
    names += [(f"notice:{n}", re.compile(rf"{verb} under {article}{terms}{article}(?:{p}){end}|license ?[:=] ?(?:{p}){end}|(?:{p}){end}[ -]licensed(?![\w-])")) for n, p in bare]
    further = [(f"notice:{n}", re.compile(rf"(?:,? (?:and|or) |, ?|/ ?)(?:the )?(?:{p}){end}")) for n, p in bare]
    month = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
    titles = [(f"title:{n}", re.compile(rf"(?:the )?(?:{p}){end}(?=$|[, ]*\(|,? copyright|,? version|,? (?:\d\d? )?{month} \d{{4}}|,? http)", re.M)) for n, p in license_scan.NAMES]
    taken_back = re.compile(rf"(?:\bnot|\bnever|n[o']?t)(?: (?:been |currently |yet ))?(?: ?{verb})? *$")
    for paragraph in paragraphs:
        sentences, now = [], ""
        for i, c in enumerate(paragraph):
            nxt = paragraph[i + 1] if i + 1 < len(paragraph) else "\n"
            rest = paragraph[i + 1 :].lstrip(" \t")
            stop = c in ".!?;" and (nxt.isspace() or nxt in ".!?;" and not paragraph[i:].lstrip(".!?;")[:1].strip()) or c == ":" and (rest[:1] in ("", "\n") or nxt.isspace() and re.search("conditions( are met)?$", now, re.I))
            if stop:
                sentences.append(now)
                now = ""
            else:
                now += c
        sentences = [x for x in map(license_scan.normalised, [*sentences, now]) if x]
        lines, i, told = "\n".join(sentences), 0, set()
        found = []
        while i < len(lines):
            hit = None
            if i == 0 or not re.match(r"[\w-]", lines[i - 1]):
                hit = next(((n, m) for n, p in known + names if (m := p.match(lines, i))), None)
                if hit and hit[0].startswith("notice:") and taken_back.search(lines[max(0, i - 40) : i].rpartition("\n")[2]):
                    i = hit[1].end()
                    continue
                if hit is None and (i == 0 or lines[i - 1] == "\n"):
                    hit = next(((n, m) for n, p in titles if (m := p.match(lines, i))), None)
            if hit is None:
                i += 1
                continue
            while hit:
                n, m = hit
                found.append((i, f"spdx:{m['spdx']}" if n == "spdx" else f"{n}:{m['epl']}" if n == "epl-available" else n))
                told.update(range(lines.count("\n", 0, i), lines.count("\n", 0, m.end()) + 1))
                i = m.end()
                hit = next(((n, m) for n, p in further if (m := p.match(lines, i))), None) if n.startswith("notice:") else None
        at = 0
        for n, x in enumerate(sentences):
            if n not in told and any(w in x for w in license_scan.WORDS):
                found.append((at, license_scan.UNKNOWN))
            at += len(x) + 1
        out += [x for _, x in sorted(found)]
    return out


def test_license_scan_against_brute_force():
    random.seed(7)
    bits = [t for _, t in STANDARD] + ["the licence is odd", "Permission is denied.", "SPDX-License-Identifier: MIT OR ISC", "the code is under the MIT license", "it is not licensed under the ISC license", "MIT licensed", "license: BSD", "plain words", "Apache License\nVersion 2.0", "BSD License", "Copyright (c) 2001 X", "a copy of the MPL", "in the public domain; so it is", "you may not", "see the"]
    joints = [" ", "\n", ". ", "; ", "\n\n", "\n# ", "\n//\n", ": ", ":\n", "?! ", ", "]
    for _ in range(150):
        text = "".join(random.choice(bits) + random.choice(joints) for _ in range(random.randint(1, 6)))
        assert [x for _, x in license_scan.identifiers(text)] == brute_identifiers(text), text


def test_license_scan_rows(odd, none):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == 7 and [r.licences for r in rows if r.doc_id == 5] == [["CC-BY-NC-4.0"]] * 2
    assert all(r.n_sentences == 0 for r in rows if r.doc_id in (1, 2, 3, 4)) and license_scan.scan(none).count() == 0
    assert [r.n_sentences for r in rows if r.doc_id is None] == [0]
    clash = odd.withColumnsRenamed({"lang": "sentences", "source": "a.b"}).withColumnRenamed("doc_id", "t")
    assert sorted(map(str, license_scan.scan(clash, "t").collect())) == sorted(str(r).replace("doc_id", "t") for r in rows)


# language


def test_forward_backward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, trans, sizes, want, at = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([5, 1, 3]), [], 0
    for n in sizes:
        m = np.zeros((n, 3))
        for y in product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + t, y[t]] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1)))
            for t in range(n):
                m[t, y[t]] += w
        want.append(m / m.sum(1, keepdims=True))
        at += n
    for block in (2, 3, 32):
        np.testing.assert_allclose(crf_language.forward_backward(scores, trans, sizes, block)[0], np.concatenate(want), atol=1e-12)


def test_segments_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    crf = crf_language.Crf(["a", "b", "c"], rng.normal(size=(1024, 3)).astype(np.float32) / 3, {"w3": [1]}, np.eye(3, dtype=np.float32), rng.normal(size=(3, 3)))
    words = [f"w{chr(97 + k)}" for k in rng.integers(0, 20, 101)]
    whole = crf.marginals(words, np.array([101]))
    for size in (1, 7, 50, 101, 200):
        np.testing.assert_allclose(np.concatenate(list(crf.segments(words, size))), whole, atol=1e-10)
    texts = [" ".join(words), "", "wa wb", " ".join(words[:30]), None, "wc"]
    docs = spark.createDataFrame([(i, t, "a", "s", 1) for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    once = [r[1:] for r in crf_language.predict(docs, crf).collect()]
    monkeypatch.setattr(crf_language, "SEGMENT_SCORES", 40)
    for (a, x, *more), (b, y, *same) in zip(once, [r[1:] for r in crf_language.predict(docs, crf).collect()]):
        assert (a, more) == (b, same) and abs(x - y) < 1e-9


def test_features_are_of_their_word():
    alone = [sorted(crf_language.features([w])[0].tolist()) for w in ("été", "a", "word")]
    slots, owners = crf_language.features(["été", "a", "word"])
    assert [sorted(slots[owners == k].tolist()) for k in range(3)] == alone


def test_every_letter_counts():
    assert crf_language.words_of("½ ² 3 _ \u0301") == [] and crf_language.words_of(None) == []
    assert crf_language.words_of("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"] and crf_language.words_of("東京ですABC สวัสดี") == [*"東京です", "abc", "ส", "วั", "ส", "ดี"]
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    assert "".join(crf_language.words_of(long)) == long and max(map(len, crf_language.words_of(long))) == crf_language.LONGEST
    assert "".join(crf_language.words_of("中" * 5000 + long)) == "中" * 5000 + long
    one, other = ("x" * 60 + y for y in "ab")
    assert sorted(crf_language.features(crf_language.words_of(one))[0]) != sorted(crf_language.features(crf_language.words_of(other))[0])
    assert len(crf_language.features(["a" + "\u0301" * 200])[0]) == 1 + 202 + 201 + 8  # itself, two and three letters, affixes


def test_unspaced_and_marked_scripts(spark):
    samples = {"zh": "我们今天去图书馆看书学习新的知识", "ja": "きょうは図書館へ行って本を読みました", "th": "วันนี้เราไปห้องสมุดเพื่ออ่านหนังสือ", "hi": "आज हम पुस्तकालय में किताबें पढ़ने गए थे", "en": "today we went to the library to read new books"}
    rng = random.Random(3)
    rows, k = [], 0
    for lang, text in samples.items():
        units = text.split(" ") if " " in text else list(text)
        for _ in range(60):
            rows.append((k, (" " if " " in text else "").join(rng.choice(units) for _ in range(30)), lang, "s", 1))
            k += 1
    docs = spark.createDataFrame(rows, SCHEMA)
    told = crf_language.predict(docs, crf_language.train(docs), ["doc_id", "lang"]).filter(crf_language.held_out(F.col("row.doc_id"))).collect()
    assert len(told) > 30 and sum(r.row.lang == r.lang_pred for r in told) / len(told) > 0.95


def test_every_label_is_a_class(spark):
    words = [f"{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(80)]
    docs = spark.createDataFrame([(k * 10 + j, " ".join([w * 2] * 12), w, "s", 1) for k, w in enumerate(words) for j in range(6)], SCHEMA)
    crf = crf_language.train(docs)
    assert crf.langs == sorted(words) and crf_language.slots_for(4) == crf_language.SLOTS > crf_language.slots_for(1000)
    told = crf_language.predict(docs, crf, ["lang"]).collect()
    assert sum(r.row.lang == r.lang_pred for r in told) / len(told) > 0.9


#: Notices as people write them, and the licences that they name, written by hand.
NOTICES = [
    ("Licensed under GPL-3.0-or-later", "GPL-3.0-or-later"), ("released under the GPLv2 or later.", "GPL-2.0-or-later"), ("It is licensed under GPLv3+.", "GPL-3.0-or-later"),
    ("distributed under the GNU GPL version 2 or any later version", "GPL-2.0-or-later"), ("under the terms of the GNU General Public License v3.0 or later", "GPL-3.0-or-later"),
    ("under LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("under the LGPLv3 or newer", "LGPL-3.0-or-later"), ("licensed under AGPL-3.0+", "AGPL-3.0-or-later"), ("under the GNU AGPL v3 or (at your option) any later version", "AGPL-3.0-or-later"),
    ("under the terms of the GNU Lesser General Public License, version 2.1, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("Licensed under GPL-3.0-only", "GPL-3.0-only"), ("under the GPLv2 only", "GPL-2.0-only"), ("Licensed under the GPL v2.", "GPL-2.0-only"), ("under the GNU GPL, version 3", "GPL-3.0-only"), ("under LGPL-2.1", "LGPL-2.1-only"), ("under the AGPLv3 license", "AGPL-3.0-only"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version.", "GPL-2.0-or-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1, or any later version.", "LGPL-2.1-or-later"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0-only"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0-only"), ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "AGPL-3.0-only"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPL-2.1-only"),
    ("Apache License, Version 2.0, January 2004", "Apache-2.0"), ("The MIT License (MIT)", "MIT"), ("BSD 3-Clause License", "BSD-3-Clause"), ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("This project is MIT licensed.", "MIT"), ("The code is BSD-3-Clause licensed", "BSD-3-Clause"), ("is Apache 2.0 licensed", "Apache-2.0"), ("License: MIT", "MIT"), ('license = "MIT"', "MIT"), ('"license": "ISC"', "ISC"), ("Licence: Apache-2.0", "Apache-2.0"), ("license: GPL-3.0-or-later", "GPL-3.0-or-later"), ("License: BSD", "BSD"),
    ("Dual licensed under MIT and Apache 2.0", "MIT Apache-2.0"), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0 MIT"), ("available under MIT or GPLv2+", "MIT GPL-2.0-or-later"), ("licensed under the MIT, Apache-2.0 and ISC licenses", "MIT Apache-2.0 ISC"),
    ("License: MIT OR Apache-2.0", "MIT Apache-2.0"), ("Not under the MIT license", ""), ("This is not licensed under the GPLv3.", ""), ("It was never released under the Apache License, Version 2.0.", ""), ("The study was done under MIT supervision.", ""), ("We met at MIT and ISC.", ""), ("Read the license before use.", ""),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT Apache-2.0"), ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "GPL-2.0-only"),
]


@pytest.mark.parametrize("around", ["{}", "See below.\n\n{}\n\nThanks.", "# {}", " * {}", "Note. {}"])
def test_notices_written_by_hand(around):
    wrong = []
    for text, want in NOTICES:
        names = [x for _, x in license_scan.identifiers(around.format(text.replace("\n", "\n# ") if around == "# {}" else text.replace("\n", "\n * ") if around.startswith(" *") else text))]
        got = list(dict.fromkeys(license_scan.licences(names)))
        if got != want.split():
            wrong.append((text, got))
    assert not wrong


def md5_of(k):
    return hashlib.md5(str(k).encode()).hexdigest()


@pytest.mark.parametrize("pick", [min, max])
def test_an_id_that_rows_repeat_counts_once(spark, monkeypatch, pick):
    """One English id on thousands of rows, of lowest or highest mark, beside German rows: both languages are learned, from bounded texts."""
    ids = [k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 5]
    one = pick(ids, key=md5_of)
    english, german = "the cat sat on the mat here and there was a hat", "der hund lief durch den wald und dann nach haus"
    rows = [(one, english, "en", "s", 1)] * 5000 + [(k, german, "de", "s", 1) for k in ids if k != one][:4]
    seen = []
    kept = crf_language.fit
    monkeypatch.setattr(crf_language, "fit", lambda chains, langs: seen.extend(chains) or kept(chains, langs))
    crf = crf_language.train(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert crf.langs == ["de", "en"] and sum(len(w) for w, _ in seen) < 2000
    texts = spark.createDataFrame([(1, "the cat sat on the mat here", "x", "s", 1), (2, "der hund lief durch den wald", "x", "s", 1)], SCHEMA)
    assert {r.row.doc_id: r.lang_pred for r in crf_language.predict(texts, crf).collect()} == {1: "en", 2: "de"}


def test_of_unlike_rows_of_an_id_the_smallest_digest_is_learned(spark, monkeypatch):
    a, b = sorted(("alpha beta gamma", "delta epsilon zeta"), key=md5_of)
    k = next(k for k in range(1, 50) if zlib.crc32(str(k).encode()) % 5)
    seen = []
    monkeypatch.setattr(crf_language, "fit", lambda chains, langs: seen.extend(chains))
    crf_language.train(spark.createDataFrame([(k, b, "el", "s", 1), (k, a, "el", "s", 1), (k, None, "el", "s", 1), (k, a, "el", "t", 2), (k, "12 34", "nn", "s", 1)], SCHEMA))
    assert [w for w, _ in seen] == [a.split()]


def test_ties_and_long_texts():
    crf = crf_language.Crf(["aa", "bb"], np.zeros((256, 2), np.float32), {}, np.zeros((2, 2), np.float32), np.zeros((2, 2)))
    assert {(x, p) for _, x, p in crf_language.label_words(crf, "one two three")} == {("aa", 0.5)}
    assert len(crf_language.label_words(crf, "word " * 200_000)) == 200_000


def test_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = crf_language.train(docs)
    told = crf_language.predict(docs, crf, ["doc_id", "lang"]).filter(crf_language.held_out(F.col("row.doc_id")))
    right = told.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    texts = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 300 AND 900").collect()}
    mixed = crf_language.label_words(crf, " ".join(texts["de"].split()[:15] + texts["fr"].split()[:15]))
    labels = [x for _, x, _ in mixed]
    assert Counter(labels[:13]).most_common(1)[0][0] == "de" and Counter(labels[-13:]).most_common(1)[0][0] == "fr"


def test_language_of_odd_rows(odd, none):
    rows = {r.row.doc_id: r for r in crf_language.predict(odd, crf_language.train(odd)).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (1, 2, 3)) and 0 <= rows[4].score <= 1
    assert crf_language.train(none) is None and crf_language.predict(none, None).count() == 0
    assert {r.lang_pred for r in crf_language.predict(odd, None).collect()} == {"und"}
    assert crf_language.filtered(odd).columns == odd.columns
    clash = odd.withColumnsRenamed({"source": "a.b", "n_chars": "lang_pred"})
    assert crf_language.filtered(clash, 0.0).columns == clash.columns and crf_language.filtered(clash, 0.0).count() == 4


# encoding


@pytest.fixture(scope="module")
def bpe():
    return forced_bpe.ForcedBpe(open(tokenizer_path(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoding_equals_the_library(bpe, library):
    random.seed(5)
    bits = ["a", "'s", "'ve", "'", "ll", "s", " ", "  ", "\n", "\t", " ", "　", "é", "1", "12", "<|endoftext|>", "!", "...", "q", "z", "x7", "中", "😀", "́", "\x1c", "\x85", "v", "#", "_", "Ж", "²", "​", "ü", "\r\n"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 16))) for _ in range(20000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert bpe.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_every_cut_pair_is_in_no_token(bpe):
    seen = forced_bpe.inner_pairs([p for p in bpe.pieces if p != b"<|endoftext|>"])
    assert not (bpe.cuts.reshape(256, 256) & seen).any() and bpe.cuts.sum() > 1000


def test_cuts_concatenate_to_the_text(bpe):
    raw = ("The quick, brown fox's 12 Ünïcode jumps\n\n over " * 3).encode()
    assert b"".join(bpe.fragments(raw)) == raw and len(bpe.fragments(raw)) > 20


def test_wide_blanks_are_cut_too(bpe, library):
    for blank in forced_bpe.WIDE_BLANKS:
        text = f"The quick{blank}brown fox, 12 times{blank}{blank} over.{blank}'s {blank} x\n" * 3
        assert bpe.encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = [p.decode() for p in bpe.fragments(text.encode())]
        assert len(parts) > 10 and "".join(parts) == text and not any(p.startswith(blank) or p.endswith(blank) for p in parts[1:-1])
    random.seed(11)
    bits = [*forced_bpe.WIDE_BLANKS, "a", "'s", "'", " ", "\n", "Q", "7", "!", "é", "中", "😀", "Zx"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(20000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == e.ids, repr(t)


def test_encode_decode_rows(odd, none, library):
    rows = forced_bpe.encode_decode(odd, tokenizer_path(), with_ids=True).collect()
    for r, (_, text, *_) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert forced_bpe.encode_decode(none, tokenizer_path()).count() == 0


# token files


def place_of(text):
    """Spark's XXH64 of a text, signed; of null the seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


def test_shards_stand_in_the_order_of_their_numbers():
    sizes = [(f"{k:05d}", 1, 3) for k in range(100_001)]
    random.Random(1).shuffle(sizes)
    got = token_files.in_order([*sizes, ("100001", 0, 0)])
    assert [x[0] for x in got] == [f"{k:05d}" for k in range(100_001)] and [x[1] for x in got] == list(range(0, 300_003, 3))


def test_token_files(spark, odd, none, library):
    rows = [*ODD, *[(None, f"no id {k}", "en", "s", 1) for k in range(20)], *[(9, f"same id {k % 7}", "en", "s", 1) for k in range(20)]]
    for docs, shards in ((spark.createDataFrame(rows, SCHEMA), 3), (spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "h", "source": "a.b"}), None)):
        files = token_files.write(docs, tokenizer_path(), shards=shards)
        got = token_files.read(spark, files).collect()
        want, start = {}, 0
        for doc_id, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, place_of(x[1]), x[1] or "")):
            ids = library.encode(text or "", add_special_tokens=False).ids + [0]
            want[start] = (doc_id, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
            start += len(ids)
        assert {r.start: (r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    assert token_files.document(files, 0, 0)[-1] == 0
    assert token_files.read(spark, token_files.write(none, tokenizer_path())).count() == 0


def test_shards_follow_the_size(spark, monkeypatch):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 200)").alias("text"))
    monkeypatch.setattr(token_files, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(token_files, "READ_ROWS", 3)
    files = token_files.write(docs, tokenizer_path())
    assert len(files.shards) >= 8 and token_files.read(spark, files).agg(F.countDistinct("doc_id"), F.count("*")).first()[:] == (100, 100)


# quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if n[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, none):
    random.seed(2)
    texts = [" ".join(random.choice("ab#c|d é\n") + random.choice(["", "x", "\n"]) for _ in range(random.randint(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge(docs, docs["doc_id"], docs["text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r["keep"]])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    for r in quality_rules.judge(odd, F.struct("doc_id", "text"), odd["text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r["keep"].text)
    assert quality_rules.filtered(none).count() == 0


def test_filter_keeps_clashing_columns(spark):
    text = "the house and the garden of a man who is in it with one dog for you to see as it was by an old tree " * 1
    docs = spark.createDataFrame([(1, text + " ".join(f"w{i}" for i in range(40)), 7, "x"), (2, "short", 8, "y")], "doc_id long, text string, n_words int, keep string").withColumn("a.b", F.lit(3))
    rows = quality_rules.filtered(docs).collect()
    assert [(r.doc_id, r.n_words, r["keep"]) for r in rows] == [(1, 7, "x")] and quality_rules.filtered(docs).columns == docs.columns
