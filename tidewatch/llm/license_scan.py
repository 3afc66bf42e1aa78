"""License scans by sentence rules.

A text is read paragraph by paragraph.  A paragraph's sentences are normalised and set one to a line; known licence
sentences are found in them and mapped to identifiers, and the identifiers, in the order in which they stand, are
matched against ordered rules, each a sequence that names a licence.  At every place the first rule that fits takes its
identifiers.  A sentence with one of WORDS that holds no known one is ``unknown`` and breaks a sequence.

A known sentence counts wherever it stands: on a line of its own, wrapped over lines, behind comment signs, or inside a
longer sentence, however long that is.  Normalising lowers, drops comment signs, quotes and repeated white space, and
writes license and & alike.  An SPDX tag's expression names each licence in it; licences are written as SPDX writes
them, those that SPELLING doesn't hold in lower case.  Whole texts are read; paragraphs without any of WORDS or
HINTS can hold no known sentence and are not cut up.

A null or empty text has no sentences.  Rows are scanned one by one, so repeated rows get equal results; an empty table
gives an empty table; columns other than id and text play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import named, small_batches

#: A sentence that speaks of a licence has one of these, in any case; paragraphs without these or HINTS hold none.
WORDS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "spdx", "copyleft", "all rights reserved")
#: What else a known sentence may be told by.
HINTS = ("gpl", "the mpl", "mpl-", "apache", "bsd", "cc by", "cc-by", "cc0", "creative commons", "wtfpl", "epl-", "cddl", "source versions", "origin of this software", "this notice may not")
UNKNOWN = "unknown"


def _gnu(short: str, long: str, version: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """A version of a GNU licence with what says that later ones hold too, and without."""
    major, minor = version.split(".")
    number = rf"{major}(?:\.0)?(?!\.?\d)" if minor == "0" else rf"{major}\.{minor}"
    name = rf"(?:(?:gnu )?{long}(?: \({short.lower()}\))?|(?:gnu )?{short.lower()}),?(?: license)?,?[ \n]?-?(?:version |v[. ]*)?{number}(?: license)?"
    return (f"{short}-{version}-or-later", rf"{name}(?:\+|-or-later|,? or (?:\(?at your option\)? )?(?:any )?(?:later|newer|above|greater)(?: versions?)?)"), (f"{short}-{version}-only", rf"{name}(?:-only| only)?")


#: Licences that notices and titles name: SPDX identifier and pattern of the name.  Fixed values.
NAMES = (
    *_gnu("AGPL", "affero general public license", "3.0"),
    *_gnu("LGPL", "(?:lesser|library) general public license", "2.0"),
    *_gnu("LGPL", "(?:lesser|library) general public license", "2.1"),
    *_gnu("LGPL", "(?:lesser|library) general public license", "3.0"),
    *_gnu("GPL", "general public license", "2.0"),
    *_gnu("GPL", "general public license", "3.0"),
    ("GPL", r"gnu general public license|gnu gpl|gpl license"),
    ("LGPL", r"gnu lesser general public license|lgpl license"),
    ("Apache-2.0", r"apache(?: software)?(?: license)?,?(?: version| v)? ?-?v?2(?:\.0)?(?: license)?"),
    ("Apache-1.1", r"apache(?: software)? license,? (?:version |v ?)1\.1"),
    ("Apache", r"apache license"),
    ("MIT", r"mit(?: expat)? license(?: \(mit\))?|expat license"),
    ("BSD-3-Clause", r"(?:new |modified |revised )bsd license|(?:bsd )?3-clause (?:bsd )?license|bsd-3-clause(?: license)?|bsd license \(3-clause\)"),
    ("BSD-2-Clause", r"(?:simplified |freebsd )(?:bsd )?license|(?:bsd )?2-clause (?:bsd )?license|bsd-2-clause(?: license)?|bsd license \(2-clause\)"),
    ("BSD", r"bsd(?:-style)? license"),
    ("ISC", r"isc license"),
    ("MPL-2.0", r"(?:mozilla public license|mpl),?(?: version| v)? ?-?v?[. \n]*2\.0"),
    ("MPL-1.1", r"(?:mozilla public license|mpl),?(?: version| v)? ?-?v?[. \n]*1\.1"),
    ("EPL-2.0", r"(?:eclipse public license|epl)(?: -)?,?(?: version| v)? ?-?v?[. \n]*2\.0"),
    ("EPL-1.0", r"(?:eclipse public license|epl)(?: -)?,?(?: version| v)? ?-?v?[. \n]*1\.0"),
    ("CDDL-1.0", r"common development and distribution license(?: \(cddl\))?(?:,? (?:version |v ?)1\.0)?"),
    ("BSL-1.0", r"boost software license(?:,? (?:-? ?version |v ?)1\.0)?"),
    ("Zlib", r"zlib(?: libpng)? license"),
    ("Artistic-2.0", r"artistic license,? (?:version |v ?)?2\.0"),
    ("Artistic-1.0", r"artistic license(?:,? (?:version |v ?)?1\.0)?"),
    ("Unlicense", r"unlicense(?: license)?"),
    ("WTFPL", r"do what the fuck you want to public license|wtfpl"),
    ("CC0-1.0", r"(?:creative commons )?(?:cc0|zero)(?:[ -]?v?1\.0)?(?: universal)?(?: public domain dedication)?(?: license)?"),
    ("CC-BY-NC-SA-4.0", r"(?:cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-NC-ND-4.0", r"(?:cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderivatives)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-NC-4.0", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-NC-3.0", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)[ -]3\.0(?: unported)?(?: license)?"),
    ("CC-BY-NC", r"(?:cc[ -]by-nc|creative commons attribution-noncommercial)(?![\w-])(?: license)?"),
    ("CC-BY-ND-4.0", r"(?:cc[ -]by-nd|creative commons attribution-noderivatives)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-SA-4.0", r"(?:cc[ -]by-sa|creative commons attribution-sharealike)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-SA-3.0", r"(?:cc[ -]by-sa|creative commons attribution-sharealike)[ -]3\.0(?: unported)?(?: license)?"),
    ("CC-BY-4.0", r"(?:cc[ -]by|creative commons attribution)[ -]4\.0(?: international)?(?: license)?"),
    ("CC-BY-3.0", r"(?:cc[ -]by|creative commons attribution)[ -]3\.0(?: unported)?(?: license)?"),
)

#: What stands between two known halves of a sentence that holds a stop: a stop's place, or nothing of the kind.
_GAP = r"[;:,]?[ \n]"
_OR_LATER = rf"you can redistribute it and or modify it under the terms of the {{}} as published by the free software foundation{_GAP}either version {{}}(?: of the license)?,? or (?:\(at your option\) )?any later version"
#: Known sentences, as patterns over normalised ones.  Fixed values.
SENTENCES = (
    ("spdx", r"spdx-license-identifier: ?(?P<spdx>\(*[a-z0-9.+-]+\)*(?: (?:or|and|with) \(*[a-z0-9.+-]+\)*)*)"),
    ("apache2-notice", r"licensed under the apache license, version 2(?:\.0)?(?: \(the license\))?(?=[;,.]?[ \n]+you may not use)"),
    ("apache2-file", r"you may not use (?:this file|this work|this software|it) except in compliance with the license"),
    ("apache2-copy", r"you may obtain a copy of the license at"),
    ("apache2-basis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"),
    ("apache2-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("agpl3-later", _OR_LATER.format("gnu affero general public license", "3")),
    ("lgpl21-later", _OR_LATER.format("gnu lesser general public license", r"2\.1")),
    ("lgpl3-later", _OR_LATER.format("gnu lesser general public license", "3")),
    ("gpl2-later", _OR_LATER.format("gnu general public license", "2")),
    ("gpl3-later", _OR_LATER.format("gnu general public license", "3")),
    ("free-software", r"this \w+ is free software"),
    ("gpl-implied", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-hope", r"this \w+ is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl-see", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this \w+"),
    ("mpl2", r"this source code form is subject to the terms of the mozilla public license, v[. \n]*2\.0"),
    ("mpl2-copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mit-copies", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("as-is", r"the software is provided as is,? without warranty of any kind, express or implied"),
    ("isc-as-is", r"the software is provided as is and (?:the author|\w+) disclaims all warranties with regard to this software"),
    ("isc-grant", r"permission to use, copy, modify, and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-as-is", r"this software is provided as-is, without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("zlib-altered", r"altered source versions must be plainly marked as such"),
    ("zlib-notice", r"this notice may not be removed or altered from any source distribution"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", r"neither the name of (?:(?!neither the name of)[^\0])*?may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", r"this software is provided by (?:(?!this software is provided)[^\0])*?as is and any express or implied warranties"),
    ("bsl-as-is", r"distributed under the boost software license, version 1\.0"),
    ("epl-available", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: -)?,? v(?:ersion)?[. \n]*(?P<epl>[12]\.0)"),
    ("unlicense-free", r"this is free and unencumbered software released into the public domain"),
    ("cc0-waived", r"to the extent possible under law, (?:(?!to the extent)[^\n])*? waived all copyright"),
    ("public-domain", r"is (?:released into|dedicated to|placed in|in) the public domain"),
    ("public-domain", r"(?:hereby|been) (?:released into|dedicated to|placed in|in) the public domain"),
    ("copyright", r"copyright(?: \(c\)| ©)? \d{4}"),
    ("copyright", r"(?m:^)copyright\b"),
    ("all-rights", r"all rights reserved"),
)

#: Ordered rules: at a place of the sequence the first that fits names the licence.  Notices and titles come after these.
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-file", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-notice", "apache2-file", "apache2-copy", "apache2-basis")),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope", "gpl-implied", "gpl-see", "gpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gpl-hope", "gpl-implied", "gpl-see", "gpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gpl-hope", "gpl-implied", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-implied", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-implied", "gpl-see", "gpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("MIT", ("title:MIT", "mit-grant", "mit-copies", "as-is")),
    ("MIT", ("mit-grant", "mit-copies", "as-is")),
    ("MIT", ("mit-grant", "as-is")),
    ("ISC", ("title:ISC", "isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("BSL-1.0", ("title:BSL-1.0", "bsl-grant", "as-is")),
    ("BSL-1.0", ("bsl-grant", "as-is")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSD-3-Clause", ("title:BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("title:BSD-2-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("Apache-2.0", ("apache2-notice", "apache2-file")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-grant",)),
    ("BSL-1.0", ("bsl-as-is",)),
    ("MPL-2.0", ("mpl2",)),
    ("EPL-1.0", ("epl-available:1.0",)),
    ("EPL-2.0", ("epl-available:2.0",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("public-domain", ("public-domain",)),
)

#: SPDX identifiers as they are written, and the ones that older spellings stand for.  Fixed values.
SPELLING = {x.lower(): x for x in (
    "MIT", "MIT-0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-1.0", "Artistic-2.0", "Unlicense", "WTFPL", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-3.0",
    "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "PSF-2.0", "Python-2.0", "Ruby", "OFL-1.1", "NCSA", "PostgreSQL", "X11", "BlueOak-1.0.0", "EUPL-1.2", "MS-PL", "OpenSSL", "Vim", "curl",
)} | {
    "gpl-2.0": "GPL-2.0-only", "gpl-2.0+": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only", "gpl-3.0+": "GPL-3.0-or-later", "lgpl-2.1": "LGPL-2.1-only", "lgpl-2.1+": "LGPL-2.1-or-later",
    "lgpl-3.0": "LGPL-3.0-only", "lgpl-3.0+": "LGPL-3.0-or-later", "agpl-3.0": "AGPL-3.0-only", "agpl-3.0+": "AGPL-3.0-or-later",
}

#: A stop ends a sentence; so do a colon at a line's end and one behind "conditions".
STOP = re.compile(r"[.!?;]+(?=\s|\Z)|:(?=[ \t]*(?:\n|\Z))|(?<=(?i:conditions)):(?=\s)|(?<=(?i:conditions are met)):(?=\s)")
#: What parts paragraphs: a line with nothing but comment signs.
PARAGRAPH = re.compile(r"\n(?:[ \t\r#*/|;%-]*\n)+")
#: Comment signs at a line's start, and quotes and signs anywhere.
COMMENT = re.compile(r"(?m)^[ \t]*(?:#+|/[/*]+|\*+/?|;+|--+|%+|>+|<!--|dnl\b|rem\b)[ \t]*")
QUOTES, NOISE = re.compile("[\"'`“”‘’]+"), re.compile(r"[*#/|\0]+|\s+")
_AND = re.compile(r"\band/or\b")


def normalised(sentence: str) -> str:
    s = QUOTES.sub("", COMMENT.sub(" ", sentence)).lower().replace("licence", "license").replace("&", "and")
    return " ".join(NOISE.sub(" ", _AND.sub("and or", s)).split()).strip(" .!?:;,-")


#: Names that stand for a licence only where a notice or a tag says so.  Fixed values.
SHORT = (("MIT", "(?:mit|expat)(?: licenses?)?"), ("ISC", "isc(?: licenses?)?"), ("BSD", "bsd(?: licenses?)?"), ("Zlib", "zlib(?: licenses?)?"), ("Apache-2.0", "apache(?: license)?,? ?-?(?:version |v)?2(?:\\.0)?(?: licenses?)?"), ("MPL-2.0", "mpl-?2\\.0"), ("BSL-1.0", "bsl-?1\\.0"), ("Unlicense", "unlicense"), ("BSD-3-Clause", "bsd[ -]3-clause|3-clause bsd"), ("BSD-2-Clause", "bsd[ -]2-clause|2-clause bsd"))
ALL_NAMES = NAMES + SHORT
#: What may not follow a name: more of a word, or of a version.
_END = r"(?![\w+-]|\.\d)"


def _named(kind: str, of=ALL_NAMES, first: int = 0) -> str:
    """The longest kinds of names come first in NAMES, so of those that fit at a place the first counts."""
    return "(?:" + "|".join(f"(?P<{kind}{first + k}>(?:{p}){_END})" for k, (_, p) in enumerate(of)) + ")"


def _known() -> dict[str, re.Pattern]:
    """Known sentences by the word that they start with, each set in one pattern; of those that fit at a place the first counts."""
    by_word: dict[str, list[str]] = {}
    for k, (_, p) in enumerate(SENTENCES):
        first = re.match(r"(?:\(\?m:\^\))?(?:\(\?:([a-z|]+)\)|([a-z-]+))", p)
        for word in (first[1] or first[2]).split("|"):
            by_word.setdefault(word, []).append(f"(?P<s{k}>(?:{p})(?![\\w-]))")
    under = r"(?:under|by|subject to) (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:either (?:of )?|both )?(?:the |a |an )?"
    for word in ("under", "by", "subject"):
        by_word.setdefault(word, []).append(under + _named("n", NAMES))
    granted = r"(?:licensed|released|distributed|available|published|provided|offered) under (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:either (?:of )?|both )?(?:the |a |an )?"
    for word in ("licensed", "released", "distributed", "available", "published", "provided", "offered"):
        by_word.setdefault(word, []).append(granted + _named("n"))
    by_word["license"] = [r"license ?[:=] ?" + _named("n")]
    return {w: re.compile("(?:" + "|".join(ps) + ")") for w, ps in by_word.items()}


KNOWN = _known()
#: A further name of the same notice.
ALSO = re.compile(r"(?:,? (?:and|or) |, ?|/ ?)(?:the )?" + _named("n"))
#: The name before what it says: "MIT licensed".
LICENSED = re.compile(_named("n") + r"(?:[ -]licensed)(?![\w-])")
#: What takes a notice back, right before it.
DENIED = re.compile(r"(?:\bnot|\bnever|n[o']?t)(?: (?:been |currently |yet ))?(?: ?(?:licensed|released|distributed|available|published|provided|offered))?[ ]*$")
#: A licence's name as a sentence's beginning that nothing but a heading's rest follows.
TITLE = re.compile("(?:the )?" + _named("t", NAMES) + r"(?=$|[, ]*\(|,? copyright|,? version|,? (?:\d{1,2} )?(?:january|february|march|april|may|june|july|august|september|october|november|december) \d{4}|,? http)", re.M)
#: Where a known sentence may start.
START = re.compile(r"(?m)^|(?<![\w-])(?=(?:" + "|".join(sorted(map(re.escape, KNOWN))) + r")(?![\w-]))|(?<![\w-])(?=\S{2,30}(?: \S{1,20})? ?-?licensed(?![\w-]))")
FIRST = re.compile(r"[\w-]*")


def _name(m: re.Match) -> str:
    """The identifier of a match."""
    kind, k = m.lastgroup[0], int(m.lastgroup[1:])
    if kind == "n":
        return f"notice:{ALL_NAMES[k][0]}"
    if kind == "t":
        return f"title:{NAMES[k][0]}"
    name = SENTENCES[k][0]
    return f"spdx:{m['spdx']}" if name == "spdx" else f"{name}:{m['epl']}" if name == "epl-available" else name


def known_in(lines: str) -> list[re.Match]:
    """The known sentences that stand in normalised ones, set one to a line, from left to right; none overlaps another."""
    out, at = [], 0
    for start in START.finditer(lines):
        i = start.start()
        if i < at:
            continue
        pattern = KNOWN.get(FIRST.match(lines, i)[0])
        m = pattern.match(lines, i) if pattern else None
        m = m or LICENSED.match(lines, i)
        if m is None and (i == 0 or lines[i - 1] == "\n"):
            m = TITLE.match(lines, i)
        if m and m.lastgroup[0] == "n" and DENIED.search(lines[max(0, i - 40) : i].rpartition("\n")[2]):
            at = m.end()
            continue
        while m:
            out.append(m)
            at = m.end()
            m = ALSO.match(lines, at) if m.lastgroup[0] == "n" else None
    return out


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, normalised sentence) of a paragraph's sentences; those of which nothing is left are passed over."""
    out, at = [], 0
    for stop in STOP.finditer(text):
        out.append((at, text[at : stop.start()]))
        at = stop.end()
    out.append((at, text[at:]))
    return [(i, s) for i, s in ((i, normalised(s)) for i, s in out) if s]


def speaks(text: str, words: tuple[str, ...] = WORDS + HINTS) -> bool:
    """Whether a text in lower case holds one of the words."""
    return any(w in text for w in words)


def identifiers(text: str | None) -> list[tuple[int, str]]:
    """(start of its sentence, identifier) of every licence sentence, in order; those that no pattern knows are unknown."""
    text = text or ""
    if not speaks(text.lower()):
        return []
    out, at = [], 0
    for part in [*PARAGRAPH.finditer(text), None]:
        paragraph = text[at : part.start() if part else len(text)]
        if speaks(paragraph.lower()):
            out += [(at + i, name) for i, name in _of_paragraph(paragraph)]
        at = part.end() if part else len(text)
    return out


def _of_paragraph(text: str) -> list[tuple[int, str]]:
    found = sentences(text)
    begins, k = [], 0
    for _, s in found:
        begins.append(k)
        k += len(s) + 1
    out, held = [], set()
    for m in known_in("\n".join(s for _, s in found)):
        first = bisect_right(begins, m.start()) - 1
        held.update(range(first, bisect_right(begins, m.end() - 1)))
        out.append((m.start(), found[first][0], _name(m)))
    out += [(b, i, UNKNOWN) for k, (b, (i, s)) in enumerate(zip(begins, found)) if k not in held and speaks(s, WORDS)]
    return [(i, name) for _, i, name in sorted(out)]


def spdx_licences(expression: str) -> list[str]:
    """The licences of an SPDX expression, each once; exceptions (after with) name none."""
    words = expression.replace("(", " ").replace(")", " ").split()
    named_here = [w for k, w in enumerate(words) if w not in ("or", "and", "with") and (not k or words[k - 1] != "with")]
    return list(dict.fromkeys(SPELLING.get(w, w) for w in named_here))


_BY_FIRST: dict[str, list] = {}
for _rule in RULES:
    _BY_FIRST.setdefault(_rule[1][0], []).append(_rule)


def licences(names: list[str]) -> list[str]:
    """Licences that the ordered rules find in a sequence of identifiers; copyright lines don't break a sequence."""
    names = [x for x in names if x not in ("copyright", "all-rights", "free-software")]
    out, k = [], 0
    while k < len(names):
        kind, _, rest = names[k].partition(":")
        for licence, rule in _BY_FIRST.get(names[k], ()):
            if tuple(names[k : k + len(rule)]) == rule:
                out.append(licence)
                k += len(rule)
                break
        else:
            out += spdx_licences(rest) if kind == "spdx" else [rest] if kind in ("notice", "title") else []
            k += 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, sentences (identifiers in order), licences (in order, each once), n_sentences, n_unknown per row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            seqs = [[x for _, x in identifiers(t.as_py())] for t in batch.column(1)]
            told = [list(dict.fromkeys(licences(s))) for s in seqs]
            columns = (pa.array(seqs, pa.list_(pa.string())), pa.array(told, pa.list_(pa.string())), pa.array(map(len, seqs), pa.int64()), pa.array([s.count(UNKNOWN) for s in seqs], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "sentences", "licences", "n_sentences", "n_unknown"])

    small_batches(docs.sparkSession)
    many = T.ArrayType(T.StringType())
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("sentences", many), T.StructField("licences", many), T.StructField("n_sentences", T.LongType()), T.StructField("n_unknown", T.LongType())])
    return docs.select(named(docs, id_col).alias("_id"), named(docs, text_col).cast("string").alias("_text")).mapInArrow(run, out)
