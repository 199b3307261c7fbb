"""License scan: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

Rules come from families (license x version x phrasing) and from wordings of license bodies, written as regular
expressions over a text's lower-cased words joined by one space. A text is looked at only if it has one of the rules' keywords;
a rule runs only if the text has its own. Detections are taken in the order of priority, then length,
then start; one that lies within a kept one is suppressed.

Defined results: null and empty texts have no words and no labels. Repeated rows each get their row;
other columns, whatever their names, are left out of the scan. An empty table gives no rows. A very long text is joined from
its words in one task's memory.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, flat_text, slices, word_bounds

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Names of licenses as they stand in texts, their labels, versions and required keyword.
NAMED = (
    ("apache(?: software)?", "apache", ("1 0", "1 1", "2 0"), "apache"),
    ("mozilla public", "mpl", ("1 0", "1 1", "2 0"), "mozilla"),
    ("gnu general public", "gpl", ("1", "2", "3"), "general"),
    ("gnu lesser general public", "lgpl", ("2 1", "3"), "lesser"),
    ("gnu library general public", "lgpl", ("2",), "library"),
    ("gnu affero general public", "agpl", ("1", "3"), "affero"),
    ("gnu free documentation", "gfdl", ("1 1", "1 2", "1 3"), "documentation"),
    ("eclipse public", "epl", ("1 0", "2 0"), "eclipse"),
    ("european union public", "eupl", ("1 0", "1 1", "1 2"), "european"),
    ("common development and distribution", "cddl", ("1 0", "1 1"), "development"),
    ("academic free", "afl", ("1 1", "2 0", "3 0"), "academic"),
    ("open software", "osl", ("1 0", "2 0", "3 0"), "software"),
    ("artistic", "artistic", ("1 0", "2 0"), "artistic"),
    ("boost software", "bsl", ("1 0",), "boost"),
    ("microsoft public", "ms-pl", (), "microsoft"),
    ("microsoft reciprocal", "ms-rl", (), "microsoft"),
    ("sil open font", "ofl", ("1 0", "1 1"), "font"),
    ("open data commons open database", "odbl", ("1 0",), "database"),
    ("python software foundation", "psf", ("2", "2 0"), "python"),
    ("universal permissive", "upl", ("1 0",), "universal"),
    ("mit", "mit", (), "mit"),
    ("expat", "mit", (), "expat"),
    ("isc", "isc", (), "isc"),
    ("zlib", "zlib", (), "zlib"),
    ("x11", "x11", (), "x11"),
    ("curl", "curl", (), "curl"),
    ("postgresql", "postgresql", (), "postgresql"),
    ("ruby", "ruby", (), "ruby"),
    ("php", "php", ("3 0", "3 01"), "php"),
    ("zope public", "zpl", ("2 0", "2 1"), "zope"),
    ("w3c software", "w3c", (), "w3c"),
    ("unicode", "unicode", (), "unicode"),
    ("openssl", "openssl", (), "openssl"),
    ("do what the fuck you want to public", "wtfpl", ("2",), "want"),
    ("blue oak model", "blueoak", ("1 0 0",), "oak"),
)
# Phrasings around a name; {0} is the name with "license", {1} an optional version.
PHRASINGS = (
    (1, r"licen[cs]ed (?:to you )?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?{0}{1}"),
    (1, r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{0}{1}"),
    (2, r"(?:subject to|governed by|under|see) (?:the )?(?:terms of )?(?:the )?{0}{1}"),
    (3, r"{0}{1}"),
)
# Clauses of the public content licenses, versions, and wordings of single licenses.
CONTENT = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CONTENT_NAMES = ("attribution", "attribution share ?alike", "attribution non ?commercial", "attribution no ?deriv(?:ative)?s?", "attribution non ?commercial share ?alike", "attribution non ?commercial no ?deriv(?:ative)?s?")
CONTENT_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
SPDX = ("mit", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 2 0", "epl 2 0", "unlicense", "zlib", "cc0 1 0")
SINGLE = (
    ("cc0", 1, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 1, "creative", r"creative commons (?:public domain|zero|cc0)"),
    ("public-domain", 1, "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", 3, "domain", r"public domain"),
    ("unlicense", 1, "unencumbered", r"free and unencumbered software"),
    ("bsd-2", 1, "clause", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3", 1, "clause", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4", 1, "clause", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("bsd", 2, "bsd", r"bsd(?: style)? licen[cs]e"),
    ("bsd", 2, "redistribution", r"redistribution and use in source and binary forms"),
    ("mit", 2, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("warranty", 4, "warrant", r"(?:provided|distributed) as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    ("proprietary", 2, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("copyright", 4, "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("reserved", 4, "reserved", r"(?:all|some|no) rights reserved"),
)
# Wordings from the bodies of licenses: (label, priority, keyword, words).
BODIES = (
    ("mit", 1, "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 2, "permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 3, "connection", r"out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2", 2, "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd-2", 3, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", 2, "endorse", r"(?:may|to) (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4", 2, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 3, "consequential", r"direct indirect incidental special exemplary or consequential damages"),
    ("isc", 1, "permission", r"permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee"),
    ("isc", 3, "disclaims", r"the (?:software is provided as is and the )?author disclaims all warranties with regard to this software"),
    ("apache-2.0", 1, "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", 2, "limitations", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2.0", 2, "irrevocable", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache", 2, "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", 1, "redistribute", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 2, "hope", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 2, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 2, "copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", 3, "freedom", r"intended to guarantee your freedom to share and change (?:free software|all versions of a program)"),
    ("gpl-2", 2, "derived", r"in whole or in part contains or is derived from the program or any part thereof to be licen[cs]ed as a whole"),
    ("gpl-3", 2, "propagate", r"to propagate a work means to do anything with it that without permission"),
    ("gpl-3", 2, "conveying", r"conveying (?:verbatim copies|modified source versions|non source forms)"),
    ("gpl-exception", 2, "exception", r"as a special exception (?:the copyright holders|you may)"),
    ("lgpl", 1, "redistribute", r"redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl", 2, "library", r"work that uses the library"),
    ("agpl", 2, "remotely", r"interacting with it remotely through a computer network"),
    ("agpl", 2, "interaction", r"remote network interaction use with the gnu general public licen[cs]e"),
    ("mpl-2.0", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", 2, "incompatible", r"this source code form is incompatible with secondary licen[cs]es"),
    ("mpl-1.1", 2, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-2.0", 2, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("epl", 2, "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance"),
    ("cddl", 2, "development", r"the contents of this file are subject to the terms of the common development and distribution"),
    ("eupl", 2, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("artistic-2.0", 2, "aggregation", r"aggregation of the package with a commercial distribution"),
    ("artistic", 2, "artistic", r"copyright holder maintains some semblance of artistic control"),
    ("bsl-1.0", 1, "obtaining", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", 3, "damages", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", 1, "compiled", r"either in source code form or as a compiled binary for any purpose commercial or non commercial"),
    ("unlicense", 2, "dedicate", r"dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", 1, "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc-by", 2, "appropriate", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", 2, "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nc", 2, "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 2, "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl-1.1", 1, "font", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl", 2, "font", r"reserved font name"),
    ("psf", 2, "psf", r"psf hereby grants licen[cs]ee a nonexclusive royalty free world ?wide licen[cs]e"),
    ("openssl", 2, "openssl", r"this product includes software developed by the openssl project"),
    ("php", 2, "php", r"products derived from this software may not be called php"),
    ("w3c", 2, "permission", r"permission to copy modify and distribute this software and its documentation with or without modification"),
    ("x11", 2, "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("ntp", 2, "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("wtfpl", 2, "want", r"you just do what the fuck you want to"),
    ("beerware", 1, "beer", r"you can buy me a beer in return"),
    ("json", 2, "evil", r"the software shall be used for good not evil"),
    ("sspl", 2, "server", r"server side public licen[cs]e"),
    ("sspl", 2, "service", r"making the functionality of the program available to third parties as a service"),
    ("busl-1.1", 2, "business", r"business source licen[cs]e(?: 1 1)?"),
    ("elastic-2.0", 2, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 2, "clause", r"commons clause licen[cs]e condition"),
    ("odbl", 2, "attribute", r"you are free to share create and adapt as long as you attribute share alike and keep open"),
    ("ogl", 2, "sector", r"contains public sector information licen[cs]ed under the open government licen[cs]e"),
    ("eula", 2, "agreement", r"by (?:installing|downloading|using) (?:the|this) software you agree to be bound by the terms of this agreement"),
    ("eula", 3, "reverse", r"you may not reverse engineer decompile or disassemble the software"),
    ("proprietary", 2, "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, "written", r"may (?:not )?be reproduced (?:distributed or transmitted )?(?:in any form )?without (?:the )?prior written permission"),
    ("personal-use", 2, "personal", r"for personal (?:and )?non ?commercial use only"),
    ("academic", 2, "academic", r"for (?:academic|research|educational) (?:and (?:academic|research|educational) )?(?:purposes|use) only"),
)


def _slug(version: str) -> str:
    return version.replace(" ", ".")


@lru_cache(1)
def rules() -> tuple[tuple[str, int, str, re.Pattern], ...]:
    """(label, priority, keyword, pattern) in the order of priority; lower comes first."""
    out = []
    for name, label, versions, keyword in NAMED:
        full = rf"(?:the )?{name} licen[cs]e"
        for priority, phrase in PHRASINGS:
            for version in versions:
                own = rf"(?: v| version)? {version}(?: or (?:\(?at your option\)? )?(?:any )?later(?: version)?)?"
                out.append((f"{label}-{_slug(version)}", 2 * priority, keyword, phrase.format(full, own)))
            out.append((label, 2 * priority + 1, keyword, phrase.format(full, "")))
    for short, long in zip(CONTENT, CONTENT_NAMES, strict=True):
        label = "cc-" + short.replace(" ", "-")
        for version in CONTENT_VERSIONS:
            out.append((f"{label}-{_slug(version)}", 2, "cc", rf"(?:licen[cs]ed under )?(?:a )?(?:the )?cc {short} {version}"))
            out.append((f"{label}-{_slug(version)}", 2, "creative", rf"creative commons {long} {version}"))
        out.append((label, 3, "cc", rf"(?:licen[cs]ed under )?(?:a )?(?:the )?cc {short}"))
        out.append((label, 3, "creative", rf"creative commons {long}"))
    for tag in SPDX:
        out.append((tag.replace(" ", "-"), 0, "spdx", rf"spdx licen[cs]e identifier {tag}(?: only| or later)?"))
    out += [(label, 2 * priority, keyword, text) for label, priority, keyword, text in (*SINGLE, *BODIES)]
    return tuple((a, b, c, re.compile(rf"(?<![^ ])(?:{d})(?![^ ])")) for a, b, c, d in sorted(out, key=lambda r: r[1]))


@lru_cache(1)
def keywords() -> tuple[str, ...]:
    """The gate for whole texts: every named rule says license or licence, the others have these words."""
    return tuple(sorted({"license", "licence", "cc", "creative", "spdx"} | {r[2] for r in (*SINGLE, *BODIES)}))


def detect(words: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the kept detections in words joined by single spaces."""
    found = []
    present = {k for k in {r[2] for r in rules()} if k in words}
    for label, priority, keyword, pattern in rules():
        if keyword in present:
            found += [(m.start(), m.end(), label, priority) for m in pattern.finditer(words)]
    found.sort(key=lambda d: (d[3], d[0] - d[1], d[0], d[2]))
    # the furthest end of the kept ones that start no later, in a tree of maxima over the starts
    starts = sorted({d[0] for d in found})
    furthest, kept = [0] * (len(starts) + 1), []
    for d in found:
        first = at = bisect_right(starts, d[0])
        end = 0
        while at:
            end, at = max(end, furthest[at]), at & (at - 1)
        if end >= d[1]:
            continue
        kept.append(d)
        while first < len(furthest):
            furthest[first] = max(furthest[first], d[1])
            first += first & -first
    return sorted(kept)


_PLACES = tuple((re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), phrase.split()[-1].encode() if phrase != "cc by" else b"cc", label) for phrase, label in BASE)
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: Keywords of so many letters at most let a text pass only as whole words.
SHORT = 4
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts of words and base places, labels, score."""
    gates = [k.encode() for k in keywords() if len(k) > SHORT]
    short = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(k.encode() for k in keywords() if len(k) <= SHORT) + rb")(?![0-9a-z\x80-\xff])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = flat_text(batch.column("text"))
            lower = LOWER[data]
            starts, _ = word_bounds(_IS_WORD[lower], offsets)
            counts = np.diff(np.searchsorted(starts, offsets))
            raw, rows = lower.tobytes(), []
            for i in range(batch.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                row = (0, None, None, "", "", 0.0, 0)
                if any(g in text for g in gates) or short.search(text):
                    own = starts[np.searchsorted(starts, offsets[i]) : np.searchsorted(starts, offsets[i + 1])] - offsets[i]
                    places, base = [], set()
                    for pattern, gate, label in _PLACES:
                        if gate in text and (at := [m.start() for m in pattern.finditer(text)]):
                            places += at
                            base.add(label)
                    kept = detect(b" ".join(_WORDS.findall(text)).decode("utf-8", "replace"))
                    labels = sorted(base | {d[2] for d in kept})
                    order = np.searchsorted(own, sorted(places))
                    best = min([d[3] for d in kept], default=9)
                    score = 0.0 if not labels else round(max(1.0 - 0.1 * best, 0.5 if base else 0.1), 4)
                    row = (len(places), int(order[0]) if places else None, int(order[-1]) if places else None, ",".join(sorted(base)), ",".join(labels), score, len(kept))
                rows.append(row)
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), *(pa.array(columns[k], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
