"""License scans by patience alignment.

Long templates are whole license texts (``licenses/``) and headers: runs of four words that stand once in a template are looked
up in a text, hits on one diagonal make a stretch, and the stretch is aligned with the template: words unique to both are
anchors, the longest increasing run of anchors is kept, and the gaps between them are aligned in the same way. The share of
template words that found their place is the coverage. Short forms ("licensed under the ...") are a lead, aligned in the same
way, before a license's name, which must stand word for word, the longest name first, so that relatives are told apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship, slices, small_batches

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
#: license -> (header,); the whole texts are in ``licenses``
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0-header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',),
    "GPL-2.0-header": (_GNU.format("General Public License", "2"),),
    "GPL-3.0-header": (_GNU.format("General Public License", "3"),),
    "LGPL-2.1-header": (_GNU.format("Lesser General Public License", "2.1"),),
    "LGPL-3.0-header": (_GNU.format("Lesser General Public License", "3"),),
    "AGPL-3.0-header": (_GNU.format("Affero General Public License", "3"),),
    "MPL-2.0-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
}


def _names() -> dict[str, list[str]]:
    """License -> the names that short forms give it."""
    out = {
        "MIT": ["MIT", "MIT License", "MIT Licence", "Expat License"],
        "ISC": ["ISC", "ISC License"],
        "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
        "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
        "Apache-2.0": ["Apache-2.0", "Apache 2", "Apache License 2.0", "Apache License, Version 2.0", "Apache License, Version 2", "Apache License v2.0", "Apache 2.0 License"],
        "Unlicense": ["Unlicense"],
        "Zlib": ["zlib License", "Zlib"],
        "BSL-1.0": ["BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software License v1.0"],
        "Artistic-2.0": ["Artistic-2.0", "Artistic License 2.0", "Artistic License, Version 2.0"],
        "CC0-1.0": ["CC0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0", "Creative Commons Zero v1.0 Universal"],
    }
    for code, name in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"), ("AGPL", "Affero General Public License")):
        for full, versions in (("2.0", ("2", "2.0")), ("2.1", ("2.1",)), ("3.0", ("3", "3.0"))):
            if (code, full) in {("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")}:
                for v in versions:
                    long = [f"{n} {x}" for n in (f"GNU {name}", f"GNU {name} ({code})", f"GNU {code}") for x in (f"version {v}", f"v{v}", v)]
                    out.setdefault(f"{code}-{full}", []).extend([*long, f"{code} version {v}", f"{code} v{v}", f"{code}v{v}", f"{code}-{v}"])
    for v in ("1.1", "2.0"):
        out[f"MPL-{v}"] = [f"Mozilla Public License {x}{v}" for x in ("", "v", "v. ", "version ")] + [f"MPL {v}", f"MPL v{v}"]
    out["EPL-2.0"] = ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "EPL-2.0"]
    terms = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for code, name in terms.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spelled = {name, name.replace("ShareAlike", "Share Alike").replace("NonCommercial", "Non-Commercial"), name.replace("NoDerivatives", "NoDerivs")}
            out[f"CC-{code}-{v}"] = [f"CC {code} {v}", f"Creative Commons {code} {v}", *(f"Creative Commons {n} {v}" for n in sorted(spelled))]
    return out


_MIDDLES = ("", "the", "a", "an", "the terms of the", "the terms and conditions of the")
_VERBS = ("licensed", "licenced", "released", "distributed", "redistributed", "published", "available", "provided", "offered", "covered")
#: What may come before a name; the last word of a lead must touch the name.
LEADS = ("license", "licence", "SPDX-License-Identifier", *(f"{who} {v} under {m}".strip() for who in ("", "this work is") for v in _VERBS for m in _MIDDLES))
RUN = 4
MIN_COVERAGE = 0.85
_TOKEN = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places; ``pairs`` is sorted by the first, which are distinct."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tails, b)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[p], at[p] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in place])
        out += anchors
        if anchors:
            for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                work.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class Coded:
    """Templates and names as word lists, with their lookup tables."""

    def __init__(self, texts: dict[str, str], names: dict[str, list[str]]):
        self.texts = {name: [w for w, _, _ in tokens(text)] for name, text in texts.items()}
        self.runs: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, words in self.texts.items():
            runs = list(zip(*(words[k:] for k in range(RUN)), strict=False))
            once = Counter(runs)
            for k, run in enumerate(runs):
                if once[run] == 1:
                    self.runs.setdefault(run, []).append((name, k))
        self.names: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for name, spelled in names.items():
            for core in {tuple(w for w, _, _ in tokens(x)) for x in spelled}:
                self.names.setdefault(core[0], []).append((core, name))
        for cores in self.names.values():
            cores.sort(key=lambda x: (-len(x[0]), x))
        self.leads: dict[str, list[list[str]]] = {}
        for lead in LEADS:
            words = [w for w, _, _ in tokens(lead)]
            self.leads.setdefault(words[-1], []).append(words)


@lru_cache(maxsize=1)
def default_templates() -> Coded:
    """Read on the driver only; tasks get the tables."""
    whole = {f"{f.stem}-text": f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    return Coded({**{name: text for name, (text,) in TEMPLATES.items()}, **whole}, _names())


def _long(words: list[str], coded: Coded) -> Iterator[tuple[str, int, int]]:
    """(template, first word, last word + 1) of the stretches that share enough runs with a template."""
    hits: dict[str, list[int]] = {}
    runs = coded.runs
    for p, run in enumerate(zip(*(words[k:] for k in range(RUN)), strict=False)):
        if run in runs:
            for name, k in runs[run]:
                hits.setdefault(name, []).append(p - k)
    for name, diagonals in hits.items():
        m = len(coded.texts[name])
        slack = 2 + m // 4
        diagonals.sort()
        first = 0
        for k in range(1, len(diagonals) + 1):
            if k == len(diagonals) or diagonals[k] - diagonals[k - 1] > slack:
                if k - first >= max(1, m // 20):
                    yield name, max(0, diagonals[first] - slack), min(len(words), diagonals[k - 1] + m + slack)
                first = k


def detect(text: str, coded: Coded, min_coverage: float) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of the stretches of a whole text; of overlapping ones that with most words more aligned than missed."""
    toks = tokens(text)
    words = [w for w, _, _ in toks]
    found: dict[tuple[int, int, str], tuple[int, float]] = {}

    def put(name: str, lo: int, hi: int, aligned: int, m: int) -> None:
        key = (lo, hi, name)
        found[key] = max(found.get(key, (-m, 0.0)), (2 * aligned - m, aligned / m))

    for name, lo, hi in _long(words, coded):
        pattern = coded.texts[name]
        pairs = patience(words[lo:hi], pattern)
        if pairs and len(pairs) >= min_coverage * len(pattern):
            put(name, lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs), len(pattern))
    for k, w in enumerate(words):
        if k and w in coded.names and words[k - 1] in coded.leads:
            core, name = next((x for x in coded.names[w] if tuple(words[k : k + len(x[0])]) == x[0]), ((), ""))
            for lead in coded.leads[words[k - 1]] if core else ():
                lo = max(0, k - len(lead) - 2 - len(lead) // 4)
                pairs = patience(words[lo:k], lead)
                if len(pairs) >= min_coverage * len(lead):
                    put(name, lo + pairs[0][0], k + len(core), len(pairs) + len(core), len(lead) + len(core))
    out: list[tuple[str, float, int, int]] = []
    begins: list[int] = []
    ends: list[int] = []  # of the stretches taken, which don't overlap: both rise
    for (lo, hi, name), (_, coverage) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
        at = bisect_left(begins, hi)
        if not at or ends[at - 1] <= lo:
            begins.insert(at, lo)
            ends.insert(at, hi)
            out.append((name, coverage, toks[lo][1], toks[hi - 1][2]))
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Coded | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per license stretch: ``doc_id, license, coverage, start, end`` (code points, end exclusive).

    Every whole text is searched. Texts that are null, empty or state no license give no row; a text that states a license
    twice gives two. Null ids and repeated rows stay as they are; an empty table gives no rows; other columns are not read.
    """
    coded = templates or default_templates()
    quick = re.compile(r"licen[sc]e|permission|redistribut|free software|creative commons|public domain|mozilla", re.IGNORECASE)
    quick = quick if templates is None else re.compile("")
    under = re.compile(r"\b(?:%s)[\W_]+under\b" % "|".join(_VERBS), re.IGNORECASE)
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1)
            rows, at = [], []
            for k, text in enumerate(texts):
                text = text.as_py()
                if text and (quick.search(text) or under.search(text)):
                    for row in detect(text, coded, min_coverage):
                        rows.append(row)
                        at.append(k)
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "license", "coverage", "start", "end"])

    return slim.mapInArrow(run, f"doc_id {kind}, license string, coverage double, start long, end long")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scan(read_table(spark, sf_dir, "documents"))
