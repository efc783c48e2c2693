"""License scan by patience alignment (operator 2).

Words of a text and of each license template are aligned: words that occur once
in both ranges are anchors, the longest increasing subsequence of their places
is kept, and the gaps between anchors are aligned in the same way, where more
words have become unique; equal words at a range's ends are matched first. The
share of the template's words that are matched is its coverage.

A template is only aligned if the words it has in common with the text, with
repeats, could reach the least coverage; this bound never excludes a match. Row
local, no shuffle; the templates are a fixed list. Whole texts are scanned.

Defined results: a null or empty text matches nothing; a template matches if its
coverage reaches ``least`` within a passage at most ``spread`` times its length;
a run of words in ``REQUIRED`` (the
license's name, version, nc/nd/sa) must be there whole and without a gap; of several the one of highest coverage, then most words, then least name is the
license; all of them are listed; repeated rows are scanned each; an empty table
gives an empty result; extra columns are kept, columns named like the results
are replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesense.llm.common import small_batches

# Notices by which texts name their license, as commonly written,
# bodies of short licenses and the openings of long ones.
TEMPLATES = {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "Apache-2.0-name": "Licensed under the Apache 2.0 License",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "Apache-2.0-v": "Licensed under the Apache License v2.0",
    "BSD": "Released under the BSD License",
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC0-1.0": "Licensed under CC0 1.0",
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."),
    "CC0-1.0-title": "Creative Commons CC0 1.0 Universal",
    "EPL-1.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "EPL-2.0-v": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 "
        "which is available at http://www.eclipse.org/legal/epl-2.0"),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": "Released under the ISC License",
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0BSD-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "Released under the Unlicense",
    "Unlicense-body": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "Zlib-body": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely"),
}
# Runs of words, in order, without which a text is not under the license, however
# much of the template it holds: what tells the license from its siblings. A run
# is matched without a gap; a word after "!" must not follow it.
REQUIRED = {
    "Apache-1.1": ["apache license", "1 1"], "Apache-2.0": ["apache license", "2 0"], "Apache-2.0-header": ["apache license", "2 0"],
    "Apache-2.0-name": ["apache 2 0"], "Apache-2.0-title": ["apache license", "2 0"], "Apache-2.0-v": ["apache license v2 0"],
    "BSD": ["bsd license"], "BSL-1.0": ["boost software license", "1 0"], "CC0-1.0": ["cc0 1 0"], "CC0-1.0-notice": ["related and neighboring rights"],
    "CC0-1.0-title": ["cc0 1 0"], "EPL-1.0-notice": ["eclipse public license v1 0"], "EPL-2.0-notice": ["eclipse public license 2 0"],
    "EPL-2.0-v": ["eclipse public license v 2 0"], "GPL-notice": ["gnu general public license", "version 3"], "ISC": ["isc license"],
    "ISC-grant": ["granted provided that"], "0BSD-grant": ["granted the software is provided"], "MIT": ["mit license"],
    "MIT-grant": ["deal in the software"], "MPL-1.1": ["mozilla public license", "1 1"], "MPL-2.0": ["mozilla public license", "2 0"],
    "Unlicense": ["the unlicense"], "Unlicense-body": ["unencumbered software"], "Zlib-body": ["in no event will the authors"],
}


def _add(name: str, text: str, *required: str) -> None:
    TEMPLATES[name], REQUIRED[name] = text, list(required)


_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _k, _long in _CC.items():
    for _v, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _run = f"{_k} {_v}".lower().replace("-", " ").replace(".", " ")
        _name = _long if _v >= "4" else _long.replace("NoDerivatives", "NoDerivs")
        _add(f"CC-{_k}-{_v}", f"Licensed under CC {_k} {_v}", f"cc {_run}")
        _add(f"CC-{_k}-{_v}-notice", f"licensed under a Creative Commons {_name} {_v} {_port} License",
             f"creative commons {_name} {_v}".lower().replace("-", " ").replace(".", " "))
        _add(f"CC-{_k}-{_v}-url", f"creativecommons.org/licenses/{_k.lower()}/{_v}", f"creativecommons org licenses {_run}")
for _k, _kind, _versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
                             ("LGPL", "GNU Library General Public License", ("2",)), ("AGPL", "GNU Affero General Public License", ("3",))):
    for _v in _versions:
        _id, _run = f"{_k}-{_v if '.' in _v else _v + '.0'}", _v.replace(".", " ")
        _last = " !1" if _v == "2" else ""  # 2.1 is another
        _add(_id, f"This work is licensed under the {_kind}, version {_v}", _kind.lower(), f"version {_run}{_last}")
        _add(f"{_id}-v", f"licensed under the {_kind} v{_v}", f"{_kind.lower()} v{_run}{_last}")
        _add(f"{_id}-short", f"Licensed under the {_k}v{_v}", f"{_k.lower()}v{_run}{_last}")
        if _id != "GPL-3.0":  # GPL-notice
            _what = "program" if _k != "LGPL" or _v == "3" else "library"
            _add(f"{_id}-notice", f"This {_what} is free software; you can redistribute it and/or modify it under the terms of the {_kind} as published "
                 f"by the Free Software Foundation; either version {_v} of the License, or (at your option) any later version.", _kind.lower(), f"version {_run}{_last}")
for _id, _kind, _when in (("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
                          ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"),
                          ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"),
                          ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007")):
    _add(f"{_id}-title", f"{_kind} {_when}", f"{_kind} {_when}".lower().replace(",", "").replace(".", " "))
_MET = TEMPLATES["BSD-notice"] + ": "
_KEEP = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ",
         "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
         "documentation and/or other materials provided with the distribution. ")
_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
         "software without specific prior written permission. ")
_ASIS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
         "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_add("BSD-2-Clause-body", _MET + "".join(_KEEP) + _ASIS, "with the distribution this software is provided")
_add("BSD-3-Clause-body", _MET + "".join(_KEEP) + _NAME + _ASIS, "with the distribution neither the name")
_add("BSD-3-Clause-numbered", _MET + "".join(f"{i}. {x}" for i, x in enumerate((*_KEEP, _NAME), 1)) + _ASIS, "with the distribution 3 neither the name")
for _n in "23":
    _add(f"BSD-{_n}-Clause", f"Released under the BSD {_n}-Clause License", f"bsd {_n} clause license")
    _add(f"BSD-{_n}-Clause-first", f"Released under the {_n}-Clause BSD License", f"{_n} clause bsd license")
_LEFT = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_GIVEN = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
_add("MIT-body", TEMPLATES["MIT-grant"] + _LEFT + ", subject to the following conditions: The above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the Software. " + _GIVEN, "to do so subject to the following conditions")
_add("MIT-0-body", TEMPLATES["MIT-grant"] + _LEFT + ". " + _GIVEN, "to do so the software is provided")
for _id, _not in {"0BSD": "", "AGPL-3.0": "", "Apache-2.0": "", "BSD-2-Clause": " !patent", "BSD-3-Clause": " !clear", "BSL-1.0": "", "CC0-1.0": "",
                  "EPL-1.0": "", "EPL-2.0": "", "GPL-2.0": "", "GPL-3.0": "", "ISC": "", "LGPL-2.0": "", "LGPL-2.1": "", "LGPL-3.0": "", "MIT": " !0",
                  "MIT-0": "", "MPL-1.1": "", "MPL-2.0": "", "Unlicense": "", "WTFPL": "", "Zlib": "",
                  **{f"CC-{k}-{v}": "" for k in _CC for v in ("3.0", "4.0")}}.items():
    _add(f"{_id}-spdx", f"SPDX-License-Identifier: {_id}", f"spdx license identifier {_id}{_not}".lower().replace("-", " ").replace(".", " "))
LEAST = 0.8     # coverage
SPREAD = 2.0    # of the matched passage, in template lengths

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits (lower-cased) and non-ASCII bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence of distinct numbers, by
    patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for i, p in enumerate(places):
        j = bisect_left(tops, p)
        back.append(at[j - 1] if j else -1)
        if j == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[j], at[j] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (i, j), a[i] == b[j], both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append((hi, right))
        if lo >= hi or left >= right:
            continue
        na, nb = Counter(a[lo:hi]), Counter(b[left:right])
        where = {w: j for j, w in enumerate(b[left:right], left) if nb[w] == 1}
        once = [(i, where[a[i]]) for i in range(lo, hi) if na[a[i]] == 1 and a[i] in where]
        anchors = [once[x] for x in increasing([j for _, j in once])]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(lo - 1, left - 1), *anchors], [*anchors, (hi, right)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """Finds the passages of a text that align with a template. A passage that
    reaches the least coverage misses few of the template's places, so of any
    larger number of places one is matched: the places of words rarest in the
    text are taken, and a window around each of their occurrences is aligned,
    once as tight as the template and once ``spread`` times as wide. Where runs
    are required, each of their occurrences is held and what lies around them is
    aligned."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, spread: float = SPREAD):
        self.spread = spread
        self.templates = {n: t for n, t in ((n, words(x)) for n, x in sorted(templates.items())) if t}
        self.counts = {n: Counter(t) for n, t in self.templates.items()}
        self.needed = {n: max(1, math.ceil(least * len(t) - 1e-9)) for n, t in self.templates.items()}
        self.runs = {n: self._runs(t, REQUIRED[n]) if n in REQUIRED and templates[n] == TEMPLATES[n] else [] for n, t in self.templates.items()}
        self.musts = {n: {w for _, run, _ in r for w in run} for n, r in self.runs.items()}
        self.known = {w for t in self.templates.values() for w in t}

    @staticmethod
    def _runs(t: list[bytes], required: list[str]) -> list[tuple[int, list[bytes], list[bytes]]]:
        """(place in the template, run, words that must not follow)."""
        out, j = [], 0
        for r in required:
            run, _, ban = r.partition("!")
            run = words(run)
            j = next(i for i in range(j, len(t)) if t[i:i + len(run)] == run)
            out.append((j, run, words(ban)))
            j += len(run)
        return out

    def _fixed(self, name: str, found: list[bytes], at: dict[bytes, list[int]]) -> Iterator[list[int]]:
        """Places of the required runs in the text, in order and within the
        largest passage of the first."""
        runs, reach = self.runs[name], math.ceil(self.spread * len(self.templates[name]))

        def more(places: list[int]) -> Iterator[list[int]]:
            if len(places) == len(runs):
                yield places
                return
            _, run, ban = runs[len(places)]
            spots = at.get(run[0], [])
            lo = bisect_left(spots, places[-1] + len(runs[len(places) - 1][1])) if places else 0
            hi = bisect_left(spots, places[0] + reach) if places else len(spots)
            for p in spots[lo:hi]:
                end = p + len(run)
                if found[p:end] == run and not (ban and found[end:end + len(ban)] == ban):
                    yield from more([*places, p])

        return more([])

    def _around(self, name: str, found: list[bytes], places: list[int], lo: int, hi: int) -> list[tuple[int, int]]:
        """The alignment of found[lo:hi] with the required runs at ``places``."""
        t, out, i, j = self.templates[name], [], lo, 0
        for p, (k, run, _) in zip(places, self.runs[name], strict=True):
            out += [(i + x, j + y) for x, y in align(found[i:p], t[j:k])] + [(p + x, k + x) for x in range(len(run))]
            i, j = p + len(run), k + len(run)
        return out + [(i + x, j + y) for x, y in align(found[i:max(i, hi)], t[j:])]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first, last) of every match, best first; first
        and last count the text's words from 0. Matches of one template do not
        overlap."""
        found = words(text)
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(found):
            if w in self.known:
                at.setdefault(w, []).append(i)
        have = Counter({w: len(x) for w, x in at.items()})
        out = []
        for name, t in self.templates.items():
            if not self.musts[name] <= at.keys() or sum(min(n, have[w]) for w, n in self.counts[name].items()) < self.needed[name]:
                continue
            best: dict[tuple[int, int], float] = {}
            if self.runs[name]:
                tries = [(places[0], self.runs[name][0][0], places) for places in self._fixed(name, found, at)]
            else:
                rare = sorted(range(len(t)), key=lambda j: (have[t[j]], j))[:len(t) - self.needed[name] + 1]
                tries = [(p, j, None) for j in rare for p in at.get(t[j], [])]
            for p, j, places in tries:
                for wide in (1.0, self.spread):
                    lo, hi = max(0, p - math.ceil(wide * (j + 1)) + 1), p + math.ceil(wide * (len(t) - j))
                    got = self._around(name, found, places, lo, hi) if places else [(lo + x, y) for x, y in align(found[lo:hi], t)]
                    if len(got) >= self.needed[name]:
                        span = got[0][0], got[-1][0]
                        if span[1] - span[0] + 1 <= self.spread * len(t):
                            best[span] = max(best.get(span, 0.0), len(got) / len(t))
            taken: list[tuple[int, int]] = []
            for span in sorted(best, key=lambda x: (-best[x], x[1] - x[0], x)):
                if all(span[1] < a or b < span[0] for a, b in taken):
                    taken.append(span)
                    out.append((name, best[span], *span))
        return sorted(out, key=lambda m: (-m[1], -len(self.templates[m[0]]), m[0], m[2]))


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                      T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, spread: float = SPREAD,
                  text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add to ``docs`` (its columns in ``keep``): license, coverage, first_word,
    last_word of the best match (null without one) and matches, all of them."""
    small_batches(docs.sparkSession)
    named = [f.name for f in MATCH.fields] + ["matches"]
    kept = [f for f in docs.schema.fields if f.name not in named and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, *MATCH.fields, T.StructField("matches", T.ArrayType(MATCH))])
    templates = TEMPLATES if templates is None else templates
    kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least, spread)
        for batch in batches:
            got = [scanner.scan(t) for t in batch.column(len(kept)).to_pylist()]
            rows = [[dict(zip(MATCH.names, m, strict=True)) for m in x] for x in got]
            best = [pa.array([x[0][n] if x else None for x in rows], kind.field(n).type) for n in MATCH.names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *best, pa.array(rows, pa.list_(kind))], names=schema.names)

    return docs.select(*[docs[f.name] for f in kept], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
