"""License notices by patience alignment of a text with license templates.

Words that occur once in both the template and a stretch of text are anchors; the longest increasing
subsequence of anchors is aligned, and the gaps between them are aligned the same way, until nothing is
unique; runs of equal words at the edges of a gap are matched as well. Coverage is the aligned words over the template's words and
those inserted between them, and a stretch is reported from ``threshold`` on, if every word that names the license or its version
(``MARKS``, and all words with digits) is aligned and none that names another one (``OTHERS``) is inserted or joined on by a hyphen.
Wild words of a template (``*``) match any one word.

The whole text is searched: every stretch that can be reported holds a naming word of the template or, where it has none, one of its
rarest words (as many as may be missing, and one more), so stretches are laid around those words; stretches that do not touch are aligned by
themselves, which finds repeated notices. Words are runs of letters and digits in lower case, with version dots kept.

Null texts are empty and hold no license. Overlapping finds of several templates: the one with the most
aligned words stays, ties go to the higher coverage, then the name. Repeated rows each get their own result. An empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import slices, text_of

#: SPDX names, and the names that short notices give them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0",),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "EPL-1.0": ("Eclipse Public License, version 1.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "BSL-1.0": ("Boost Software License, version 1.0",),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: What stands before a name in a short notice.
OPENINGS = ("Licensed under", "Licensed under the", "Released under the", "licensed under a", "licensed under the terms of the")

#: Longer notices by SPDX name, in public use.
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)


def _free_program(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-2.0": (_free_program("General Public License", "2"),),
    "GPL-3.0": (_free_program("General Public License", "3"),),
    "LGPL-2.1": (_free_program("Lesser General Public License", "2.1"),),
    "LGPL-3.0": (_free_program("Lesser General Public License", "3"),),
    "AGPL-3.0": (_free_program("Affero General Public License", "3"),),
    "BSD-2-Clause": (_CONDITIONS,),
    "BSD-3-Clause": (
        _CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at https://www.boost.org/LICENSE_1_0.txt",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
}
TEMPLATES = {
    name: (
        *[f"{opening} {called}" for called in names for opening in OPENINGS],
        f"SPDX-License-Identifier: {name}",
        *NOTICES.get(name, ()),
    )
    for name, names in NAMES.items()
}
#: Words that name a license or its kind: where a template has them, they must be there.
MARKS = frozenset(
    "affero apache attribution boost bsd cc cc0 creative eclipse endorse epl gnu gpl identifier isc lesser lgpl agpl mit mozilla mpl bsl "
    "nc nd noncommercial noderivatives promote sa sharealike spdx unencumbered unlicense zero zlib".split()
)
#: Words that name another license where they stand between those of a template.
OTHERS = MARKS | frozenset("commercial library derivatives documentation alike share".split()) - {"endorse", "promote", "identifier", "spdx"}
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
THRESHOLD = 0.8
#: A stretch reaches so many template lengths to both sides of a rare word; longer insertions end the match.
REACH = 2


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their code points."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second increases: patience with back links."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned (template, text) word positions, increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(template), 0, len(text))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and template[a] in (text[c], "*"):
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] in (text[d - 1], "*"):
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(template[a:b]), Counter(text[c:d])
        place = {w: j for j, w in enumerate(text[c:d], c) if there[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(template[a:b], a) if here[w] == 1 and w in place]
        chain = _increasing(anchors)
        if not chain:
            continue
        out += chain
        before = (a - 1, c - 1)
        for i, j in [*chain, (b, d)]:
            gaps.append((before[0] + 1, i, before[1] + 1, j))
            before = (i, j)
    return sorted(out)


def _goes_on(text: str, end: int) -> bool:
    """Whether a hyphen joins another word to the name, other than "only" or "or", which go with any version."""
    more = re.match(r"-([^\W_]+)", text[end : end + 40])
    return bool(more) and more[1].lower() not in ("only", "or")


class Finder:
    """Finds the notices of one text."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        listed = [(name, [w for w, _, _ in words_of(t)]) for name, ts in templates.items() for t in ts]
        common = Counter(w for _, ws in listed for w in set(ws))
        self.templates = []
        for name, ws in listed:
            missing = len(ws) - -(-int(threshold * len(ws) * 1000) // 1000)
            marks = Counter(w for w in ws if w in MARKS or any(map(str.isdigit, w)))
            # Any stretch that can be reported holds one of these.
            rare = sorted(set(ws), key=lambda w: (-len(w), ws.count(w), common[w], w))
            seeds, dropped = [], 0
            for w in sorted(marks, key=lambda w: (any(map(str.isdigit, w)), -len(w), ws.count(w), w))[:1] or rare:
                seeds.append(w)
                dropped += ws.count(w)
                if dropped > missing or marks:
                    break
            self.templates.append((name, ws, {w: [i for i, x in enumerate(ws) if x == w] for w in seeds}, marks))
        self.seeds = frozenset().union(*(s for _, _, s, _ in self.templates))
        # A short word also stands inside others; most texts end here.
        self.whole = {w: re.compile(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])") for w in self.seeds}

    def find(self, text: str) -> list[tuple[int, int, str, float, int]]:
        """(start, end, name, coverage, aligned words) of the notices, by start."""
        low = text.lower()
        if not any(w in low and self.whole[w].search(low) for w in self.seeds):
            return []
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for k, (w, _, _) in enumerate(words):
            if w in self.seeds:
                places.setdefault(w, []).append(k)
        if not places:
            return []
        plain = [w for w, _, _ in words]
        present = frozenset(plain)
        found = []
        for name, template, seeds, marks in self.templates:
            if any(w not in present for w in marks) or sum(w in present for w in template) < self.threshold * len(template):
                continue
            hits = sorted(k for w in seeds for k in places.get(w, ()))
            reach, n = REACH * len(template), len(template)
            start = 0
            while start < len(hits):
                stop = start + 1
                while stop < len(hits) and hits[stop] - hits[stop - 1] <= n:
                    stop += 1
                lo, hi = max(0, hits[start] - reach), min(len(words), hits[stop - 1] + reach + 1)
                found += self._within(name, template, seeds, marks, text, plain, words, lo, hi)
                start = stop
        return self._best(found)

    def _cover(self, template, best, marks, plain, lo) -> float:
        """Aligned words over the template's and the inserted ones; 0 if a naming word is missing or another one inserted."""
        if not best:
            return 0.0
        aligned = Counter(template[i] for i, _ in best)
        if any(aligned[w] < n for w, n in marks.items()):
            return 0.0
        held = {j for _, j in best}
        between = [plain[lo + j] for j in range(best[0][1], best[-1][1] + 1) if j not in held]
        if any(w in OTHERS and w not in marks for w in between):
            return 0.0
        return len(best) / (len(template) + len(between))

    def _within(self, name, template, seeds, marks, text, plain, words, lo, hi) -> list:
        out = []
        held, seen = [(lo, hi)], set()
        while held:
            lo, hi = held.pop()
            if (lo, hi) in seen:
                continue
            seen.add((lo, hi))
            pairs = align(template, plain[lo:hi])
            best = self._dense(pairs, len(template))
            cover = self._cover(template, best, marks, plain, lo)
            if cover >= self.threshold and not _goes_on(text, words[lo + best[-1][1]][2]):
                a, b = lo + best[0][1], lo + best[-1][1]
                out.append((words[a][1], words[b][2], name, cover, len(best)))
                held += [(lo, a), (b + 1, hi)]
            elif hi - lo > len(template) + 1:
                # Words that repeat in a long stretch are no anchors: lay the template over each rare word.
                n = len(template)
                for k in range(lo, hi):
                    for at in seeds.get(plain[k], ()):
                        a, b = max(lo, k - at - n // 5 - 2), min(hi, k + n - at + n // 5 + 2)
                        if b - a < hi - lo:
                            held.append((a, b))
        return out

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The longest run without a wide insertion, with its neighbours as long as they hold more words than the insertion."""
        if not pairs:
            return []
        runs, gaps = [[pairs[0]]], []
        for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
            if (extra := (m - j) - (k - i)) > n // 10 + 2:
                runs.append([])
                gaps.append(extra)
            runs[-1].append((k, m))
        at = max(range(len(runs)), key=lambda k: len(runs[k]))
        first = last = at
        while first and len(runs[first - 1]) >= gaps[first - 1]:
            first -= 1
        while last + 1 < len(runs) and len(runs[last + 1]) >= gaps[last]:
            last += 1
        return [p for run in runs[first : last + 1] for p in run]

    @staticmethod
    def _best(found: list) -> list:
        out: list = []
        for x in sorted(set(found), key=lambda x: (-x[4], -x[3], x[2], x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
                out.append(x)
        return sorted(out)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_licenses, licenses (distinct names, sorted), notices (array of structs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(templates, threshold)
        notice = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
        for batch in slices(batches, "text", 1 << 22):
            ids, counts, names, notices = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = finder.find(text)
                ids.append(doc)
                counts.append(len(found))
                names.append(sorted({x[2] for x in found}))
                notices.append([{"license": x[2], "start": x[0], "end": x[1], "coverage": round(x[3], 6)} for x in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(notices, pa.list_(notice))],
                ["doc_id", "n_licenses", "licenses", "notices"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, n_licenses bigint, licenses array<string>, "
        "notices array<struct<license:string,start:bigint,end:bigint,coverage:double>>",
    )
