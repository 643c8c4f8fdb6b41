"""Licence scans: lines, whole texts and word windows compared with licence templates by the Dice coefficient of their word bigrams.

A unit is a line of a document, or the whole document if it has several lines. A unit and a template are normalised
to lower-case words and compared as sets of word bigrams: Dice = 2 * common / (unit + template). For Dice >= t a
template of s bigrams can only match a unit of between s * t / (2 - t) and s * (2 - t) / t bigrams; these bounds prune
most units before their bigrams are built, and a unit counts common bigrams through an index from bigram to templates.

Notices that are wrapped over lines or lie inside a longer line are found in word windows: where neither the whole text nor a line has
matched, every run of at most s * (2 - t) / t bigrams that begins and ends with a bigram of the template is compared (any other
run scores less than the one inside it). Of overlapping windows the one with the most common bigrams counts. `SQL` has the
lines and whole texts only, so it gives these rows where no notice is wrapped or embedded.

Defined cases: null and empty texts have no matches (null: no units; a text has one unit for each line); a unit of fewer
than two words never matches; equal scores go to the template listed first; repeated rows give repeated rows; further
columns are left out.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices, (name, text), in the order that decides ties.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
THRESHOLD = 0.8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def bigrams(unit: bytes) -> set[tuple[bytes, bytes]]:
    found = WORD.findall(unit.lower())
    return set(zip(found, found[1:], strict=False))


class Matcher:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets = [bigrams(t.encode()) for _, t in templates]
        self.names = [n for n, _ in templates]
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for i, s in enumerate(self.sets):
            for b in s:
                self.index.setdefault(b, []).append(i)
        sizes = [len(s) for s in self.sets if s]
        self.least = min(sizes, default=1) * threshold / (2 - threshold)
        self.most = max(sizes, default=0) * (2 - threshold) / threshold

    def match(self, unit: bytes) -> tuple[int, float] | None:
        """The best template at or above the threshold, and its Dice coefficient."""
        if len(unit) < 2 * self.least + 1:  # n bigrams need n + 1 words and n separators
            return None
        own = bigrams(unit)
        if not self.least <= len(own) <= self.most:
            return None
        common = Counter(i for b in own for i in self.index.get(b, ()))
        best = None
        for i, n in sorted(common.items()):
            size = len(self.sets[i])
            if size * self.threshold <= len(own) * (2 - self.threshold) and len(own) * self.threshold <= size * (2 - self.threshold):
                dice = 2 * n / (size + len(own))
                if dice >= self.threshold and (best is None or dice > best[1]):
                    best = (i, dice)
        return best


    def windows(self, lines: list[tuple[list[bytes], bool]]) -> list[tuple[int, float]]:
        """The best template and its Dice coefficient for each notice in runs of words outside matched lines; lines: words, matched."""
        found: list[tuple[int, float, int, int, int]] = []
        base, words, runs = 0, [], []
        for own, matched in lines:
            if matched:
                runs.append((base, words))
                base, words = base + len(words) + 1, []
            else:
                words.extend(own)
        runs.append((base, words))
        for base, words in runs:
            met: dict[int, list[tuple[int, tuple]]] = {}
            for j, b in enumerate(zip(words, words[1:], strict=False)):
                if b in self.index:
                    for i in self.index[b]:
                        met.setdefault(i, []).append((j, b))
            for i, places in met.items():
                size = len(self.sets[i])
                need, most = max(1, math.ceil(size * self.threshold / (2 - self.threshold) - 1e-9)), int(size * (2 - self.threshold) / self.threshold + 1e-9)
                for k in range(len(places) - need + 1):
                    a = places[k][0]
                    if places[k + need - 1][0] - a >= most:
                        continue
                    common, seen, at, best = set(), set(), a, None
                    for j, b in (places[x] for x in range(k, len(places))):
                        if j - a >= most:
                            break
                        seen.update(zip(words[at : j + 1], words[at + 1 : j + 2], strict=False))
                        common.add(b)
                        at = j + 1
                        dice = 2 * len(common) / (size + len(seen))
                        if dice >= self.threshold and (best is None or dice > best[1]):
                            best = (len(common), dice, j)
                    if best:
                        found.append((best[0], best[1], i, base + a, base + best[2] + 1))
        taken: list[tuple[int, int]] = []
        out = []
        for _, dice, i, a, b in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            at = bisect.bisect(taken, (a, b))
            if (at == 0 or taken[at - 1][1] < a) and (at == len(taken) or taken[at][0] > b):
                taken.insert(at, (a, b))
                out.append((i, dice))
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of units, and all matches of units and of windows."""
        own = units(text)
        got = [self.match(u) for u in own]
        hits = [m for m in got if m]
        if own and not got[-1]:  # the last unit is the whole text
            n = max(1, len(own) - 1)
            hits += self.windows([(WORD.findall(u.lower()), bool(m)) for u, m in zip(own[:n], got[:n], strict=True)])
        return len(own), hits


SCANNED = "doc_id long, n_units long, n_matches long, license string, dice double, licenses string"


def units(text: str | None) -> list[bytes]:
    if text is None:
        return []
    lines = text.encode().split(b"\n")
    return lines if len(lines) == 1 else [*lines, text.encode()]


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For each document the number of units and of matching ones, the best match and all licences found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                n, hits = matcher.scan(text.as_py())
                best = min(hits, key=lambda m: (-m[1], m[0]), default=None)
                rows.append((n, len(hits), best and matcher.names[best[0]], best and round(best[1], 6), ",".join(sorted({matcher.names[i] for i, _ in hits}))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_units", "n_matches", "license", "dice", "licenses"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _pairs(column: str) -> str:
    return f"list_distinct(list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1]))"


_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
SQL = f"""
with t0(tid, name, body) as (values {_VALUES}),
t1 as (select tid, name, {_words("body")} as w from t0),
t as (select tid, name, {_pairs("w")} as b from t1),
u0 as (
  select doc_id, unnest(string_split(text, chr(10))) as unit from documents where text is not null
  union all select doc_id, text from documents where contains(text, chr(10))
),
u1 as (select doc_id, {_words("unit")} as w from u0),
u as (select row_number() over () as uid, doc_id, {_pairs("w")} as b from u1),
d as (
  select uid, doc_id, tid, name, 2.0 * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) as dice
  from u join t on len(u.b) > 0 and len(t.b) * {THRESHOLD} <= len(u.b) * {2 - THRESHOLD} and len(u.b) * {THRESHOLD} <= len(t.b) * {2 - THRESHOLD}
),
m as (select * from d where dice >= {THRESHOLD} qualify row_number() over (partition by uid order by dice desc, tid) = 1),
g as (
  select doc_id, count(*) as n_matches, first(name order by dice desc, tid) as license, round(max(dice), 6) as dice,
    array_to_string(list_sort(list_distinct(list(name))), ',') as licenses
  from m group by doc_id
),
n as (select doc_id, count(*) as n_units from u0 group by doc_id)
select documents.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_matches, 0) as n_matches, license, dice::double as dice, coalesce(licenses, '') as licenses
from documents left join n using (doc_id) left join g using (doc_id)
"""
