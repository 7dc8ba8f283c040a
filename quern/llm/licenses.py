"""License scans: texts compared with licence templates by Dice coefficient over word bigrams.

A text is its lower-case words of ASCII letters and digits, so line ends of any kind, comment marks and wrapping don't
matter.  For a template of ``m`` words every window of ``m`` words in the text is a unit (a shorter text is one itself),
and a window of ``a`` distinct bigrams can reach the threshold ``t`` with a template of ``b`` only if
``t / (2 - t) <= a / b <= (2 - t) / t``; others are skipped.  So are windows that hold none of ``anchor_words``, without
which no template is reached, and texts without any.  Windows of long templates are looked at in two steps: every
``m // 8``-th first, and all of those around one that comes within a fixed part of the threshold.

Of windows that overlap, whatever their templates, the one with most shared bigrams is the match (then the larger
coefficient, the earlier start, the first name); others that overlap a better one aren't reported.  A long text is cut
into stretches of ``STRETCH`` words that see as much of their surroundings as windows reach.  Only DataFrame functions
are used; nothing is shuffled.

Result: one row per match: doc_id, start (the first word, from 0), n_words, the license and its coefficient, rounded to
6 digits.

Nulls: a null text has no words; a null id keeps its rows.  Texts of fewer than two words have no bigrams and match
nothing.  Repeated rows give repeated rows; empty input gives none.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

THRESHOLD = 0.8
STRETCH = 2048  # words
COARSE = 8  # windows of m words are first looked at every m // COARSE words

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published
by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of
the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_NOTICE = "This work is licensed under the {}, version {}."

#: (license, text) of each template: full texts or standard headers, and one-line notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", _GPL.format("General Public License", 2)),
    ("GPL-2.0", _NOTICE.format("GNU General Public License", 2)),
    ("GPL-3.0", _GPL.format("General Public License", 3)),
    ("GPL-3.0", _NOTICE.format("GNU General Public License", 3)),
    ("ISC", _ISC),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", 3)),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", _MPL),
]


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates:
        words = re.findall("[a-z0-9]+", text.lower())
        out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


def anchor_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which a unit must hold at least one to reach the threshold with any template.

    A template of b bigrams can miss at most ``b - ceil(b * t / (2 - t))`` of them, so words that stand in more than
    that many can't all be absent. Long words are taken first, as they are rare.
    """
    chosen: list[str] = []
    for _, bigrams in template_bigrams(templates):
        pairs = [b.split(" ") for b in bigrams]
        need = len(pairs) - math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9) + 1
        mine = [w for w in chosen if any(w in p for p in pairs)]
        while pairs and sum(any(w in p for w in mine) for p in pairs) < need:
            left = [p for p in pairs if not any(w in p for w in mine)]
            mine.append(min({w for p in left for w in p}, key=lambda w: (len(w) < 6, -sum(w in p for p in left), w)))
        chosen += [w for w in mine if w not in chosen]
    return chosen


def once(**column: Column) -> Column:
    """A column made by a generator of one row, which the optimizer doesn't merge into what follows."""
    ((name, value),) = column.items()
    return F.explode(F.array(value)).alias(name)


def by_length(templates: list[tuple[str, str]]) -> dict[int, list[tuple[str, list[str]]]]:
    """Templates by their number of words, each with its bigrams, in name order; those of one word are left out."""
    out: dict[int, list] = {}
    for (name, bigrams), (_, text) in zip(template_bigrams(templates), templates, strict=True):
        if bigrams:
            out.setdefault(len(re.findall("[a-z0-9]+", text.lower())), []).append((name, bigrams))
    return {m: sorted(x) for m, x in sorted(out.items())}


def coarse_threshold(m: int, threshold: float, bigrams: list[int]) -> float:
    """What the nearest of every ``step``-th windows has at least, if a window between has the threshold.

    It lies ``d = ceil(step / 2)`` words off: it may lack d of the shared bigrams and hold d others, and the two sets
    have ``b (1 + t / (2 - t))`` members at least.
    """
    step = max(1, m // COARSE)
    d = -(-step // 2) if step > 1 else 0
    return threshold - (2 + threshold) * d / ((1 + threshold / (2 - threshold)) * min(bigrams)) - 1e-6


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    anchors, classes = anchor_words(templates, threshold), by_length(templates)
    reach = max(classes, default=0)  # as far as windows that overlap one can begin from it
    hashed = lambda bigrams: F.array(*[F.xxhash64(F.lit(b)) for b in bigrams])
    known = F.array(*[
        F.struct(
            F.lit(m).alias("m"), F.lit(max(1, m // COARSE)).alias("step"), F.lit(coarse_threshold(m, threshold, [len(b) for _, b in group])).alias("coarse"),
            F.array(*[F.struct(F.lit(name).alias("license"), hashed(b).alias("bigrams")) for name, b in group]).alias("templates"),
        )
        for m, group in classes.items()
    ])

    named = reduce(lambda x, y: x | y, [F.contains(F.lower("text"), F.lit(w)) for w in anchors], F.lit(False))
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    # each ``once`` keeps an expression from being copied into what comes after it
    texts = docs.where(named).select("doc_id", once(words=words)).where(F.size("words") > 1)
    seen = lambda i: F.greatest(i - reach, F.lit(0))
    cut = F.transform(
        F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH)),
        lambda i: F.struct(i.alias("first"), seen(i).alias("seen"), F.slice("words", seen(i) + 1, F.lit(STRETCH + 3 * reach)).alias("words")),
    )
    parts = texts.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.first", "c.seen", "c.words")
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)))
    parts = parts.select("doc_id", "first", "seen", "words", once(hits=hits)).where((F.size("hits") > 0) & (F.size("words") > 1))
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    parts = parts.select("doc_id", "first", "seen", "hits", n.alias("n"), once(pairs=pairs))

    last = lambda c: F.greatest(F.col("n") - c["m"], F.lit(0))

    def every_step(c: Column) -> Column:
        """Every ``step``-th window, and the last, that holds a hit or lies a step beside one that does."""
        lo = lambda h: F.floor(F.greatest(h - c["m"] + 1 - c["step"], F.lit(0)) / c["step"]).cast("int")
        hi = lambda h: F.ceil(F.least(h + c["step"], last(c)) / c["step"]).cast("int")
        around = lambda h: F.when(hi(h) >= lo(h), F.transform(F.sequence(lo(h), hi(h)), lambda k: F.least(k * c["step"], last(c)))).otherwise(F.array(last(c)))
        return F.array_distinct(F.flatten(F.transform("hits", around)))

    def scored(c: Column, begins: Column, least: Column) -> Column:
        """Windows with the best of the templates of their length, as far as they reach ``least``."""

        def against(own: Column, start: Column) -> Column:
            a = F.size(own)
            share = least / (2 - least)
            fits = F.filter(c["templates"], lambda t: (a >= share * F.size(t["bigrams"]) - 1e-9) & (F.size(t["bigrams"]) >= share * a - 1e-9))
            each = F.transform(fits, lambda t: F.struct(F.size(F.array_intersect(t["bigrams"], own)).alias("shared"), (a + F.size(t["bigrams"])).alias("both"), t["license"].alias("license")))
            none = F.struct(F.lit(0).alias("shared"), F.lit(1).alias("both"), F.lit("").alias("license"))
            top = F.aggregate(each, none, lambda acc, x: F.when(x["shared"] * acc["both"] > acc["shared"] * x["both"], x).otherwise(acc))
            return F.struct(
                top["shared"].alias("shared"), F.round(2 * top["shared"] / top["both"], 6).alias("dice"), start.alias("start"), top["license"].alias("license"), F.least(c["m"], F.col("n")).alias("n_words")
            )

        windows = F.transform(begins, lambda i: F.struct(i.alias("start"), F.array_distinct(F.slice("pairs", i + 1, c["m"] - 1)).alias("own")))
        return F.filter(F.transform(windows, lambda w: against(w["own"], w["start"])), lambda w: w["dice"] >= least)

    near = F.transform(F.col("known"), lambda c: F.struct(c.alias("c"), scored(c, every_step(c), c["coarse"]).alias("near")))
    parts = parts.withColumn("known", known).select("doc_id", "first", "seen", "n", "pairs", once(near=F.filter(near, lambda x: F.size(x["near"]) > 0))).where(F.size("near") > 0)
    around = lambda c: lambda w: F.sequence(F.greatest(w["start"] - c["step"] + 1, F.lit(0)), F.least(w["start"] + c["step"] - 1, last(c)))
    every = F.transform("near", lambda x: scored(x["c"], F.array_distinct(F.flatten(F.transform(x["near"], around(x["c"])))), F.lit(threshold)))
    parts = parts.select("doc_id", "first", "seen", once(found=F.flatten(every))).where(F.size("found") > 0)
    order = lambda w: F.struct(-w["shared"], -w["dice"], w["start"], w["license"], w["n_words"])
    beats = lambda o, w: (o["start"] < w["start"] + w["n_words"]) & (w["start"] < o["start"] + o["n_words"]) & (order(o) < order(w))
    best = F.filter("found", lambda w: ~F.exists("found", lambda o: beats(o, w)))
    rows = parts.select("doc_id", "first", "seen", F.explode(best).alias("w")).withColumn("start", F.col("seen") + F.col("w.start"))
    return rows.where((F.col("start") >= F.col("first")) & (F.col("start") < F.col("first") + STRETCH)).select("doc_id", "start", "w.n_words", "w.license", "w.dice")


def op1_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def _oracle(templates: list[tuple[str, str]], threshold: float) -> str:
    quoted = ", ".join(f"({m}, '{n}', [{', '.join(repr(b) for b in bs)}])" for m, group in by_length(templates).items() for n, bs in group)
    anchors = "[" + ", ".join(f"'{w}'" for w in anchor_words(templates, threshold)) + "]"
    return rf"""
WITH templates(m, license, tb) AS (VALUES {quoted}),
lengths AS (SELECT DISTINCT m FROM templates),
texts AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
hits AS (SELECT id, unnest(list_filter(range(len(w)), lambda i: list_contains({anchors}, w[i + 1]))) AS h FROM texts WHERE list_has_any(w, {anchors}) AND len(w) > 1),
starts AS (SELECT DISTINCT id, m, unnest(range(greatest(0, least(h - m + 1, len(w) - m)), greatest(0, least(h, len(w) - m)) + 1)) AS start FROM hits JOIN texts USING (id), lengths),
grams AS (SELECT id, doc_id, s.m, start, least(m, len(w)) AS n_words, list_distinct(list_transform(range(start + 1, least(start + m, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM starts s JOIN texts USING (id)),
scored AS (SELECT id, doc_id, g.m, start, n_words, license, len(list_intersect(b, tb)) AS shared, len(b) + len(tb) AS both_sizes FROM grams g JOIN templates t ON g.m = t.m),
one AS (SELECT *, round(2 * shared / both_sizes, 6) AS dice, row_number() OVER (PARTITION BY id, m, start ORDER BY shared / both_sizes DESC, license) AS r FROM scored),
f AS MATERIALIZED (SELECT id, doc_id, start, n_words, license, dice, shared FROM one WHERE r = 1 AND dice >= {threshold})
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, license, dice FROM f w WHERE NOT EXISTS
  (SELECT 1 FROM f o WHERE o.id = w.id AND o.start < w.start + w.n_words AND w.start < o.start + o.n_words
   AND (-o.shared, -o.dice, o.start, o.license, o.n_words) < (-w.shared, -w.dice, w.start, w.license, w.n_words))
"""


ORACLE = _oracle(TEMPLATES, THRESHOLD)
