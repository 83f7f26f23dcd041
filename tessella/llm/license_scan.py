"""Licence scans by Dice coefficient over word bigrams (DataFrame functions only).

Units are the whole text of a document and, if there are several, each of its lines; and windows of words
anywhere in the text. Normal form: lower case, all but letters and digits as spaces. A unit of a bigrams and
a template of b can reach the threshold t only if t / (2 - t) * b <= a <= (2 - t) / t * b; a constant table
gives for each a the templates within these bounds, so most lines end without a bigram being built. Of the
rest, Dice = 2 |A and B| / (|A| + |B|) over multisets of bigrams.

A window has b to (2 - t) / t * b bigrams (text that ends sooner counts as b), so it must share t * b of them.
Texts without one of each template's anchor words, chosen so that a unit or window without them can't reach the
threshold, end before they are split into words. For the rest the best window from each bigram of the template is
found by one fold, and windows that share bigrams with one of more matching bigrams (then higher Dice, first
template, first place) are dropped. A window within a line that matches is no further unit, nor is one whose licence
the whole text has with the same Dice or a higher one.

SPDX expressions are units of a kind of their own: `spdx` has the identifiers of all in a text as written, templates or not.

Defined cases: null text has no unit that matches; texts under two words match nothing; equal scores go
to the template first by name; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored. A very long text is read as a whole by Spark's own string functions. The templates are constants,
so everything broadcast has a fixed size. Of the GPL, Apache and MPL there are notices, headers and the opening of the
full text, which is enough to find it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.regex import let

THRESHOLD = 0.8
#: The wording of public licences and of their usual notices.
TEMPLATES = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "agpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3-short": "Released under the GNU General Public License v3.",
    "gpl-3-work-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-text": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "proprietary-notice": "All rights reserved.",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsl-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "lgpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words that other texts are full of: no anchors where there are others.
_COMMON = frozenset("the of and to in is this or be by under with for that all following without including provided from as not are you any".split())
_GAP = "[^\\p{L}\\p{N}]+"


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_bigrams() -> dict[str, list[str]]:
    """Each template's bigrams, sorted, with repeats."""
    return {name: sorted(f"{a} {b}" for a, b in zip(t, t[1:], strict=False)) for name, t in ((n, _tokens(x)) for n, x in sorted(TEMPLATES.items()))}


def _tagged(grams: list[str]) -> list[str]:
    """Sorted bigrams, each with its number among its equals, so that set operations count repeats."""
    return [f"{g} {i - grams.index(g)}" for i, g in enumerate(grams)]


def _candidates(sizes: list[int], threshold: float) -> list[list[int]]:
    """For each number of bigrams, the templates that can reach the threshold."""
    top = int(max(sizes) * (2 - threshold) / threshold) + 1
    return [[k for k, b in enumerate(sizes) if a and 2 * min(a, b) >= threshold * (a + b)] for a in range(top + 1)]


def _shared(size: int, threshold: float) -> int:
    """The bigrams that a window shares with a template of this size at least."""
    return next(o for o in range(size + 2) if 2.0 * o / (2 * size) >= threshold)


def _least(size: int, threshold: float) -> int:
    """The bigrams that any unit shares with a template of this size at least: the smallest units, all of theirs."""
    return next(o for o in range(size + 2) if 2.0 * o / (o + size) >= threshold)


def _anchors(threshold: float, least: Callable[[int, float], int] = _shared) -> list[str]:
    """Words of the templates; a window (with _least: any unit) without any of them shares too few bigrams with every template."""
    out: set[str] = set()
    for t in (_tokens(x) for _, x in sorted(TEMPLATES.items())):
        pairs = list(zip(t, t[1:], strict=False))
        left = len(pairs) - least(len(pairs), threshold) + 1  # so many must be lost without the anchors
        while sum(bool(out & set(p)) for p in pairs) < left:
            gain = Counter(w for p in pairs if not out & set(p) for w in set(p))
            # Long words are rare in other texts; of those the ones in most bigrams.
            out.add(min(gain, key=lambda w: (w in _COMMON, -min(len(w), 6), -gain[w], w)))
    return sorted(out)


def _any_word(words: list[str]) -> str:
    """A pattern for texts that hold one of the words, alternatives by first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) + r")(?![\p{L}\p{N}])"


def _windows(grams: Column, k: Column, distinct: Column, counts: Column, size: Column, shared: Column, longest: Column, threshold: float) -> Column:
    """The best window from each place of a template's bigram: o (shared), dice, k (negated), a and z (first and last bigram)."""
    hits = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("p"), F.array_position(distinct, g).cast("int").alias("q"))), lambda h: h["q"] > 0)

    def before(all_hits: Column, h: Column, t: Column) -> Column:
        """Where the bigram stood as many times ago as the template has it; it counts in windows that begin after that."""
        same = F.filter(F.slice(all_hits, F.greatest(t - longest + 1, F.lit(1)), F.least(t, longest)), lambda x: x["q"] == h["q"])
        return let(same, lambda x: F.coalesce(F.when(F.size(x) >= F.get(counts, h["q"] - 1), F.get(x, F.size(x) - F.get(counts, h["q"] - 1))["p"]), F.lit(-1)))

    def step(acc: Column, x: Column, first: Column) -> Column:
        o = acc["o"] + F.when((x["v"] < first) & (x["p"] < first + longest), 1).otherwise(0)
        dice = F.lit(2.0) * o / (F.greatest(x["p"] - first + 1, size) + size)
        better = (x["p"] < first + longest) & (dice > acc["dice"])
        return F.struct(o.alias("o"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, o).otherwise(acc["m"]).alias("m"), F.when(better, x["p"]).otherwise(acc["z"]).alias("z"))

    def best(placed: Column, h: Column, t: Column) -> Column:
        start = F.struct(F.lit(0).alias("o"), F.lit(0.0).alias("dice"), F.lit(0).alias("m"), F.lit(-1).alias("z"))
        fold = F.aggregate(F.slice(placed, t + 1, longest), start, lambda acc, x: step(acc, x, h["p"]))
        far = F.get(placed, t + shared - 1)["p"]
        return F.when(far < h["p"] + longest, let(fold, lambda f: F.struct(f["m"].alias("o"), f["dice"].alias("dice"), (-k).alias("k"), h["p"].alias("a"), f["z"].alias("z"))))

    placed = lambda hs: F.transform(hs, lambda h, t: F.struct(h["p"].alias("p"), before(hs, h, t).alias("v")))
    found = let(hits, lambda hs: let(placed(hs), lambda ps: F.transform(ps, lambda h, t: best(ps, h, t))))
    return F.filter(found, lambda w: w.isNotNull() & (w["dice"] >= threshold))


def _apart(windows: Column) -> Column:
    """Windows without a bigram in common, those with most shared bigrams first."""
    ranked = F.reverse(F.array_sort(F.transform(windows, lambda w: F.struct(w["o"].alias("o"), w["dice"].alias("dice"), w["k"].alias("k"), (-w["a"]).alias("a"), w["z"].alias("z")))))
    free = lambda kept, w: ~F.exists(kept, lambda x: (w["z"] >= -x["a"]) & (x["z"] >= -w["a"]))
    return F.aggregate(ranked, F.filter(ranked, lambda w: F.lit(False)), lambda kept, w: F.when(free(kept, w), F.concat(kept, F.array(w))).otherwise(kept))


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")


#: The tag that SPDX expressions stand behind, what they are made of, and what joins identifiers.
SPDX_TAG = "SPDX-License-Identifier:"
SPDX_RUN = r"^[A-Za-z0-9.+() \t-]*"
SPDX_JOINTS = ("AND", "OR", "WITH")


def spdx(text: Column) -> Column:
    """The licences that the SPDX expressions in a text name, sorted: identifiers and AND, OR or WITH by turns, brackets aside; an expression
    ends where anything else stands, and what follows WITH is an exception, no licence."""

    def named(run: Column) -> Column:
        tokens = F.filter(F.split(run, r"[ \t()]+"), lambda t: t != "")

        def licences(ts: Column) -> Column:
            odd = F.transform(ts, lambda t, i: F.when((i % 2 == 1) & ~t.isin(*SPDX_JOINTS), i))
            stop = F.coalesce(F.array_min(odd), F.size(ts))
            placed = F.transform(ts, lambda t, i: F.struct(t.alias("t"), i.alias("i"), (F.coalesce(F.get(ts, i - 1), F.lit("")) == "WITH").alias("exception")))
            return let(stop, lambda end: F.transform(F.filter(placed, lambda p: (p["i"] % 2 == 0) & (p["i"] < end) & ~p["exception"]), lambda p: F.regexp_replace(p["t"], r"[.\-]+$", "")))

        return let(tokens, licences)

    behind = F.split(text, SPDX_TAG, -1)
    runs = F.when(F.contains(text, F.lit(SPDX_TAG)), F.transform(F.slice(behind, 2, F.size(behind) - 1), lambda b: F.regexp_extract(b, SPDX_RUN, 0)))
    names = F.filter(F.flatten(F.transform(runs, named)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<int>")


def scan(docs: DataFrame, threshold: float = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_col, n_lines, n_matches (units with a licence), license and dice of the best one, licenses (sorted names), spdx (sorted identifiers)."""
    grams = template_bigrams()
    sizes = [len(g) for g in grams.values()]
    near = F.array(*map(_ints, _candidates(sizes, threshold)))  # constants; folded into one literal each
    sets = F.array(*(F.array(*map(F.lit, _tagged(g))) for g in grams.values()))
    names = F.array(*map(F.lit, grams))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    # Only texts with an anchor word are split further.
    likely_text = F.when(F.lower(whole).rlike(_any_word(_anchors(threshold, _least))), whole).otherwise(F.lit(""))
    docs = docs.select(F.col(doc_col), likely_text.alias("__text"), (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("__n"), spdx(whole).alias("__spdx"))
    lines = F.split(F.col("__text"), "\n", -1)
    units = F.transform(lines, normal_words)
    # The whole text's words are its lines' words; a text of one line is one unit.
    base = docs.select(F.col(doc_col), units.alias("lines"), F.col("__n").alias("n_lines"), F.col("__spdx").alias("spdx"))
    base = base.select(doc_col, "lines", "n_lines", "spdx", F.when(F.size("lines") > 1, F.concat("lines", F.array(F.flatten("lines")))).otherwise(F.col("lines")).alias("units"))
    fits = F.transform("units", lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(near, F.size(w) - 1), _ints([])).alias("near"), i.alias("i")))
    words = F.get("units", F.size("units") - 1)
    pairs = let(words, lambda w: F.when(F.arrays_overlap(w, F.array(*map(F.lit, _anchors(threshold)))), F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))))
    base = base.select(doc_col, "n_lines", "spdx", "lines", F.filter(fits, lambda u: (F.size(u["w"]) > 1) & (F.size(u["near"]) > 0)).alias("units"), pairs.alias("pairs"))

    def bigrams(words: Column) -> Column:
        return F.array_sort(F.transform(F.slice(words, 2, F.size(words) - 1), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))

    def tagged(sorted_grams: Column) -> Column:
        return F.transform(sorted_grams, lambda g, i: F.concat(g, F.lit(" "), (i + 1 - F.array_position(sorted_grams, g)).cast("string")))

    base = base.select(doc_col, "n_lines", "spdx", "lines", "pairs", F.transform("units", lambda u: F.struct(bigrams(u["w"]).alias("g"), u["near"].alias("near"), u["i"].alias("i"))).alias("units"))
    base = base.select(doc_col, "n_lines", "spdx", "lines", "pairs", F.transform("units", lambda u: F.struct(tagged(u["g"]).alias("g"), u["near"].alias("near"), u["i"].alias("i"))).alias("units"))
    dice = lambda g, k: F.lit(2.0) * F.size(F.array_intersect(g, F.get(sets, k))) / (F.size(g) + F.get(_ints(sizes), k))
    scored = F.transform("units", lambda u: F.array_max(F.filter(F.transform(u["near"], lambda k: F.struct(dice(u["g"], k).alias("dice"), (-k).alias("t"), u["i"].cast("int").alias("i"))), lambda s: s["dice"] >= threshold)))
    # Windows: of templates with enough of their different bigrams in the text.
    kinds = [sorted(set(g)) for g in grams.values()]
    shared = [_shared(b, threshold) for b in sizes]
    table = [F.array(*(F.array(*map(F.lit, x)) for x in kinds)), F.array(*(_ints([g.count(x) for x in ks]) for g, ks in zip(grams.values(), kinds, strict=True))), _ints(sizes), _ints(shared), _ints([int(b * (2 - threshold) / threshold + 1e-9) for b in sizes])]
    enough = _ints([len(x) - b + o for x, b, o in zip(kinds, sizes, shared, strict=True)])
    every = F.array(*map(F.lit, sorted(set().union(*kinds))))
    likely = let(F.array_intersect("pairs", every), lambda p: F.filter(_ints(list(range(len(sizes)))), lambda k: F.size(F.array_intersect(p, F.get(table[0], k))) >= F.get(enough, k)))
    base = base.select(doc_col, "n_lines", "spdx", "lines", "pairs", F.filter(scored, lambda s: s.isNotNull()).alias("found"), F.when(F.size("pairs") > 0, likely).alias("likely"))
    spans = F.when(F.size("likely") > 0, _apart(F.flatten(F.transform("likely", lambda k: _windows(F.col("pairs"), k, *(F.get(t, k) for t in table), threshold)))))
    base = base.select(doc_col, "n_lines", "spdx", "lines", "found", spans.alias("spans"))
    line_of = F.flatten(F.transform("lines", lambda w, i: F.transform(w, lambda _: i)))

    def further(of: Column, w: Column) -> Column:
        first, last = F.get(of, -w["a"]), F.get(of, w["z"] + 1)
        within = lambda s: (s["i"] == first) & (first == last)
        of_text = lambda s: (s["i"] == F.col("n_lines")) & (s["t"] == w["k"]) & (s["dice"] >= w["dice"])
        return ~F.exists("found", lambda s: within(s) | of_text(s))

    extra = let(line_of, lambda of: F.transform(F.filter("spans", lambda w: further(of, w)), lambda w: F.struct(w["dice"].alias("dice"), w["k"].alias("t"), F.lit(-1).alias("i"))))
    found = base.select(doc_col, "n_lines", "spdx", F.when(F.size("spans") > 0, F.concat("found", extra)).otherwise(F.col("found")).alias("found"))
    top = F.array_max("found")
    return found.select(
        doc_col,
        "n_lines",
        F.size("found").cast("long").alias("n_matches"),
        F.get(names, -top["t"]).alias("license"),
        top["dice"].alias("dice"),
        F.array_sort(F.array_distinct(F.transform("found", lambda s: F.get(names, -s["t"])))).alias("licenses"),
        "spdx",
    )
