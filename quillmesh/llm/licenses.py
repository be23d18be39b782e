"""Licence notices: normalised passages compared with templates by the Dice coefficient over word bigrams.

All of it is DataFrame expressions within a row: no shuffle, no Python. Size bounds prune candidates: with a
coefficient of t at least, a passage of n different bigrams can match a template of m only if
t / (2 - t) * m <= n <= (2 - t) / t * m.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rename_columns

# Notices by which works name their licence.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    # Titles, conditions and disclaimers of whole licence texts, paragraph by paragraph.
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Words that say little; they are taken last where templates are to be told by single words.
_COMMON = frozenset("a all an and any are as at be by for from in is it its not of on or that the this to with".split())


def _words(text: str) -> list[str]:
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def _sequence(text: str) -> list[str]:
    words = _words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bigrams(text: str) -> list[str]:
    """Different word bigrams of a text in order; words as in the plan below."""
    return list(dict.fromkeys(_sequence(text)))


def telling_words(templates: tuple[tuple[str, str], ...], least: float) -> list[str]:
    """Words one of which every match holds. With a coefficient of least, a passage shares at least
    least / (2 - least) of a template's bigrams (the size bound says how few it may have itself), so that words which
    touch more than the rest of them can't all be missing."""
    out: set[str] = set()
    count: dict[str, int] = {}
    for _, text in templates:
        for w in set(_words(text)):
            count[w] = count.get(w, 0) + 1
    for _, text in templates:
        grams = set(bigrams(text))
        left = {g for g in grams if not out & set(g.split())}
        may_miss = (1 - least / (2 - least)) * len(grams)
        for w in sorted({w for g in left for w in g.split()}, key=lambda w: (w in _COMMON, -count[w], w)):
            if len(grams) - len(left) > may_miss:
                break
            out.add(w)
            left = {g for g in left if w not in g.split()}
    return sorted(out)


def anchors(text: str, common: dict[str, int], least: float) -> list[str]:
    """Bigrams of a template one of which every match holds: one more than a match may miss, those that say most."""
    grams = bigrams(text)
    may_miss = len(grams) - math.ceil(least / (2 - least) * len(grams) - 1e-9)
    by_weight = sorted(grams, key=lambda g: (sum(w in _COMMON for w in g.split()), common[g], g))
    return by_weight[: may_miss + 1]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """docs -> (doc_id, n_passages long, license string, dice double, licenses string), one row per row of docs.

    Passages are the lines of the whole text, and its paragraphs (parted by blank lines) of more than one line. Words
    are runs of letters and digits (A-Z lowered) and of characters beyond ASCII. A passage too long for a template is
    compared with it at every window of the template's length; of a window, the best match counts (of ties, the first
    licence in alphabetical order). n_passages counts passages that match a template, whole or in a window, with a
    coefficient of least or more; license and dice are the best match, null if there is none; licenses lists those of
    each whole passage or window that matches, sorted, without repetition. Null and empty texts match nothing. Ids may be
    null or repeat; other columns are ignored.

    A match shares at least least / (2 - least) of a template's bigrams. So it holds one of any set of bigrams that is
    larger than what it may miss, and only windows around such anchors are looked at, in passages that hold enough.
    """
    q = lambda words: ", ".join(repr(w) for w in words)
    common = Counter(g for _, text in templates for g in bigrams(text))
    known = ", ".join(
        f"named_struct('license', '{name}', 'n', {len(g)}, 'grams', array({q(g)}), 'anchors', array({q(anchors(text, common, least))}), 'long', {len(_sequence(text))})" for name, text in templates if (g := bigrams(text))
    )
    every = q(sorted({a for _, text in templates if bigrams(text) for a in anchors(text, common, least)}))
    low, high = least / (2 - least), (2 - least) / least
    telling = rf"(?:^|[ \n])(?:{'|'.join(telling_words(templates, least))})(?:[ \n]|$)"
    own = rename_columns(docs, doc_id=id_col, text=text_col)
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    out = own.select("doc_id", F.regexp_replace(text, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ").alias("t"))
    passages = r"concat(split(t, '\n'), transform(filter(split(t, '\n *\n'), p -> locate('\n', trim(BOTH ' \n' FROM p)) > 0), p -> translate(p, '\n', ' ')))"
    # Texts and then passages without a telling word end here.
    words = f"if(t rlike '{telling}', transform(filter({passages}, p -> p rlike '{telling}'), p -> array_remove(split(p, ' '), '')), cast(array() AS array<array<string>>))"
    grams = f"transform(filter({words}, w -> size(w) > 1), w -> zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)))"
    at = f"filter(sequence(1, size(g)), i -> element_at(g, i) IN ({every}))"
    out = out.select("doc_id", F.expr(f"transform({grams}, g -> struct(g AS s, array_distinct(g) AS g, {at} AS at))").alias("passages"))
    known = f"array({known})"
    match = lambda g, start: f"struct(2.0D * size(array_intersect({g}, k.grams)) / (size({g}) + k.n) AS dice, k.license AS license, {start} AS start)"
    order = "(x, y) -> CASE WHEN x.dice > y.dice THEN -1 WHEN x.dice < y.dice THEN 1 WHEN x.license < y.license THEN -1 WHEN x.license > y.license THEN 1 ELSE 0 END"
    good = f"m -> m.dice >= {least!r}D"
    fits = f"filter({known}, k -> size(p.g) >= {low!r}D * k.n - 1e-9 AND size(p.g) <= {high!r}D * k.n + 1e-9)"
    whole = f"slice(array_sort(filter(transform({fits}, k -> {match('p.g', '0')}), {good}), {order}), 1, 1)"
    mine = "array_contains(k.anchors, element_at(p.s, i))"
    here = f"filter({known}, k -> size(p.g) > {high!r}D * k.n + 1e-9 AND exists(p.at, i -> {mine}) AND size(array_intersect(p.g, k.grams)) >= {low!r}D * k.n - 1e-9)"
    # The windows that hold an anchor, each once: from the one that ends with it, or follows the last anchor, on.
    starts = f"transform(array(filter(p.at, i -> {mine})), h -> flatten(transform(h, (i, n) -> sequence(greatest(1, i - k.long + 1, if(n > 0, get(h, n - 1) + 1, 1)), i))))[0]"
    windows = f"flatten(transform({here}, k -> filter(transform({starts}, b -> {match('array_distinct(slice(p.s, b, k.long))', 'b')}), {good})))"
    better = "exists(ms, x -> x.start = m.start AND (x.dice > m.dice OR (x.dice = m.dice AND x.license < m.license)))"
    best = f"transform(array({windows}), ms -> filter(ms, m -> NOT {better}))[0]"
    found = f"filter(transform(passages, p -> concat({whole}, if(size(p.at) > 0, {best}, cast(array() AS array<struct<dice:double,license:string,start:int>>)))), f -> size(f) > 0)"
    out = out.select("doc_id", F.expr(found).alias("f")).select("doc_id", F.size("f").cast("long").alias("n_passages"), F.expr(f"array_sort(flatten(f), {order})").alias("found"))
    licenses = F.expr("concat_ws(',', array_sort(array_distinct(transform(found, m -> m.license))))")
    return out.select("doc_id", "n_passages", F.expr("get(found, 0).license").alias("license"), F.expr("get(found, 0).dice").alias("dice"), licenses.alias("licenses"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> str:
    """DuckDB SQL for the same rows."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(x) for x in bigrams(text))}], {len(_sequence(text))})" for i, (name, text) in enumerate(templates))
    return f"""
WITH k(kid, license, g, long) AS (VALUES {rows}),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS t FROM documents),
p AS (SELECT r, unnest(string_split(t, chr(10))) AS p FROM t
    UNION ALL SELECT r, p FROM (SELECT r, unnest(string_split_regex(t, '\\n *\\n')) AS p FROM t) WHERE contains(trim(p, ' ' || chr(10)), chr(10))),
n AS (SELECT row_number() OVER () AS i, r, list_filter(string_split_regex(p, '[ \\n]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT i, r, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) AS s FROM n WHERE len(w) > 1),
g AS (SELECT i, r, s, list_distinct(s) AS g FROM s),
whole AS (SELECT i, r, license, 2.0::DOUBLE * len(list_intersect(g.g, k.g)) / (len(g.g) + len(k.g)) AS dice FROM g JOIN k ON list_has_any(g.g, k.g)
    QUALIFY dice >= {least!r}::DOUBLE AND row_number() OVER (PARTITION BY i ORDER BY dice DESC, license) = 1),
long AS (SELECT i, r, s, k.license, k.g, k.long FROM g JOIN k ON len(g.g) > {(2 - least) / least!r}::DOUBLE * len(k.g) + 1e-9 AND len(list_intersect(g.g, k.g)) >= {least / (2 - least)!r}::DOUBLE * len(k.g) - 1e-9),
pos AS (SELECT i, r, license, g, list_distinct(list_slice(s, j, j + long - 1)) AS w, j FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM long)),
windows AS (SELECT i, r, j, license, 2.0::DOUBLE * len(list_intersect(w, g)) / (len(w) + len(g)) AS dice FROM pos
    QUALIFY dice >= {least!r}::DOUBLE AND row_number() OVER (PARTITION BY i, j ORDER BY dice DESC, license) = 1),
m AS (SELECT i, r, license, dice FROM whole UNION ALL SELECT i, r, license, dice FROM windows),
d AS (SELECT r, count(DISTINCT i) AS n_passages, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY r)
SELECT doc_id, coalesce(n_passages, 0) AS n_passages, license, dice, coalesce(licenses, '') AS licenses FROM t LEFT JOIN d USING (r)
"""
