"""Licence scan: Dice coefficient over word bigrams against licence templates.

A unit is a line of a text, a sentence of a line of several, a paragraph (between blank lines) of several lines, or the
whole text if it has several paragraphs.  Units and templates are normalised alike: lower case, words of letters and
digits.  For a template of b distinct bigrams a unit of a distinct bigrams can reach the threshold t only if
t/(2-t) <= a/b <= (2-t)/t, which is tested before any bigrams are compared.  In a line that is too long for a
template, a window of the template's own words in their order counts as a match of its own (``phrase``, Dice 1).

First of all a text must hold a key word: a match shares so many of a template's bigrams that it can't miss all those
with one of its key words, so nothing is lost.  All expressions are built-in; nothing is shuffled, since each row is
scanned by itself.

Null or empty text has no units.  Equal units of a text are all reported.  Ids may be null or repeat.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality_rules import STOP_WORDS

# Notices and short licence texts that are in public use.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BSL = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
    "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(kind: str, version: str) -> list[str]:
    """The file header of a GNU licence, whole and its first sentence."""
    what = "library" if kind == "Lesser " and version == "2.1" else "program"
    first = (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; "
        f"either version {version} of the License, or (at your option) any later version."
    )
    rest = (
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {kind}General Public License for more details."
    )
    return [first, f"{first} {rest}"]


TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_NOTICE} {_MIT_WARRANTY}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", _APACHE],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", *_gnu("", "3")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0.", *_gnu("", "2")],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License v2.1.", *_gnu("Lesser ", "2.1")],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License v3.0.", *_gnu("Lesser ", "3")],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License v3.0.", *_gnu("Affero ", "3")],
    "MPL-2.0": ["Licensed under the Mozilla Public License 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "ISC": [_ISC, f"{_ISC} {_ISC_WARRANTY}"],
    "BSD": [_BSD],
    "BSD-2-Clause": [f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [_BSD_NAMES, f"{_BSD} 1. {_BSD_SOURCE} 2. {_BSD_BINARY} 3. {_BSD_NAMES} {_BSD_WARRANTY}"],
    "Zlib": [_ZLIB],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", _BSL],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_REST}"],
    "Proprietary": ["All rights reserved."],
}
for _name, _texts in TEMPLATES.items():
    if _name not in ("BSD", "Proprietary"):
        _texts.append(f"SPDX-License-Identifier: {_name}")


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def key_words(pairs: list[str], threshold: float) -> set[str]:
    """Words of a template of which every match has one: together they stand in more of its bigrams than a match can
    miss.  Longer words come first and stop words last, as that is how rare they are."""
    b = len(pairs)
    least = math.ceil(b * threshold / (2 - threshold) - 1e-9)
    missed = b - math.ceil(threshold * (least + b) / 2 - 1e-9)
    picked, covered = set(), set()
    for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w in STOP_WORDS, -len(w), w)):
        if len(covered) > missed:
            break
        picked.add(word)
        covered |= {p for p in pairs if word in p.split()}
    return picked


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per match: id, unit_kind (line, sentence, paragraph, text or phrase), unit (from 0; of a sentence or phrase its
    line's), license_id, variant (from 0), dice."""
    known = [(name, i, b, " ".join(words_of(text))) for name, texts in templates.items() for i, text in enumerate(texts) if (b := bigrams(text))]
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    table = F.array(*[F.struct(F.lit(n).alias("license_id"), F.lit(i).alias("variant"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), F.lit(f" {w} ").alias("words")) for n, i, b, w in known])
    keys = F.array(*map(F.lit, sorted(set().union(*[key_words(b, threshold) for _, _, b, _ in known])))) if known else F.array().cast("array<string>")
    split = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), "")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("_text")).where(F.arrays_overlap(split("_text"), keys))
    unit = lambda kind, i, body: F.struct(F.lit(kind).alias("unit_kind"), i.alias("unit"), body.alias("body"))
    lines = F.transform(F.split("_text", "\n"), lambda u, i: unit("line", i, u))
    parts = F.flatten(F.transform(F.split("_text", "\n"), lambda u, i: F.transform(F.split(F.regexp_replace(u, r"([.!?;])[\x20\t]+", "$1\x01"), "\x01"), lambda s: F.struct(F.lit("sentence").alias("unit_kind"), i.alias("unit"), s.alias("body"), (s == u).alias("whole")))))
    sentences = F.transform(F.filter(parts, lambda s: ~s.whole), lambda s: unit("sentence", s.unit, s.body))
    paragraphs = F.transform(F.split("_text", r"\n[\x20\t\r]*\n"), lambda u, i: unit("paragraph", i, u))
    several = F.filter(paragraphs, lambda u: F.contains(F.trim(u.body, F.lit("\n\r\t ")), F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(unit("text", F.lit(0), F.col("_text")))).otherwise(F.array().cast("array<struct<unit_kind:string,unit:int,body:string>>"))
    units = rows.select("id", F.explode_outer(F.concat(lines, sentences, several, whole)).alias("u")).select("id", "u.*")
    words = units.withColumn("_w", split("body")).drop("body")
    fewest = min((len(b) * least for *_, b, _ in known), default=0.0)  # distinct bigrams are fewer than words
    fit = F.arrays_overlap("_w", keys) & (F.size("_w") - 1 >= fewest)
    made = words.withColumn("_b", F.when(fit, F.expr("array_distinct(zip_with(slice(_w, 1, size(_w) - 1), slice(_w, 2, size(_w) - 1), (a, b) -> concat(a, ' ', b)))")).otherwise(F.array().cast("array<string>")))
    made = made.withColumn("_s", F.when((F.col("unit_kind") == "line") & (F.size("_b") > 0), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))).drop("_w")
    fits = F.filter(table, lambda t: (F.size("_b") >= t.n * F.lit(least) - 1e-9) & (F.size("_b") <= t.n * F.lit(most) + 1e-9))
    match = lambda kind, t, dice: F.struct(kind.alias("unit_kind"), t.license_id.alias("license_id"), t.variant.alias("variant"), dice.alias("dice"))
    dice = F.filter(F.transform(fits, lambda t: match(F.col("unit_kind"), t, 2.0 * F.size(F.array_intersect(F.col("_b"), t.b)) / (F.size("_b") + t.n))), lambda d: d.dice >= threshold)
    held = F.filter(table, lambda t: (F.size("_b") > t.n * F.lit(most) + 1e-9) & F.coalesce(F.contains("_s", t.words), F.lit(False)))
    phrases = F.transform(held, lambda t: match(F.lit("phrase"), t, F.lit(1.0)))
    # explode_outer: of a plain explode Spark infers "has matches" and pushes it below, where all is computed again
    found = made.select("id", "unit", F.explode_outer(F.concat(dice, phrases)).alias("d")).where("d is not null")
    return found.select(F.col("id").alias(id_col), "d.unit_kind", "unit", "d.license_id", "d.variant", "d.dice")


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL for the query over ``documents``, from the same templates and without a first filter."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, {i}, [{', '.join(map(quote, b))}], {quote(' ' + ' '.join(words_of(t)) + ' ')})" for n, ts in TEMPLATES.items() for i, t in enumerate(ts) if (b := bigrams(t)))
    most = (2 - threshold) / threshold
    return rf"""
WITH t(license_id, variant, tb, tw) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
p AS (SELECT doc_id, 'line' AS unit_kind, string_split(x, chr(10)) AS us FROM d
      UNION ALL SELECT doc_id, 'paragraph', regexp_split_to_array(x, '\n[\x20\t\r]*\n') FROM d),
l AS (SELECT doc_id, unit_kind, i - 1 AS unit, us[i] AS body, len(us) AS many FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM p)),
u AS (SELECT doc_id, unit_kind, unit, body FROM l WHERE unit_kind = 'line' OR contains(trim(body, chr(10) || chr(13) || chr(9) || ' '), chr(10))
      UNION ALL SELECT * FROM (SELECT doc_id, 'sentence', unit, unnest(string_split(regexp_replace(body, '([.!?;])[\x20\t]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM l WHERE unit_kind = 'line'
                               AND contains(regexp_replace(body, '([.!?;])[\x20\t]+', '\1' || chr(1), 'g'), chr(1)))
      UNION ALL SELECT doc_id, 'text', 0, x FROM d WHERE regexp_matches(x, '\n[\x20\t\r]*\n')),
w AS (SELECT doc_id, unit_kind, unit, list_filter(string_split(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM u),
b AS (SELECT doc_id, unit_kind, unit, ws, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM w WHERE len(ws) > 1),
m AS (SELECT doc_id, unit_kind, unit, license_id, variant, 2.0::DOUBLE * len(list_intersect(bs, tb)) / (len(bs) + len(tb)) AS dice FROM b, t WHERE len(bs) <= {most!r} * len(tb) + 1e-9)
SELECT * FROM m WHERE dice >= {threshold}
UNION ALL SELECT doc_id, 'phrase', unit, license_id, variant, 1.0::DOUBLE FROM b, t
WHERE unit_kind = 'line' AND len(bs) > {most!r} * len(tb) + 1e-9 AND contains(' ' || array_to_string(ws, ' ') || ' ', tw)"""
