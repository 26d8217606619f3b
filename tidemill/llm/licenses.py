"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into lines and, at sentence marks, into pieces. A sentence known from a licence, on one line
or wrapped over several, becomes its identifier; every other piece becomes 0. The sequence of identifiers
is matched against ordered rules, which may skip a few unknown pieces; the longest rule goes first and
takes what it matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Wording of public licences and notices. A rule is the ordered sentences of its text.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_NO_EVENT = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT = _GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
_BSD_NO_EVENT = (
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str, later: bool, thing: str = "This program") -> str:
    """A notice of the GNU family."""
    which = f"either version {version} of the License, or (at your option) any later version. " if later else f"version {version} of the License. "
    return (
        f"{thing} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}"
        f"{thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


RULES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice-2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice-2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice-2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0-notice-2": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "mit": _MIT + _AS_IS + _NO_EVENT,
    "mit-0": _GRANT + ". " + _AS_IS + _NO_EVENT,
    "x11": _MIT + _AS_IS + _NO_EVENT.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")
    + "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "isc": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS,
    "0bsd": _ISC + ". " + _ISC_AS_IS,
    "bsd-1-clause": _BSD + _BSD_SOURCE + _BSD_AS_IS + _BSD_NO_EVENT,
    "bsd-2-clause": _BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_AS_IS + _BSD_NO_EVENT,
    "bsd-3-clause": _BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_AS_IS + _BSD_NO_EVENT,
    "bsd-2-clause-conditions": _BSD + _BSD_SOURCE + _BSD_BINARY,
    "bsd-3-clause-conditions": _BSD + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES,
    "ncsa": _GRANT.replace("to deal in", "to deal with") + ", subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. "
    + _AS_IS + _NO_EVENT.replace("AUTHORS OR COPYRIGHT HOLDERS", "CONTRIBUTORS OR COPYRIGHT HOLDERS").replace("OTHER DEALINGS IN", "OTHER DEALINGS WITH"),
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "hpnd": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "curl": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "fsfap": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0; "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-only": _gnu("GNU General Public License", "2", False),
    "gpl-2.0-or-later": _gnu("GNU General Public License", "2", True),
    "gpl-3.0-only": _gnu("GNU General Public License", "3", False),
    "gpl-3.0-or-later": _gnu("GNU General Public License", "3", True),
    "agpl-3.0-only": _gnu("GNU Affero General Public License", "3", False),
    "agpl-3.0-or-later": _gnu("GNU Affero General Public License", "3", True),
    "lgpl-2.1-only": _gnu("GNU Lesser General Public License", "2.1", False, "This library"),
    "lgpl-2.1-or-later": _gnu("GNU Lesser General Public License", "2.1", True, "This library"),
    "lgpl-3.0-only": _gnu("GNU Lesser General Public License", "3", False),
    "lgpl-3.0-or-later": _gnu("GNU Lesser General Public License", "3", True),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-https": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at:",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION; You just DO WHAT THE FUCK YOU WANT TO.",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "unlicense": "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS
    + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-dedication": "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Sentences of fewer words are no identifiers: "2.0" says nothing.
WORDS = 3
ENDS = r"([.!?;:])[ \t]+"
OTHER = r"[^a-z0-9\n]+"


def sentences(text: str) -> list[str]:
    """The normalised sentences of a text, as the DataFrame functions make them."""
    text = re.sub(ENDS, r"\1" + "\n", text).translate(str.maketrans(UPPER, LOWER))
    return [s for s in (x.strip(" ") for x in re.sub(OTHER, " ", text).split("\n")) if s]


def compiled(rules: dict[str, str], gap: int) -> tuple[dict[str, int], list[tuple[int, str, str]]]:
    """Sentence identifiers from 1, and (place, name, pattern over ',id,id,...,') of each rule, longest rules first."""
    known: dict[str, int] = {}
    found = []
    for place, (name, text) in enumerate(rules.items()):
        parts = [s for s in sentences(text) if s.count(" ") >= WORDS - 1]
        ids = [known.setdefault(s, len(known) + 1) for s in parts]
        found.append((-len(ids), -sum(map(len, parts)), place, name, "(?<=,)" + f",(0,){{0,{gap}}}".join(map(str, ids)) + "(?=,)"))
    return known, [x[2:] for x in sorted(found)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None, gap: int = 2) -> DataFrame:
    """Find licence sentences and whole licence rules in each text.

    Returns (id, n_sentences, n_known, known: 'place:identifier' joined by spaces, licenses: names of the
    matched rules in the order of the rules, joined by commas). Letters A-Z are lowered, and other
    characters than a-z0-9 become one space, so that comment marks and quotes don't count. Pieces end at
    line ends and at .!?;: before white space; empty ones are no sentences. Where the pieces from one on,
    without an empty one between, spell a known sentence, they are that sentence, the longest such one;
    what lies within it is nothing of its own. A rule matches where its sentences follow each other in
    order with at most ``gap`` unknown ones between two. Rules of more sentences go first, and what they
    match no other rule matches again. A null or empty text has no sentences and empty results; repeated
    rows repeat; other columns are not read. A projection: no shuffle, no Python.
    """
    known, patterns = compiled(RULES if rules is None else rules, gap)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    clean = F.regexp_replace(F.translate(F.regexp_replace(text, ENDS, "$1\n"), UPPER, LOWER), OTHER, " ")
    rows = df.select(F.col(id_col), clean.alias("__c")).select(id_col, F.transform(F.split("__c", "\n"), lambda s: F.trim(s)).alias("__p"), "__c")
    starts = "|".join(sorted({r"[ \n]+".join(s.split(" ")[:WORDS]) for s in known}))
    some = F.concat(F.lit("\n"), F.col("__c")).rlike(rf"\n ?(?:{starts})") if known else F.lit(False)
    rows = rows.select(id_col, "__p", F.when(some, units(F.col("__p"), known)).alias("__i") if known else F.lit(None).cast("array<int>").alias("__i"))
    count = F.when(F.col("__i").isNull(), F.size(F.filter("__p", lambda s: s != ""))).otherwise(F.size("__i"))
    places = F.filter(F.transform("__i", lambda x, k: F.when(x > 0, F.concat_ws(":", k + 1, x))), lambda x: x.isNotNull())
    rows = rows.select(id_col, count.cast("long").alias("n_sentences"), F.coalesce(places, F.array().cast("array<string>")).alias("__p"), "__i")
    line = F.concat(F.lit(","), F.array_join(F.transform("__i", lambda x: x.cast("string")), ","), F.lit(","))
    names = F.when(F.size("__p") > 0, matched(line, patterns)) if patterns else F.lit(None).cast("string")
    return rows.select(id_col, "n_sentences", F.size("__p").cast("long").alias("n_known"), F.array_join("__p", " ").alias("known"), F.coalesce(names, F.lit("")).alias("licenses"))


def let(x: Column, f) -> Column:
    """``f`` of ``x``, evaluated once."""
    return F.transform(F.array(x), f)[0]


def units(pieces: Column, known: dict[str, int]) -> Column:
    """Identifiers of the sentences that the pieces make."""
    table = F.array(*[F.struct(F.lit(len(s)).alias("n"), F.lit(i).alias("id"), F.lit(s).alias("s")) for s, i in known.items()])
    first = F.array(*[F.lit(w) for w in sorted({s.split(" ")[0] for s in known})])
    wide = max(s.count(" ") + 1 for s in known)  # a word a line

    def at(p: Column, k: Column) -> Column:
        """The longest known sentence from a piece on, and its pieces."""
        lines = F.substring_index(F.array_join(F.slice(p, k + 1, F.lit(wide)), "\n"), "\n\n", 1)

        def longest(b: Column) -> Column:
            fits = F.filter(table, lambda t: b["s"].startswith(t["s"]) & F.substring(b["l"], t["n"] + 1, F.lit(1)).isin("", "\n"))
            return let(F.array_max(fits), lambda t: F.when(t.isNotNull(), F.struct(k.alias("k"), t["id"].alias("id"), F.size(F.split(F.substring(b["l"], F.lit(1), t["n"]), "\n")).alias("n"))))

        return let(F.struct(lines.alias("l"), F.translate(lines, "\n", " ").alias("s")), longest)

    def of(p: Column) -> Column:
        hits = F.filter(F.transform(p, lambda x, k: F.when(F.array_contains(first, F.substring_index(x, " ", 1)), at(p, k))), lambda h: h.isNotNull())
        return let(hits, lambda h: F.filter(F.transform(p, lambda x, k: F.when((x != "") & ~F.exists(h, lambda t: (t["k"] < k) & (k < t["k"] + t["n"])), F.coalesce(F.get(F.filter(h, lambda t: t["k"] == k), F.lit(0))["id"], F.lit(0)))), lambda x: x.isNotNull()))

    return let(pieces, of)


def matched(line: Column, patterns: list[tuple[int, str, str]]) -> Column:
    """Names of the rules found in a line of identifiers; each rule in turn takes its identifiers away."""
    rules = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for place, name, pattern in patterns])
    start = F.struct(line.alias("l"), F.array().cast("array<struct<place:int,name:string>>").alias("found"))

    def take(now: Column, rule: Column) -> Column:
        with_it = F.concat(now["found"], F.array(F.struct(rule["place"].alias("place"), rule["name"].alias("name"))))
        return F.when(F.regexp_like(now["l"], rule["pattern"]), F.struct(F.regexp_replace(now["l"], rule["pattern"], F.lit("0")).alias("l"), with_it.alias("found"))).otherwise(now)

    return F.aggregate(rules, start, take, lambda end: F.array_join(F.transform(F.array_sort(end["found"]), lambda r: r["name"]), ","))


def scan_sql(table: str = "documents", gap: int = 2) -> str:
    """The same scan with the default rules as DuckDB SQL, from the rules' wording on."""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(RULES.items()))
    pieces = lambda x: f"list_transform(string_split(regexp_replace(translate(regexp_replace({x}, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda s: trim(s, ' '))"
    return f"""
WITH RECURSIVE rules(place, name, wording) AS (VALUES {values}),
parts AS (SELECT place, name, unnest(l) AS s, unnest(range(len(l))) AS k FROM (SELECT place, name, list_filter({pieces('wording')}, lambda s: len(string_split(s, ' ')) >= 3) AS l FROM rules)),
known AS (SELECT s, length(s) AS n, split_part(s, ' ', 1) AS word, row_number() OVER (ORDER BY min(place * 1000 + k)) AS id FROM parts GROUP BY s),
patterns AS (SELECT place, name, '((^|,)' || string_agg(CAST(id AS VARCHAR), ',(0,){{0,{gap}}}' ORDER BY k) || ')(,)' AS pattern, row_number() OVER (ORDER BY count(*) DESC, sum(n) DESC, place) AS turn FROM parts JOIN known USING (s) GROUP BY place, name),
docs AS (SELECT row_number() OVER () AS r, doc_id, {pieces("coalesce(text, '')")} AS p FROM {table}),
spread AS (SELECT r, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS k FROM docs),
started AS (SELECT r, x, k, split_part(array_to_string(p[k:k + 399], chr(10)), chr(10) || chr(10), 1) AS l FROM spread JOIN docs USING (r) WHERE split_part(x, ' ', 1) IN (SELECT word FROM known)),
hits AS (SELECT r, k, max_by(id, n) AS id, max_by(len(string_split(substr(l, 1, n), chr(10))), n) AS lines FROM started JOIN known ON split_part(x, ' ', 1) = word AND starts_with(replace(l, chr(10), ' '), s) AND substr(l, n + 1, 1) IN ('', chr(10)) GROUP BY r, k),
units AS (SELECT r, k, coalesce(id, 0) AS id FROM spread LEFT JOIN hits USING (r, k) WHERE x <> '' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.r = spread.r AND h.k < spread.k AND spread.k < h.k + h.lines)),
counted AS (SELECT r, count(*) AS n_sentences, count_if(id > 0) AS n_known, string_agg(CASE WHEN id > 0 THEN u || ':' || id END, ' ' ORDER BY u) AS known, string_agg(CAST(id AS VARCHAR), ',' ORDER BY u) || ',' AS line
  FROM (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY k) AS u FROM units) GROUP BY r),
taken AS (
  SELECT r, CAST(0 AS BIGINT) AS turn, line, CAST([] AS STRUCT(place INTEGER, name VARCHAR)[]) AS found FROM counted WHERE n_known > 0
  UNION ALL
  SELECT r, t.turn + 1, CASE WHEN regexp_matches(line, pattern) THEN regexp_replace(line, pattern, '\\2' || '0' || '\\3', 'g') ELSE line END,
    CASE WHEN regexp_matches(line, pattern) THEN list_append(found, {{'place': CAST(place AS INTEGER), 'name': name}}) ELSE found END
  FROM taken t JOIN patterns ON patterns.turn = t.turn + 1)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, coalesce(known, '') AS known, coalesce(array_to_string(list_transform(list_sort(found), lambda f: f.name), ','), '') AS licenses
FROM docs LEFT JOIN counted USING (r) LEFT JOIN (SELECT r, found FROM taken WHERE turn = (SELECT count(*) FROM rules)) USING (r)"""
