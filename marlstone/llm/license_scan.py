"""Licence recognition by sentence identifiers and ordered rules (operator 8): DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_row

# Sentences of public licence texts and notices, in their usual wording.
SENTENCES = {
    "mit-short": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'],
    "apache-short": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3"],
    "gpl2-short": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program"],
    "cc-by-short": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-short": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-short": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "reserved": ["All rights reserved"],
    "gpl2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-exact": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl21-grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-short": ["Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-short": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "epl2-grant": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "epl-short": ["Licensed under the Eclipse Public License, version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "unlicense-use": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "cc0-notice": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc0-short": ["Licensed under CC0 1.0", "This work is licensed under a Creative Commons Zero 1.0 Universal License"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "boost-short": ["Distributed under the Boost Software License, Version 1.0"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsd-short": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "cc-by-nc-sa-short": ["Licensed under CC BY-NC-SA 4.0"],
}
# SPDX identifier, and the sentence identifiers that must follow each other; among rules of one length the earlier comes first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-short"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-short"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("LicenseRef-AllRightsReserved", ["reserved"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-2.0-only", ["gpl2-exact", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-exact"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "lgpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-3.0-only", ["lgpl-short"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("AGPL-3.0-only", ["agpl-short"]),
    ("EPL-2.0", ["epl2-grant"]),
    ("EPL-2.0", ["epl-short"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("Unlicense", ["unlicense-grant", "unlicense-use"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-short"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-short"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSD-3-Clause", ["bsd-short"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-short"]),
]
#: The order in which rules are tried: a longer one first, and what it matches is no part of another match.
ORDERED = sorted(RULES, key=lambda r: -len(r[1]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at one of .!?: before white space or the end, and at a line's or a paragraph's end.
BY_LINE, BY_PARAGRAPH = "[.!?:]+[ \t\r]*(\n|$)|[.!?:]+[ \t\r]+|\n", "[.!?:]+[ \t\r\n]+|[.!?:]+$|\n[ \t\r]*\n"
#: Every known sentence has one of these, whatever stands between its words, so a text without them has none.
STEMS = "(?i)licen[sc]|permission|permitted|redistribut|warrant|copyright|reserved|free[^a-zA-Z0-9]+software|unencumbered|anyone|distributed"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Known normalised sentences; a rule's sentence is split as a text's is, and its first part stands for it.
KNOWN = {normal(re.split(BY_PARAGRAPH, s)[0]): k for k, versions in SENTENCES.items() for s in versions}
assert all(re.search(STEMS, s) for s in KNOWN)


def _identifiers(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    parts = F.split(F.translate(text, UPPER, LOWER), ends)
    found = F.transform(parts, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))))
    return F.filter(found, lambda x: x.isNotNull())


def _token(ids: list[str]) -> str:
    return "".join(f"<{k}>" for k in ids)


def _wider(ids: list[str]) -> list[int]:
    """The rules that hold the sequence ``ids`` and more."""
    return [i for i, (_, other) in enumerate(ORDERED) if len(other) > len(ids) and _token(ids) in _token(other)]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``(row, sentences, licences)`` for every row of ``df``.

    A text is split into sentences twice, by lines and by paragraphs (so notices that are wrapped over
    lines are whole); each normalised sentence (A-Z lowered, anything but a-z and 0-9 as one
    space) is looked up in the fixed list.  In each reading the rules are tried in order, longer ones first: a rule matches where
    its identifiers follow each other among the known sentences, and takes them, so no shorter rule matches there again.  A match
    of one reading is left out where the other one has a longer rule in its place.  ``licences``: the distinct matches,
    sorted; ``sentences``: the distinct identifiers found, sorted.

    Null and empty texts, and texts without any stem that known sentences have, give empty arrays; a very long text is read whole; repeated rows are each
    returned; an empty table gives an empty result.  The row is kept whole in ``row``, so no column can clash.
    """
    t = F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    rows = as_row(df).withColumn("t", F.when(t.rlike(STEMS), t))
    read = rows.select("row", *(F.when(F.col("t").isNotNull(), _identifiers(F.col("t"), e)).otherwise(none).alias(n) for n, e in (("a", BY_LINE), ("b", BY_PARAGRAPH))))
    left = read.select("row", F.sort_array(F.array_union("a", "b")).alias("sentences"), *(F.array_join(F.transform(n, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias(f"{n}0") for n in "ab"))
    some = F.size("sentences") > 0  # few texts hold a known sentence: only these are matched

    def matches(n: str) -> Column:
        """Positions of the rules that match in reading ``n``: each takes its identifiers out of what is left."""
        start = F.struct(F.col(f"{n}0").alias("left"), F.array().cast("array<int>").alias("hits"))
        rules = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(_token(ids)).alias("ids")) for i, (_, ids) in enumerate(ORDERED)))
        step = lambda acc, r: F.when(F.contains(acc["left"], r["ids"]), F.struct(F.replace(acc["left"], r["ids"], F.lit("|")).alias("left"), F.array_append(acc["hits"], r["i"]).alias("hits"))).otherwise(acc)
        return F.when(some, F.aggregate(rules, start, step)["hits"]).otherwise(F.array().cast("array<int>")).alias(f"{n}_hits")

    met = left.select("row", "sentences", matches("a"), matches("b"))
    wider = F.array(*(F.array(*map(F.lit, _wider(ids))).cast("array<int>") for _, ids in ORDERED))
    names = F.array(*(F.lit(name) for name, _ in ORDERED))
    own = lambda n, m: F.filter(n, lambda i: F.array_contains(m, i) | ~F.arrays_overlap(F.get(wider, i), m))
    found = F.transform(F.array_union(own("a_hits", F.col("b_hits")), own("b_hits", F.col("a_hits"))), lambda i: F.get(names, i))
    return met.select("row", "sentences", F.when(some, F.sort_array(F.array_distinct(found))).otherwise(none).alias("licences"))


def oracle() -> str:
    """The same result in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(k)})" for s, k in KNOWN.items())
    names = ", ".join(f"({i}, {q(name)})" for i, (name, _) in enumerate(ORDERED))
    wider = ", ".join(f"({i}, {j})" for i, (_, ids) in enumerate(ORDERED) for j in _wider(ids))
    chain, last = [], "seq"
    for i, (_, ids) in enumerate(ORDERED):
        chain.append(f"m{i} AS (SELECT r, v, replace(q, {q(_token(ids))}, '|') AS q, CASE WHEN contains(q, {q(_token(ids))}) THEN list_append(hits, {i}) ELSE hits END AS hits FROM {last})")
        last = f"m{i}"
    return f"""
WITH known(s, k) AS (VALUES {known}), names(i, name) AS (VALUES {names}), wider(i, j) AS (VALUES {wider}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
parts AS (SELECT r, v, i, trim(regexp_replace(p[i], '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT r, v, p, unnest(range(1, len(p) + 1)) AS i FROM (
  SELECT r, 'a' AS v, string_split_regex(t, {q(BY_LINE)}) AS p FROM d UNION ALL SELECT r, 'b', string_split_regex(t, {q(BY_PARAGRAPH)}) FROM d))),
ids AS (SELECT r, v, i, k FROM parts JOIN known USING (s)),
seq AS (SELECT r, v, string_agg('<' || k || '>', '' ORDER BY i) AS q, CAST([] AS INTEGER[]) AS hits FROM ids GROUP BY r, v),
{', '.join(chain)},
h AS (SELECT r, v, unnest(hits) AS i FROM {last}),
own AS (SELECT DISTINCT r, i FROM h WHERE EXISTS (SELECT 1 FROM h o WHERE o.r = h.r AND o.v <> h.v AND o.i = h.i) OR NOT EXISTS (SELECT 1 FROM h o JOIN wider w ON w.j = o.i WHERE o.r = h.r AND o.v <> h.v AND w.i = h.i)),
hits AS (SELECT r, string_agg(name, ',' ORDER BY name) AS licences FROM (SELECT DISTINCT r, name FROM own JOIN names USING (i)) GROUP BY r),
found AS (SELECT r, string_agg(k, ',' ORDER BY k) AS sentences FROM (SELECT DISTINCT r, k FROM ids) GROUP BY r)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(licences, '') AS licences FROM d LEFT JOIN found USING (r) LEFT JOIN hits USING (r)
"""
