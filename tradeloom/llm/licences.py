"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at blank lines (lines without an ASCII letter or
digit, such as a lone comment mark) and after full stops and the like; a line
end inside a sentence counts as a space, so wrapped and commented notices read
as if they stood on one line. A normalised sentence that the table knows gives
its identifier. One that it doesn't know is tried again without its first line
(a title or copyright line above a notice), then line by line, so that a notice
of one line needs no full stop around it. The sequence of identifiers of a text
is matched against licence rules in their order: a rule that finds its sequence
of identifiers takes it out, so that a later and more general rule can't count
it again. Unknown sentences don't break a sequence. Whoever holds the rights in
the third BSD clause is a placeholder. Reserved rights on a copyright line, or on
the line below it, say nothing; elsewhere they count only where no licence does.

Everything happens within a row; nothing is shuffled or joined. Null and empty
texts have no sentences. Repeated rows are scanned each; extra columns stay in
:func:`scan`, whose own three columns replace those of the same name. A very
long text is one array of its sentences.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.session import read

#: What becomes one space inside a sentence, what is dropped at its edges, and marks that stand alone.
_NOISE, _EDGE, _LONE = "[^a-z0-9.+-]+", "^[ .+-]+|[ .+-]+$", " [.+-]+ "
#: Where a sentence ends, and a "v." that ends none.
_END = "\\n[^A-Za-z0-9\\n]*\\n|[.!?;:]+[ \\t\\r\\n]+"
_VERSION = "([ ,(])[vV]\\.[ \\t\\r\\n]+([0-9])"
#: A company's short form inside a sentence, and reserved rights that belong to a copyright line.
_COMPANY = "\\b(Inc|Ltd|Corp|Co|LLC|GmbH)\\.([ \\t\\r\\n]+[a-z])"
_RIGHTS = "([Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][^\\n]{0,200}?)\\.?[ \\t]*\\r?\\n?[^A-Za-z0-9\\n]{0,20}([Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd])"
#: The holder in a normalised sentence, and what stands for it in the table.
_HOLDER = "^neither the name of .{1,120}? nor the names of .{1,80}? may be used "
_ANY_HOLDER = "neither the name of the copyright holder nor the names of its contributors may be used "


def key_of(sentence: str) -> str:
    """A sentence as the table has it: what :func:`normalised` gives."""
    return re.sub(_EDGE, "", re.sub(_LONE, " ", re.sub(_NOISE, " ", re.sub(_VERSION, r"\1v.\2", sentence).lower())))


#: Sentences of the standard notices and licence texts, by identifier.
NOTICES = [
    ("MitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("AsIs", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'),
    ("NoLiability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("MitTitle", "The MIT License (MIT)"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("FreeSoftware", "This program is free software"),
    ("FreeSoftware", "This library is free software"),
    ("Gpl3Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Gpl2Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GplRedistribute", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Gpl3", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("Gpl2", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("Agpl3Later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Lgpl3Later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Lgpl21Later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("GplHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GplImplied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GplSee", "See the GNU General Public License for more details."),
    ("GplSee", "See the GNU Affero General Public License for more details."),
    ("GplSee", "See the GNU Lesser General Public License for more details."),
    ("GplCopy", "You should have received a copy of the GNU General Public License along with this program."),
    ("GplCopy", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("GplCopy", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("Mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Mpl2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Mpl2Copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdEndorse", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdEndorse", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("LgplRedistribute", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LgplRedistribute", "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("Later21", "either version 2.1 of the License, or (at your option) any later version."),
    ("Apache2Text", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache2Text", "Apache License Version 2.0, January 2004"),
    ("Lgpl3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("Gfdl13", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Gfdl12", "GNU Free Documentation License Version 1.2, November 2002"),
    ("Artistic1", 'The "Artistic License"'),
    ("Mpl11", "Mozilla Public License Version 1.1"),
    ("Mpl11", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")'),
    ("Mpl2", "Mozilla Public License Version 2.0"),
    ("Cc0", "CC0 1.0 Universal"),
    ("BsdAsIs", 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.'),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("IscAsIs", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Normalised short sentences of well-known licence notices and their identifiers.
SENTENCES = {
    "released under the mit license": "MitReleased",
    "licensed under the mit license": "MitReleased",
    "this project is licensed under the mit license": "MitReleased",
    "mit license": "MitTitle",
    "the mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "AsIs",
    "licensed under the apache license version 2.0": "Apache2",
    "licensed under the apache license version 2.0 the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "Gpl3",
    "licensed under the gnu general public license version 3": "Gpl3",
    "this work is licensed under the gnu general public license version 2": "Gpl2",
    "licensed under the gnu general public license version 2": "Gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplRedistribute",
    "either version 3 of the license or at your option any later version": "Later3",
    "either version 2 of the license or at your option any later version": "Later2",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "licensed under the gnu lesser general public license version 3": "Lgpl3",
    "licensed under the gnu affero general public license version 3": "Agpl3",
    "licensed under the mozilla public license version 2.0": "Mpl2",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "Mpl2",
    "licensed under the bsd license": "Bsd",
    "licensed under the bsd 3-clause license": "Bsd3",
    "licensed under the bsd 2-clause license": "Bsd2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by 4.0": "CcBy4",
    "this work is licensed under cc by 4.0": "CcBy4",
    "licensed under cc by-sa 4.0": "CcBySa4",
    "licensed under cc by-nc 4.0": "CcByNc4",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CcBySa4",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CcByNc4",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "released into the public domain": "PublicDomain",
    "licensed under cc0 1.0": "Cc0",
    "all rights reserved": "AllRights",
}
SENTENCES |= {key_of(text): name for name, text in NOTICES}
#: Rules in the order in which they are tried.
RULES = [
    ("MIT", ["MitTitle", "MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitTitle", "MitGrant"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitReleased"]),
    ("MIT", ["MitGrant"]),
    ("Apache-2.0", ["Apache2", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Apache2", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["Apache2"]),
    ("Apache-2.0", ["Apache2Text"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("GPL-3.0-or-later", ["GplRedistribute", "Later3", "GplHope"]),
    ("GPL-3.0-or-later", ["GplRedistribute", "Later3"]),
    ("GPL-2.0-or-later", ["GplRedistribute", "Later2"]),
    ("LGPL-3.0-or-later", ["LgplRedistribute", "Later3"]),
    ("LGPL-2.1-or-later", ["LgplRedistribute", "Later21"]),
    ("LGPL-2.0-or-later", ["LgplRedistribute", "Later2"]),
    ("GPL-3.0-only", ["Gpl3"]),
    ("GPL-2.0-only", ["Gpl2"]),
    ("LGPL-3.0-only", ["Lgpl3"]),
    ("AGPL-3.0-only", ["Agpl3"]),
    ("MPL-2.0", ["Mpl2"]),
    ("MPL-1.1", ["Mpl11"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdEndorse"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdEndorse"]),
    ("BSD-3-Clause", ["Bsd3"]),
    ("BSD-2-Clause", ["BsdGrant"]),
    ("BSD-2-Clause", ["Bsd2"]),
    ("BSD", ["Bsd"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("ISC", ["IscGrant"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-Domain", ["PublicDomain"]),
    ("GPL", ["GplRedistribute"]),
    ("LGPL", ["LgplRedistribute"]),
    ("GFDL-1.3-only", ["Gfdl13"]),
    ("GFDL-1.2-only", ["Gfdl12"]),
    ("Artistic-1.0", ["Artistic1"]),
    ("MIT", ["MitTitle"]),
    ("Proprietary", ["AllRights"]),
]
#: Named only where no other licence is.
_LAST = "Proprietary"


def _sequence(names: list[str]) -> str:
    return "".join(f",{n}," for n in names)


def normalised(sentence: Column) -> Column:
    spaced = F.regexp_replace(F.lower(sentence), _NOISE, " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, _LONE, " "), _EDGE, ""), _HOLDER, _ANY_HOLDER)


def scan(documents: DataFrame, text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``documents`` with ``sentence_ids`` and ``licences`` (arrays, in text order and rule order) and ``n_sentences``."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(sentences.items())])
    known = lambda s: F.try_element_at(table, normalised(s))

    def identifiers(s: Column) -> Column:
        """The identifiers in a sentence, joined by commas; null if there is none."""
        lines = F.split(s, "\n")
        first, rest = known(F.get(lines, 0)), known(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "))
        after = F.concat(F.coalesce(F.concat(first, F.lit(",")), F.lit("")), rest)
        each = F.nullif(F.array_join(F.filter(F.transform(lines, known), lambda x: x.isNotNull()), ","), F.lit(""))
        return F.coalesce(known(s), F.when(F.contains(s, F.lit("\n")), F.coalesce(after, each)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    for pattern, put in ((_VERSION, "$1v.$2"), (_COMPANY, "$1$2"), (_RIGHTS, "$1 $2")):
        text = F.regexp_replace(text, pattern, put)
    cut = F.split(text, _END)
    kept = [c for c in documents.columns if c not in ("n_sentences", "sentence_ids", "licences")]
    parts = documents.select(*[F.col(f"`{c}`") for c in kept], F.filter(cut, lambda s: s.rlike("[^ \\t\\r\\n]")).alias("n_sentences"))
    found = F.array_join(F.filter(F.transform("n_sentences", identifiers), lambda s: s.isNotNull()), ",")
    parts = parts.select(*[F.col(f"`{c}`") for c in kept], F.size("n_sentences").cast("long").alias("n_sentences"), found.alias("sentence_ids"))
    left = F.concat(F.lit(","), F.replace("sentence_ids", F.lit(","), F.lit(",,")), F.lit(","))
    hits = []
    for name, ids in rules:
        pattern = F.lit(_sequence(ids))
        hits.append(F.when(F.contains(left, pattern), F.lit(name)))
        left = F.replace(left, pattern, F.lit("|"))
    licences = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    licences = F.when(F.size(licences) > 1, F.array_remove(licences, _LAST)).otherwise(licences)
    some, nothing = F.col("sentence_ids") != "", F.array().cast("array<string>")
    return parts.withColumns({"licences": F.when(some, licences).otherwise(nothing), "sentence_ids": F.when(some, F.split("sentence_ids", ",")).otherwise(nothing)})


def op1_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences")
    )


def sql() -> str:
    """The same result in SQL, by a join with the sentence table."""
    quoted = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    left, cases = "seq", []
    for k, (name, ids) in enumerate(RULES):
        cases.append(f"CASE WHEN contains({left}, '{_sequence(ids)}') THEN '{name}' END AS r{k}")
        left = f"replace({left}, '{_sequence(ids)}', '|')"
    order = ", ".join(f"({k}, r{k})" for k in range(len(RULES)))
    key = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '{_NOISE}', ' ', 'g'), '{_LONE}', ' ', 'g'), '{_EDGE}', '', 'g'), '{_HOLDER}', '{_ANY_HOLDER}')"
    text = "coalesce(text, '')"
    for pattern, put in ((_VERSION, "\\1v.\\2"), (_COMPANY, "\\1\\2"), (_RIGHTS, "\\1 \\2")):
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {quoted}),
parts AS (
  SELECT * FROM (
    SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS part
    FROM (SELECT doc_id, string_split_regex({text}, '{_END}') AS s FROM documents)
  ) WHERE regexp_matches(part, '[^ \\t\\r\\n]')
),
whole AS (SELECT p.*, k.id FROM parts p LEFT JOIN known k ON k.sentence = {key('p.part')}),
below AS (
  SELECT w.doc_id, w.pos, w.part, f.id AS first, r.id AS rest
  FROM whole w LEFT JOIN known f ON f.sentence = {key("split_part(w.part, chr(10), 1)")}
  LEFT JOIN known r ON r.sentence = {key("substr(w.part, instr(w.part, chr(10)) + 1)")}
  WHERE w.id IS NULL AND contains(w.part, chr(10))
),
single AS (SELECT doc_id, pos, generate_subscripts(l, 1) AS sub, unnest(l) AS line FROM (SELECT doc_id, pos, string_split(part, chr(10)) AS l FROM below WHERE rest IS NULL)),
named_parts AS (
  SELECT doc_id, pos, 0 AS sub, id FROM whole WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, pos, 0, first FROM below WHERE rest IS NOT NULL AND first IS NOT NULL
  UNION ALL SELECT doc_id, pos, 1, rest FROM below WHERE rest IS NOT NULL
  UNION ALL SELECT s.doc_id, s.pos, s.sub, k.id FROM single s JOIN known k ON k.sentence = {key('s.line')}
),
found AS (
  SELECT doc_id, count(*) AS n_known, string_agg(id, ',' ORDER BY pos, sub) AS sentence_ids, concat(',', string_agg(id, ',,' ORDER BY pos, sub), ',') AS seq FROM named_parts GROUP BY doc_id
),
ids AS (SELECT p.doc_id, p.n_sentences, coalesce(f.n_known, 0) AS n_known, f.sentence_ids, f.seq FROM (SELECT doc_id, count(*) AS n_sentences FROM parts GROUP BY doc_id) p LEFT JOIN found f ON f.doc_id = p.doc_id),
hits AS (SELECT doc_id, {', '.join(cases)} FROM ids WHERE n_known > 0),
named AS (
  SELECT doc_id, name, min(k) AS k FROM (SELECT h.doc_id, v.k, v.name FROM hits h, LATERAL (VALUES {order}) v(k, name)) WHERE name IS NOT NULL GROUP BY doc_id, name
),
joined AS (SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY k) FILTER (WHERE name <> '{_LAST}'), '{_LAST}') AS licences FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.n_sentences, 0) AS n_sentences, coalesce(i.n_known, 0) AS n_known, coalesce(i.sentence_ids, '') AS sentence_ids, coalesce(j.licences, '') AS licences
FROM documents d LEFT JOIN ids i USING (doc_id) LEFT JOIN joined j USING (doc_id)
"""
