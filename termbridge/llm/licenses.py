"""Licences named in texts, recognised by sentence rules.

A text is normalised to words, with a mark at each sentence end, table cell, tag and line end. Known licence
sentences are looked up from mark to mark, over marks inside them, the longest first and none over another. The
sequence of identifiers found is matched against ordered rules: a rule takes neighbouring
identifiers out of the sequence and leaves a gap, over which no rule reaches, so a part of a longer licence text is
not counted again. What no rule takes is reported as it is. Both tables are arguments.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col

# Identifiers of licence sentences with their public wording.
SENTENCES = {
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-apache-2.0": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-gpl-3.0": ["SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "spdx-bsd-3-clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "name-mit": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "name-apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License")', "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"],
    "name-gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License, version 3",
    ],
    "name-gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
    ],
    "name-cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "name-cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "name-cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "apache-limits": ["you may not use this file except in compliance with the License"],
    "apache-where": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "public-domain": ["This is free and unencumbered software released into the public domain"],
}

# Licence and the sentence sequences that state it, longest first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["name-apache-2.0", "apache-limits", "apache-where"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("Apache-2.0", ["name-apache-2.0"]),
    ("Apache-2.0", ["spdx-apache-2.0"]),
    ("MIT", ["name-mit"]),
    ("MIT", ["spdx-mit"]),
    ("GPL-3.0", ["name-gpl-3.0"]),
    ("GPL-3.0", ["spdx-gpl-3.0"]),
    ("GPL-2.0", ["name-gpl-2.0"]),
    ("BSD-3-Clause", ["spdx-bsd-3-clause"]),
    ("CC-BY-NC-4.0", ["name-cc-by-nc-4.0"]),
    ("CC-BY-4.0", ["name-cc-by-4.0"]),
    ("CC-BY-SA-4.0", ["name-cc-by-sa-4.0"]),
    ("Unlicense", ["public-domain"]),
]
# Licences by their public identifiers and names.
LICENCES = {
    "MIT": ["MIT License"],
    "MIT-0": ["MIT No Attribution License"],
    "X11": ["X11 License"],
    "Apache-1.1": ["Apache License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "CPL-1.0": ["Common Public License, Version 1.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License, Version 1.1"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "CC0-1.0": ["CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "AFL-3.0": ["Academic Free License 3.0"],
    "OSL-3.0": ["Open Software License 3.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EUPL-1.2": ["European Union Public Licence v1.2", "European Union Public License 1.2"],
    "UPL-1.0": ["Universal Permissive License, Version 1.0"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "ODbL-1.0": ["Open Database License 1.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "Unlicense": ["Unlicense"],
}
# How a text names its licence.
STATED = [
    "Licensed under the {}",
    "Released under the {}",
    "Distributed under the {}",
    "This project is licensed under the {}",
    "This work is licensed under the {}",
    "This software is licensed under the {}",
]


def stated_sentences(licences: dict[str, list[str]]) -> tuple[dict[str, list[str]], list[tuple[str, list[str]]]]:
    """Sentences and rules of licences named in a line or by an SPDX tag."""
    sentences, rules = {}, []
    for key, names in licences.items():
        low = key.lower()
        sentences[f"name-{low}"] = [form.format(name) for name in names for form in STATED]
        gnu = [f"{key}-only", f"{key}-or-later"] if "GPL" in key or "GFDL" in key else []
        sentences[f"spdx-{low}"] = [f"SPDX-License-Identifier: {x}" for x in [key, *gnu]]
        rules += [(key, [f"name-{low}"]), (key, [f"spdx-{low}"])]
    return sentences, rules


for _name, _wordings in stated_sentences(LICENCES)[0].items():
    SENTENCES[_name] = list(dict.fromkeys([*SENTENCES.get(_name, []), *_wordings]))
RULES += [r for r in stated_sentences(LICENCES)[1] if r[1] not in [seq for _, seq in RULES]]
ENDS = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"  # between sentences
LINES = r"\R"
TAGS = r"<[/!]?[a-z][^<>]*>"
INSIDE = r"[ \n]"  # between the words of a known sentence: it may be wrapped, and hold ": " and "; "


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Normalised wordings with their identifiers; of equal wordings the first stays."""
    out: dict[str, str] = {}
    for name, wordings in sentences.items():
        for x in wordings:
            out.setdefault(normal(x), name)
    return out


def marked(names: list[str]) -> str:
    """A sequence of identifiers in the text form in which rules look for it."""
    return "".join(f",{n}," for n in names)


def sentence_ids(text: Column, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    wordings = known(sentences)
    marked_ends = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"{TAGS}|{ENDS}|{LINES}|\|", "\n")
    words = F.concat(F.lit("\n"), F.regexp_replace(marked_ends, "[^a-z0-9\n]+", " "), F.lit("\n"))
    words = F.regexp_replace(words, r" ?\n[ \n]*", "\n")
    longest = [x.replace(" ", INSIDE) for x in sorted(wordings, key=len, reverse=True)]
    found = F.regexp_extract_all(words, F.lit(rf"(?<=\n)(?:{'|'.join(longest)})(?=\n)"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in wordings.items() for x in pair])
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, "\n", " ")))


def matched(ids: Column, rules=RULES) -> Column:
    """(rest, licences): rules take their identifiers out one after the other, a gap stays."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(marked(seq)).alias("seq")) for name, seq in rules])
    start = F.struct(
        F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(","))), "").alias("rest"),
        F.array().cast("array<string>").alias("licences"),
    )

    def step(state: Column, rule: Column) -> Column:
        fits = F.contains(state["rest"], rule["seq"])
        taken = F.struct(
            F.replace(state["rest"], rule["seq"], F.lit("/")).alias("rest"),
            F.array_union(state["licences"], F.array(rule["name"])).alias("licences"),
        )
        return F.when(fits, taken).otherwise(state)

    return F.when(F.size(ids) == 0, start).otherwise(F.aggregate(table, start, step))


def find_licences(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules=RULES
) -> DataFrame:
    """Per row: doc_id, n_sentences (known ones), sentence_ids, licences (in the order of the rules), unmatched.

    The last three are texts, empty where nothing was found, as for null and empty texts. Rows may repeat or
    lack a doc_id. An empty table gives no rows. Other columns are not read. One pass without a shuffle.
    """
    found = documents.select(col(doc_id).alias("doc_id"), sentence_ids(col(text), sentences).alias("ids"))
    found = found.withColumn("state", matched(col("ids"), rules))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("state.licences", " AND ").alias("licences"),
        F.trim(F.regexp_replace("state.rest", "[,/]+", " ")).alias("unmatched"),
    )


def _sql(sentences: dict[str, list[str]], rules: list[tuple[str, list[str]]]) -> str:
    """From the specification: segments between marks, a wording that fills whole segments, from the left.

    Rules of several identifiers take them out of the sequence first; no rule of one identifier
    comes before one of several that holds it.
    """
    text = lambda x: "'" + x.replace("'", "''") + "'"
    table = lambda rows: ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    wordings = table((text(k), text(v)) for k, v in known(sentences).items())
    single = [(text(seq[0]), n, text(name)) for n, (name, seq) in enumerate(rules) if len(seq) == 1]
    steps, last = [], "sequences"
    for n, (name, seq) in enumerate(rules):
        if len(seq) > 1:
            if any(s[1] < n and s[0] in map(text, seq) for s in single):
                raise ValueError(f"a rule of one identifier comes before {name}")
            steps.append(
                f"m{n} AS (SELECT row, replace(rest, {text(marked(seq))}, '/') AS rest,"
                f" CASE WHEN contains(rest, {text(marked(seq))}) THEN list_append(fired, {n}) ELSE fired END AS fired FROM {last})"
            )
            last = f"m{n}"
    names = table((n, text(name)) for n, (name, _) in enumerate(rules))
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, lower(coalesce(text, '')) AS text FROM documents),
known(sentence, id) AS (VALUES {wordings}),
rules(n, licence) AS (VALUES {names}),
singles(id, n, licence) AS (VALUES {table(single)}),
pieces AS (
  SELECT row, unnest(p) AS piece, generate_subscripts(p, 1) AS place FROM (
    SELECT row, string_split_regex(text, '<[/!]?[a-z][^<>]*>|[.!?;:]+[\x20\x09-\x0D]+|[\x0A-\x0D\x{{85}}\x{{2028}}\x{{2029}}]|[|]') AS p
    FROM docs)),
segments AS (
  SELECT row, place, trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g')) AS words FROM pieces
  WHERE regexp_matches(piece, '[a-z0-9]')),
ends AS (SELECT row, place, words, sum(length(words) + 1) OVER (PARTITION BY row ORDER BY place) AS past FROM segments),
placed AS (SELECT row, words, past, past - length(words) AS start FROM ends),
joined AS (SELECT row, string_agg(words, ' ' ORDER BY place) AS words FROM segments GROUP BY row),
hits AS (
  SELECT s.row, s.start, e.past, k.id
  FROM placed s JOIN known k ON starts_with(k.sentence || ' ', s.words || ' ')
  JOIN joined j ON j.row = s.row AND substr(j.words, s.start::BIGINT, length(k.sentence)) = k.sentence
  JOIN placed e ON e.row = s.row AND e.past = s.start + length(k.sentence)),
longest AS (SELECT row, start, max(past) AS past, arg_max(id, past) AS id FROM hits GROUP BY row, start),
following AS (
  SELECT a.row, a.start, a.past, a.id, min(b.start) AS next FROM longest a LEFT JOIN longest b ON b.row = a.row AND b.start > a.past
  GROUP BY a.row, a.start, a.past, a.id),
chosen AS (
  SELECT f.* FROM following f JOIN (SELECT row, min(start) AS start FROM longest GROUP BY row) USING (row, start)
  UNION ALL
  SELECT f.* FROM chosen c JOIN following f ON f.row = c.row AND f.start = c.next),
sequences AS (
  SELECT row, string_agg(',' || id || ',', '' ORDER BY start) AS rest, []::INTEGER[] AS fired FROM chosen GROUP BY row),
{", ".join(steps)},
left_over AS (
  SELECT row, id, place, n FROM (
    SELECT row, unnest(w) AS id, generate_subscripts(w, 1) AS place FROM (SELECT row, regexp_extract_all(rest, '[^,/]+') AS w FROM {last}))
  LEFT JOIN singles USING (id)),
fired AS (
  SELECT row, licence, min(n) AS n
  FROM (SELECT row, unnest(fired) AS n FROM {last} UNION ALL SELECT row, n FROM left_over WHERE n IS NOT NULL) JOIN rules USING (n)
  GROUP BY row, licence),
said AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY start) AS ids FROM chosen GROUP BY row),
named AS (SELECT row, string_agg(licence, ' AND ' ORDER BY n) AS licences FROM fired GROUP BY row),
others AS (SELECT row, string_agg(id, ' ' ORDER BY place) AS unmatched FROM left_over WHERE n IS NULL GROUP BY row)
SELECT doc_id, coalesce(said.n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(licences, '') AS licences, coalesce(unmatched, '') AS unmatched
FROM docs LEFT JOIN said USING (row) LEFT JOIN named USING (row) LEFT JOIN others USING (row)"""


SQL = _sql(SENTENCES, RULES)
