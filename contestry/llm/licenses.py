"""Licence scans by sentence rules.

A text is cut into sentences, every sentence is normalised and looked up among known licence sentences.
Runs of known sentences are matched, in order, against rules: sequences of sentence identifiers. At every
place the first fitting rule of the ordered list wins, and matching goes on behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from contestry.llm.common import as_bytes, query, slices, table

#: Known sentences: identifier and wording. Fixed values.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-you": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-l": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-l": "Licensed under the GNU General Public License, version 3",
    "gpl2-notice-l": "Licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-w": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-w": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl3-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Ordered rules: licence and sequence of sentences; the longer of a family stand first. Fixed values.
RULES = (
    ("Apache-2.0", ("apache-notice-you", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-notice-you", "apache-use")),
    ("Apache-2.0", ("apache-notice-you",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-l",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-notice-l",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0", ("gpl2-notice-l",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-w",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-w",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-3.0-or-later", ("spdx-gpl3-later",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("All-rights-reserved", ("reserved",)),
)
#: Every known sentence has one of these; texts without any cannot match.
HINTS = ("licen", "permission", "redistribut", "copyright", "reserved", "as is", "warrant", "free software", "public domain")
#: A sentence ends at a full stop, question or exclamation mark before white space (not after a lone v), at a
#: blank line, or at a line's end before a list mark; other line ends are spaces.
ENDS = re.compile(r"(?:(?<!\bv)(?<![.?!])[.?!]+[\s\"')\]]+|(?<![.?!])[.?!]+$|\n[\s*#/;-]*\n|\n(?=[\s*#/;-]*(?:\d+\.|[-*•]|\(?[a-z]\))\s))")
LIST_MARK = re.compile(r"^[\s*#/;-]*(?:\d+\.|[-*•]|\(?[a-z]\))\s+")
MARKS = re.compile(r"[^a-z0-9.+-]+")


def normalised(sentence: str) -> str:
    """Lower case, without list and comment marks and punctuation, single spaces."""
    return MARKS.sub(" ", LIST_MARK.sub("", sentence.lower())).strip(" .-")


KNOWN = {normalised(text): name for name, text in SENTENCES.items()}


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every sentence."""
    start = 0
    for end in ENDS.finditer(text):
        yield start, end.start()
        start = end.end()
    yield start, len(text)


def _lookup(text: str, start: int, end: int) -> list[tuple[int, int, str | None]]:
    """The sentence with its identifier; an unknown one of several lines is looked up line by line, since
    notices often have a line of their own and no full stop around them."""
    whole = KNOWN.get(normalised(text[start:end]))
    if whole or "\n" not in text[start:end]:
        return [(start, end, whole)]
    lines = [(start + x.start(), start + x.end()) for x in re.finditer(r"[^\n]+", text[start:end])]
    return [(s, e, KNOWN.get(normalised(text[s:e]))) for s, e in lines]


def scan(text: str) -> tuple[list[str], list[str], list[int], list[int]]:
    """(sentence ids, licences, starts, ends) of one text; spans are code points, in order."""
    lower = text.lower()
    if not any(h in lower for h in HINTS):
        return [], [], [], []
    runs: list[list[tuple[int, int, str]]] = [[]]
    for start, end in sentences(text):
        for s, e, name in _lookup(text, start, end):
            if name:
                runs[-1].append((s, e, name))
            elif normalised(text[s:e]) and runs[-1]:
                runs.append([])
    ids, found, starts, ends = [], [], [], []
    for run in runs:
        names = tuple(n for _, _, n in run)
        ids += names
        at = 0
        while at < len(run):
            for licence, rule in RULES:
                if names[at:at + len(rule)] == rule:
                    found.append(licence)
                    starts.append(run[at][0])
                    ends.append(run[at + len(rule) - 1][1])
                    at += len(rule)
                    break
            else:
                at += 1
    return ids, found, starts, ends


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "sentence_ids", "licences", "starts", "ends"]
    for batch in slices(batches, 1000):
        rows = list(zip(*(scan(t.decode()) for t in as_bytes(batch.column(1))))) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(rows, kinds))], names=names)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences, starts, ends), a row per row of ``docs``.

    Null and empty texts, and texts without a known sentence, have empty lists. Rows are scanned one by one:
    repeated rows and equal or null ids get equal lists. Texts of any length are scanned whole; an empty table
    gives no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, sentence_ids array<string>, licences array<string>, starts array<long>, ends array<long>")


@query("op9_licences", r"""WITH l AS (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(coalesce(text, ''), chr(10)))), '[^a-z0-9.+-]+', ' ', 'g'), ' .-') AS s FROM documents),
k AS (SELECT doc_id, CASE s WHEN 'licensed under cc by-nc 4.0' THEN 'CC-BY-NC-4.0' WHEN 'licensed under the apache license version 2.0' THEN 'Apache-2.0'
    WHEN 'this work is licensed under the gnu general public license version 3' THEN 'GPL-3.0' WHEN 'released under the mit license' THEN 'MIT'
    WHEN 'all rights reserved' THEN 'All-rights-reserved' END AS licence FROM l),
n AS (SELECT doc_id, licence, count(*) AS n FROM k WHERE licence IS NOT NULL GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(licence, ',' ORDER BY licence), '') AS licences, coalesce(sum(n), 0)::BIGINT AS n_notices
FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"), F.size("licences").cast("long").alias("n_notices"))
