r"""Operator 5: licence scan by known sentences and ordered rules.

A text is cut at sentence ends, and the lines of each piece are normalised (A-Z lower-cased, everything but ASCII
letters and digits one blank, so comment marks and indents go). Lines that follow one another, one or several, are
looked up among known licence sentences; no sentence goes over a line without a letter or digit, and one inside
a longer one is dropped. The identifiers a document has, in order, are matched against licence rules: a rule holds where its
identifiers follow one another in that sequence. A match inside a longer one is
dropped. Only DataFrame functions are used.

Scale. The known sentences and the rules are fixed tables of this module (under 200 rows), so broadcasting them is bounded. Only known
sentences leave their map task.

Defined results: a null or empty text has no sentence; a text of any length is read whole; rows with the same id
and text are one document and each gets the result; a sentence that occurs twice counts twice; a null id is a
document like others; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-title": "MIT License",
    "mit-the-title": "The MIT License",
    "mit-mention": "Released under the MIT License",
    "mit-mention-licensed": "Licensed under the MIT License",
    "mit-mention-project": "This project is licensed under the MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-mention": "Licensed under the BSD License",
    "apache-mention": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "gpl3-mention": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-mention-licensed": "Licensed under the GNU General Public License v3.0",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-mention": "Licensed under the GNU Affero General Public License v3.0",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-public": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "All rights reserved",
}

# Rule -> (licence, identifiers in order).
RULES = {
    "mit-text": ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    "mit-titled": ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    "mit-short-text": ("MIT", ["mit-grant", "mit-notice"]),
    "mit-mention": ("MIT", ["mit-mention"]),
    "mit-mention-licensed": ("MIT", ["mit-mention-licensed"]),
    "mit-mention-project": ("MIT", ["mit-mention-project"]),
    "mit-spdx": ("MIT", ["mit-spdx"]),
    "apache-spdx": ("Apache-2.0", ["apache-spdx"]),
    "mit-reference": ("MIT", ["mit-the-title"]),
    "bsd-2-clause": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    "bsd-3-clause": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    "bsd-mention": ("BSD", ["bsd-mention"]),
    "apache-header": ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-as-is", "apache-see"]),
    "apache-short-header": ("Apache-2.0", ["apache-copy", "apache-as-is", "apache-see"]),
    "apache-mention": ("Apache-2.0", ["apache-mention"]),
    "gpl3-header": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    "gpl2-header": ("GPL-2.0-or-later", ["gpl-free-2", "gpl-hope", "gpl-details"]),
    "gpl3-mention": ("GPL-3.0", ["gpl3-mention"]),
    "gpl3-mention-licensed": ("GPL-3.0", ["gpl3-mention-licensed"]),
    "lgpl-reference": ("LGPL", ["gpl-hope", "lgpl-details"]),
    "agpl-mention": ("AGPL-3.0", ["agpl-mention"]),
    "mpl-header": ("MPL-2.0", ["mpl-subject", "mpl-copy"]),
    "isc-text": ("ISC", ["isc-grant"]),
    "unlicense-text": ("Unlicense", ["unlicense-public", "unlicense-anyone"]),
    "cc-by": ("CC-BY-4.0", ["cc-by"]),
    "cc-by-short": ("CC-BY-4.0", ["cc-by-short"]),
    "cc-by-sa-short": ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    "cc-by-nc-short": ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    "cc0": ("CC0-1.0", ["cc0"]),
    "reserved": ("proprietary", ["reserved"]),
    "mit-reserved": ("MIT", ["reserved", "mit-mention"]),
}

#: Of the oracle: a single line break inside a sentence, between small letters, or between capitals.
WRAPPED = r"""([a-z,])\r?\n([a-z("])|([A-Z,])\r?\n([A-Z("])"""
#: Where a sentence ends; of the oracle, every line break that is not WRAPPED too.
SENTENCE_END = r"[.!?]+[ \t\r\n]+"
BORDER = r"[.!?]+[ \t\r\n]+|\n+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, AZ, AZ.lower()), "[^a-z0-9]+", " "))


def fixed_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(sentence, identifier), (rule, step, identifier, steps) and the normalised sentences. A known sentence with a border inside (an
    abbreviation's) is known by what stands before the border."""
    plain = {name: _plain(text) for name, text in SENTENCES.items()}
    known = spark.createDataFrame(sorted((t, n) for n, t in plain.items()), "sentence string, known string")
    steps = [(r, k, s, len(ids)) for r, (_, ids) in RULES.items() for k, s in enumerate(ids)]
    return known, spark.createDataFrame(steps, "rule string, step int, known string, steps int"), plain


def _plain(text: str) -> str:
    import re

    first = re.split(BORDER, text)[0]
    return re.sub("[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in first)).strip()


def known_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, place, known): the known sentences of each document, numbered from 0 in order."""
    known, _, plain = fixed_tables(docs.sparkSession)
    sentences = sorted(plain.values())
    most, longest = max(len(t.split()) for t in sentences), max(map(len, sentences))
    # a sentence starts at a line with its first two words, or with nothing but the first
    starts = "^(?:" + "|".join(sorted({" ".join(t.split()[:2]) for t in sentences})) + ")(?: |$)|^(?:" + "|".join(sorted({t.split()[0] for t in sentences})) + ")$"
    cut = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.split(docs[text_col], SENTENCE_END).alias("pieces"))
    pieces = cut.select("id", "th", F.posexplode("pieces").alias("pos", "raw"))
    lines = pieces.select("id", "th", "pos", F.transform(F.split("raw", "\n"), lambda x: F.substring(normalised(x), 1, longest + 1)).alias("lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("lines", i - 1).rlike(starts))
    to = lambda i, j: F.struct(i.alias("start"), j.alias("end"), F.array_join(F.slice("lines", i, j - i + 1), " ").alias("sentence"))
    held = lambda i: F.filter(F.transform(F.sequence(i, F.least(i + (most - 1), F.size("lines"))), lambda j: to(i, j)), lambda x: x["sentence"].isin(sentences))
    found = lines.where(F.exists("lines", lambda x: x.rlike(starts))).select("id", "th", "pos", F.explode(F.flatten(F.transform(at, held))).alias("x"))
    hits = found.select("id", "th", "pos", "x.start", "x.end", "x.sentence").join(F.broadcast(known), "sentence").drop("sentence").distinct()
    order = Window.partitionBy("id", "th").orderBy("pos", "start", F.desc("end"))
    reach = F.max(F.struct("pos", "end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = hits.withColumn("reach", reach).where("reach is null or reach < struct(pos, end)")
    return outer.select("id", "th", (F.row_number().over(Window.partitionBy("id", "th").orderBy("pos", "start")) - 1).alias("place"), "known")


def rule_matches(known: DataFrame) -> DataFrame:
    """(id, th, rule, start, steps): where a rule's identifiers follow one another, matches inside a longer match left out."""
    _, steps, _ = fixed_tables(known.sparkSession)
    at = known.join(F.broadcast(steps), "known").select("id", "th", "rule", "steps", (F.col("place") - F.col("step")).alias("start"), "step")
    whole = at.groupBy("id", "th", "rule", "steps", "start").agg(F.count_distinct("step").alias("n")).where("n = steps").drop("n")
    by_doc = whole.groupBy("id", "th").agg(F.collect_list(F.struct("rule", "start", "steps")).alias("all"))
    inside = lambda m, o: (o["steps"] > m["steps"]) & (o["start"] <= m["start"]) & (o["start"] + o["steps"] >= m["start"] + m["steps"])
    outer = F.filter("all", lambda m: ~F.exists("all", lambda o: inside(m, o)))
    return by_doc.select("id", "th", F.explode(outer).alias("m")).select("id", "th", "m.rule", "m.start", "m.steps")


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_known (known sentences), rules and licences (sorted arrays)."""
    known = known_sentences(docs, id_col, text_col)
    licences = docs.sparkSession.createDataFrame([(r, x) for r, (x, _) in RULES.items()], "rule string, licence string")
    matches = rule_matches(known).join(F.broadcast(licences), "rule")
    counts = known.groupBy("id", "th").agg(F.count("*").alias("n_known"))
    named = matches.groupBy("id", "th").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_set("licence")).alias("licences"))
    found = counts.join(named.select(F.col("id").alias("i"), F.col("th").alias("h"), "rules", "licences"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left")
    base = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"))
    none = F.array().cast("array<string>")
    out = base.join(found, F.col("k").eqNullSafe(F.col("id")) & (F.col("kh") == F.col("th")), "left")
    return out.select(F.col("k").alias(id_col), F.coalesce("n_known", F.lit(0).cast("long")).alias("n_known"), F.coalesce("rules", none).alias("rules"), F.coalesce("licences", none).alias("licences"))


def oracle_sql(table: str = "documents") -> str:
    """DuckDB SQL of the driver's query: sentences, sequence and rules by string functions and joins."""
    known = ", ".join(f"('{_plain(t)}', '{n}')" for n, t in SENTENCES.items())
    rules = ", ".join(f"('{r}', '{x}', {k}, '{s}', {len(ids)})" for r, (x, ids) in RULES.items() for k, s in enumerate(ids))
    wrapped, border = WRAPPED.replace("'", "''"), BORDER.replace("'", "''")
    return rf"""
WITH known(sentence, known) AS (VALUES {known}),
rules(rule, licence, step, known, steps) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '{wrapped}', '\1\3 \2\4', 'g'), '{border}') AS s FROM {table}),
parts AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS raw FROM cut),
plain AS (SELECT doc_id, pos, trim(regexp_replace(translate(raw, '{AZ}', '{AZ.lower()}'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts),
hits AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, known FROM plain JOIN known USING (sentence)),
found AS (SELECT doc_id, rule, licence, steps, place - step AS start FROM hits JOIN rules USING (known)
          GROUP BY ALL HAVING count(DISTINCT step) = steps),
outermost AS (SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND b.steps > a.steps
              AND b.start <= a.start AND b.start + b.steps >= a.start + a.steps))
SELECT d.doc_id, coalesce(n.n_known, 0) AS n_known, coalesce(m.rules, '') AS rules, coalesce(m.licences, '') AS licences
FROM {table} d
LEFT JOIN (SELECT doc_id, count(*) AS n_known FROM hits GROUP BY 1) n USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
           FROM outermost GROUP BY 1) m USING (doc_id)"""
