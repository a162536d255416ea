from collections import Counter

from counterbook.llm import licence_rules as L
from counterbook.llm import queries
from counterbook.plans.compare import compare, duckdb_connection
from tests.llm.conftest import SF


def test_query_matches_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        ok, why = compare(queries.QUERIES["op5_licence_rules"](spark, sf), duckdb_connection(sf), queries.ORACLE["op5_licence_rules"])
        assert ok, why


def test_sentences_are_told_apart():
    assert len({L._plain(t) for t in L.SENTENCES.values()}) == len(L.SENTENCES)
    assert all(s in L.SENTENCES for _, ids in L.RULES.values() for s in ids)


def test_whole_texts_in_order(spark):
    say = lambda rule, sep: sep.join(L.SENTENCES[s] for s in L.RULES[rule][1])
    wrapped = L.SENTENCES["mit-grant"].replace("copy of this", "copy\nof this") + ":\n\n" + L.SENTENCES["mit-notice"].replace("all copies", "all\ncopies") + "."
    docs = spark.createDataFrame([
        (1, say("bsd-3-clause", ". ")), (2, say("apache-header", ".\n") + "."), (3, wrapped), (4, say("gpl3-header", ". ").upper()),
        (5, L.SENTENCES["bsd-binary"] + ". " + L.SENTENCES["bsd-grant"]), (6, "All rights reserved. Released under the MIT License. Released under the MIT License."),
    ], "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.rules, r.licences) for r in L.licence_scan(docs).collect()}
    assert got[1] == (5, ["bsd-3-clause"], ["BSD-3-Clause"])
    assert got[2] == (5, ["apache-header"], ["Apache-2.0"])
    assert got[3] == (2, ["mit-short-text"], ["MIT"])
    assert got[4] == (3, ["gpl3-header"], ["GPL-3.0-or-later"])
    assert got[5] == (2, [], [])  # known sentences in no rule's order
    assert got[6] == (3, ["mit-mention", "mit-reserved"], ["MIT"])


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License
Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED."""


def test_headers_in_comments_and_indented(spark):
    marks = {"none": ("", "", ""), "hash": ("# ", "", ""), "star": (" * ", "/*\n", "\n */"), "slashes": ("// ", "", ""), "indent": ("    ", "", ""), "tab": ("\t", "", "")}
    want = {"APACHE": (5, ["apache-header"], ["Apache-2.0"]), "MIT": (5, ["mit-titled"], ["MIT"]), "GPL": (4, ["gpl3-header"], ["GPL-3.0-or-later"]), "BSD": (4, ["bsd-2-clause"], ["BSD-2-Clause"])}
    rows = []
    for name in want:
        for style, (mark, head, tail) in marks.items():
            for end in ("\n", "\r\n"):
                body = "\n".join((mark + line).rstrip() for line in globals()[name].split("\n"))
                rows.append((f"{name} {style} {len(end)}", (head + body + tail + "\nimport os\n").replace("\n", end)))
    got = {r.doc_id: (r.n_known, r.rules, r.licences) for r in L.licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {k: want[k.split()[0]] for k, _ in rows}


def test_lines_without_a_full_stop_and_sentences_inside_others(spark):
    docs = spark.createDataFrame([
        (1, "All rights reserved\nReleased under the MIT License\nMIT License\nfoo"), (2, "This project is\nlicensed under the MIT License"),
        (3, "See\nthe GNU General Public License\n\nfor more details"), (4, "MIT License\n" * 3000),
    ], "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.rules) for r in L.licence_scan(docs).collect()}
    assert got == {1: (3, ["mit-reserved"]), 2: (1, ["mit-mention-project"]), 3: (0, []), 4: (3000, [])}


def test_odd_rows(odd, odd_rows):
    rows = L.licence_scan(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
    assert all(r.n_known == 0 and r.rules == [] for r in rows)
    assert L.licence_scan(odd.limit(0)).count() == 0
