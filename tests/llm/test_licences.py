from __future__ import annotations

import re
import textwrap

import pytest

from codelens.llm import licences

S = licences.SENTENCES


def text_of(*names, mark=". "):
    return mark.join(S[name] for name in names) + "."


MIT = ["mit_grant", "mit_notice_kept", "mit_as_is", "mit_liability"]
BSD3 = ["bsd_conditions", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is"]
WRAPPED = re.sub(r"(.{50,70}?) ", "\\1\n", text_of(*MIT, mark=".\n\n"))
CASES = [
    (1, text_of(*MIT), [("MIT", "full text", 0, 3)]),
    (2, "MIT License\n\nCopyright (c) 2020 Someone.\n\n" + text_of(*MIT), [("MIT", "titled text", 0, 5)]),
    (3, WRAPPED, [("MIT", "full text", None, None)]),
    (4, "Intro words.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", [("MIT", "released notice", 1, 1), ("CC-BY-NC-4.0", "notice", 2, 2)]),
    (5, text_of(*BSD3, mark=".\n1. "), [("BSD-3-Clause", "full text", 0, 8)]),
    (6, text_of(*reversed(MIT)), []),
    (7, text_of("mit_grant", "mit_notice_kept") + " One. Two. Three. Four. " + text_of("mit_as_is", "mit_liability"), []),
    (8, None, []),
    (9, "", []),
    (10, "We were released under the MIT License long ago.", []),
    (11, text_of("apache_licensed", "apache_compliance", "apache_obtain", "apache_basis", "apache_see", mark=";\n"), [("Apache-2.0", "file header", 0, 4)]),
    (12, "Ünïcode ÉÀ.\n\n\n  - LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", [("Apache-2.0", "notice", 1, 1)]),
    (None, "Licensed under CC BY 4.0. " * 3, [("CC-BY-4.0", "notice", n, n) for n in range(3)]),
    (13, "filler words here. " * 20_000 + "Licensed under the MIT License!", [("MIT", "licensed notice", 20_000, 20_000)]),
    (14, text_of("gpl_free", "gpl2_modify", "gpl_hope", "gpl_implied", "gpl_see", mark="; "), [("GPL-2.0-or-later", "file header", 0, 5)]),
    (15, "Released under the MIT License.", [("MIT", "released notice", 0, 0)]),
    (15, "Released under the MIT License.", [("MIT", "released notice", 0, 0)]),
]


def test_matches(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in CASES], "doc_id long, text string, rid int, at string").repartition(3)
    got = [tuple(r) for r in licences.licence_matches(docs).collect()]
    places = sorted(((r[0], *r[1:3], *(r[3:5] if r[0] != 3 else (None, None))) for r in got), key=repr)
    assert places == sorted(((i, *match) for i, _, matches in CASES for match in matches), key=repr)


def test_empty_table(spark):
    assert licences.licence_matches(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["\n" * 200_000 + "a", "\n" + " " * 200_000 + "a", ". " * 100_000, "x" * 300_000])
def test_hostile_texts_take_linear_time(spark, text):
    docs = spark.createDataFrame([(1, text + "\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    assert [r.licence for r in licences.licence_matches(docs).collect()] == ["CC-BY-4.0"]


def test_no_python_in_the_plan(spark, capsys):
    licences.licence_matches(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def comment(text, leader, width=70):
    return "\n".join(leader + line for line in textwrap.wrap(text, width))


GPL = S["gpl_free"] + ": " + S["gpl3_modify"] + ". " + S["gpl_hope"] + "; " + text_of("gpl_implied", "gpl_see")
COMMENTS = [
    ("/*\n" + comment(text_of(*MIT), " * ") + "\n */\nint main() {}", ["MIT full text"]),
    ("/*\n" + comment(text_of(*MIT), " * ", 20) + "\n */", ["MIT full text"]),
    (comment(text_of(*BSD3), "# "), ["BSD-3-Clause full text"]),
    ("\r\n".join(comment(text_of("isc_grant", "isc_as_is"), "// ", 40).split("\n")), ["ISC full text"]),
    (comment(GPL, "-- ", 60), ["GPL-3.0-or-later file header"]),
    (comment(GPL, "* ", 20), ["GPL-3.0-or-later file header"]),
    ("Released under the MIT License\nall rights reserved\n", ["MIT released notice"]),
    ("Released under the MIT License\nCOPYRIGHT SOMEONE", ["MIT released notice"]),
    ("see below\nreleased under the\nMIT License\n\u00c9t\u00e9", ["MIT released notice"]),
    ("Licensed under CC BY 4.0\nlicensed under cc by-sa 4.0\nx", ["CC-BY-4.0 notice", "CC-BY-SA-4.0 notice"]),
    ("it was released under the MIT License\nlong ago", []),
    ("Released under the MIT License of\nsome kind", []),
]


def test_comments_and_plain_line_breaks(spark):
    docs = spark.createDataFrame([(at, text) for at, (text, _) in enumerate(COMMENTS)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, f"{r.licence} {r.rule}") for r in licences.licence_matches(docs).collect())
    assert got == sorted((at, name) for at, (_, names) in enumerate(COMMENTS) for name in names)


HEADERS = [
    ("MPL-2.0", """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""),
    ("LGPL-2.1-or-later", """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details."""),
    ("AGPL-3.0-or-later", """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU Affero General Public License for more details."""),
    ("Apache-2.0", """# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Some Company Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;"),
    ("GPL-2.0-or-later", "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\n"),
    ("Zlib", """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""),
    ("CC0-1.0", "To the extent possible under law, Jane Doe\nhas waived all copyright and related or neighboring rights to this work."),
]


def test_usual_headers(spark):
    docs = spark.createDataFrame([(at, text) for at, (_, text) in enumerate(HEADERS)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.licence) for r in licences.licence_matches(docs).collect())
    assert got == [(at, name) for at, (name, _) in enumerate(HEADERS)]
    assert len({name for name, _, _ in licences.RULES}) >= 30


def test_own_sentences_and_rules(spark):
    sentences = spark.createDataFrame([("a", "Made by {} for you"), ("b", "All is free"), ("c", ""), ("d", None)], "id string, text string")
    rules = spark.createDataFrame([("Own", "both", ["a", "b"]), ("Own", "free", ["b"])], "licence string, rule string, ids array<string>")
    texts = ["Made by Jane and\nJohn for you.\nAll is free.", "all is FREE", "Made by for you. All is free", "made by " + "x " * 13 + "for you. All is free", "MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.rule) for r in licences.licence_matches(docs, sentences, rules).collect())
    assert got == [(0, "both"), (1, "free"), (2, "both"), (3, "free")]
    assert licences.licence_matches(docs, sentences.limit(0), rules).collect() == []
    many = spark.range(licences.MAX_SENTENCES + 1).selectExpr("cast(id AS string) AS id", "'x' AS text")
    with pytest.raises(ValueError):
        licences.licence_matches(docs, many, rules)


def test_sql_agrees_on_wrapped_notices(spark):
    import duckdb

    import compare
    from codelens.llm import oracle

    texts = [text for _, text in HEADERS] + [text for text, _ in COMMENTS] + [text for _, text, _ in CASES if text is None or len(text) < 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert compare.difference(licences.licence_matches(docs), connection, oracle.build()["op9_licence_rules"]) is None
