from __future__ import annotations

import math
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import licenses as L


def best(text):
    """The licence and score of a text, by plain vectors."""
    counts = {k: Counter(re.findall(L.WORD, v.lower())) for k, v in L.TEMPLATES.items()}
    seen = Counter(w for c in counts.values() for w in c)
    idf = lambda w: math.log((1 + len(counts)) / (1 + seen[w])) + 1
    out = []
    for line in (text or "").split("\n"):
        own = {w: n * idf(w) for w, n in Counter(re.findall(L.WORD, line.lower())).items()}
        for name, c in counts.items():
            t = {w: n * idf(w) for w, n in c.items()}
            dot = sum(own[w] * t.get(w, 0) for w in own)
            if dot:
                out.append((-round(dot / math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in t.values())), 6), name))
    top = min(out, default=(0, None))
    return (top[1], -top[0]) if -top[0] >= L.MATCH else (None, None)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "x\nThis work is LICENSED under the GNU general public license, version 3\ny", "released under MIT license, 2020, by me and you and them all",
    "All rights reserved.", "the under to of this is by work version", "", None, "licensed", "a\nLicensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", "license " * 50_000,
]


def test_scores_are_those_of_plain_vectors(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: (r.license, r.score) for r in L.matches(rows, "id", "text").collect()}
    want = {i: best(t) for i, t in enumerate(TEXTS) if best(t)[0]}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in got)


def test_every_matching_line_has_a_telling_term():
    words = set(L.telling())
    for name, unit in L.weights()[0].items():
        assert math.sqrt(sum(x * x for w, x in unit.items() if w not in words)) < L.MATCH, name


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", TEXTS[1]
    files = [("LICENSE", mit), ("a/x.py", None), ("a/b/COPYING", gpl), ("a/b/c/d/y.py", ""), ("a/b/z.py", mit), ("w.py", "x"), (None, "x"), ("a/b/notice.txt", mit), ("a/x.py", None)]
    got = L.scan(spark.createDataFrame([(i, p, t, "c") for i, (p, t) in enumerate(files)], "id int, path string, text string, license string").drop("license"), "id").collect()
    assert {r.id: (r.license, r.inherited_from) for r in got} == {0: ("MIT", None), 1: ("MIT", ""), 2: ("GPL-3.0", None), 3: ("GPL-3.0", "a/b"), 4: ("MIT", None), 5: ("MIT", ""), 6: (None, None), 7: ("MIT", None), 8: ("MIT", "")}
    empty = spark.createDataFrame([], "id int, path string, text string")
    assert L.scan(empty, "id").count() == 0


def test_query(spark, sf_dir):
    from tessera.llm.queries import op2_licenses

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    own = {r.doc_id: best(r.text) for r in docs}
    path = {}
    for r in docs:
        inner = f"{r.lang}/{r.doc_id // 100}/" if r.doc_id % 10 else f"{r.lang}/" if r.doc_id % 100 else ""
        path[r.doc_id] = f"{r.source}/{inner}{r.doc_id}.txt"
    given = {}
    for i in sorted(path, key=path.get):
        if own[i][0]:
            given.setdefault(path[i].rpartition("/")[0], own[i][0])
    for r in op2_licenses(spark, sf_dir).collect():
        want, at = (own[r.doc_id][0], None), path[r.doc_id]
        while want[0] is None and "/" in at:
            at = at.rpartition("/")[0]
            want = (given.get(at), at if at in given else None)
        assert (r.path, r.own_license, r.license, r.inherited_from) == (path[r.doc_id], own[r.doc_id][0], *want)


GPL = """/*
 * Frob is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Frob is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/."""
APACHE = """// Copyright 2020 The Frob Authors. All rights reserved.
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License."""
CODE = "\n".join(f"def value{i}(x): return x + {i}  # the value of the work" for i in range(300))


def test_headers_and_full_texts(spark):
    """Each stands at some place between lines of code, wrapped in its own way."""
    full = lambda name, width: "Copyright (c) 2020, Me.\nAll rights reserved.\n\n" + textwrap.fill(" ".join(L.BLOCKS[name].split()), width)
    want, texts = [], []
    for name, text in [("GPL-3.0", GPL), ("GPL-2.0", GPL.replace("version 3", "version 2")), ("LGPL-3.0", GPL.replace("GNU", "GNU Lesser")), ("MPL-2.0", MPL), ("Apache-2.0", APACHE)]:
        want += [name] * 3
        texts += [text, f"{text}\n{CODE}", f"{CODE}\n{text}\n{CODE}"]
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0"):
        want += [name] * 2
        texts += [full(name, 50), f"{CODE[:999]}\n{full(name, 72)}"]
    # A sentence of a licence isn't one; a line still is, and rows may repeat a key.
    want += [None, None, "MIT", None]
    texts += ["This is distributed in the hope that it will be useful.", CODE, "without warranty\nReleased under the MIT License.", None]
    rows = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)] + [(0, "f", texts[0])], "id int, path string, text string")
    got = L.scan(rows, "id").collect()
    assert len(got) == len(texts) + 1
    assert {r.id: r.own_license for r in got} == dict(enumerate(want))


def test_blocks_that_match_have_a_legal_word():
    """Whatever the templates are: terms without such a word are too little of a template."""
    own = {"Frob-1": "you may frob the thing as often as it can be frobbed and no more than that so help you", "Frob-2": "all the things are to be of it in no way but one"}
    for templates in (L.BLOCKS, own):
        units = L._weights({k: Counter(set(L.shingles(v))) for k, v in templates.items()})[0]
        pattern = re.compile(L.legal(templates))
        for unit in units.values():
            assert math.sqrt(sum(x * x for t, x in unit.items() if not pattern.search(t))) < L.MATCH


def test_templates_of_a_caller(spark):
    own = {"Frob-1": "you may frob the thing as often as it can be frobbed and no more than that so help you"}
    rows = spark.createDataFrame([(1, f"code\n# {own['Frob-1']}\ncode"), (2, "code")], "id int, text string")
    assert [(r.id, r.license) for r in L.blocks(rows, "id", "text", own).collect()] == [(1, "Frob-1")]


def test_rows_of_one_key_have_their_own(spark):
    mit = "Released under the MIT License."
    files = [(1, "a/x", mit), (1, "b/x", "plain"), (1, "c/x", None), (None, "d/x", mit), (None, "e/x", GPL), (None, "f/x", ""), (2, "g/x", GPL), (2, "g/x", GPL), (2, "h/x", mit)]
    got = [(r.path, r.own_license) for r in L.scan(spark.createDataFrame(files, "id int, path string, text string"), "id").collect()]
    assert sorted(got) == [("a/x", "MIT"), ("b/x", None), ("c/x", None), ("d/x", "MIT"), ("e/x", "GPL-3.0"), ("f/x", None), ("g/x", "GPL-3.0"), ("g/x", "GPL-3.0"), ("h/x", "MIT")]


def test_clashing_names(spark):
    files = [("a/b.py", "Released under the MIT License.", "x", 1, "y", "z", "v", "w"), ("a/c.py", "none", "x", 2, "y", "z", "v", "w")]
    df = spark.createDataFrame(files, "path string, text string, own_license string, id int, own_score string, license string, folder string, near string")
    out = {r.path: r for r in L.scan(df, "id", declared=F.lit(True)).collect()}
    assert out["a/b.py"].license == out["a/c.py"].license == "MIT" and out["a/c.py"].inherited_from == "a"
    assert (out["a/c.py"].folder, out["a/c.py"].near, out["a/c.py"].own_license) == ("v", "w", None)
