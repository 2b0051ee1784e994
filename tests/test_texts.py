from __future__ import annotations

import random
import re
import sqlite3

import duckdb
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators import texts as X

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@ def f():
 same
-gone
+one
+two
@@ -10,1 +11,2 @@
 kept
+three
diff --git a/y.py b/y.py
--- a/y.py
+++ /dev/null
@@ -1 +0,0 @@
-all
"""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


def test_added_lines(spark):
    found = X.added_lines(spark.createDataFrame([(DIFF,)], "diff string")).collect()
    assert sorted((r.file, r.line, r.text) for r in found if r.file == "x.py") == [("x.py", 2, "one"), ("x.py", 3, "two"), ("x.py", 12, "three")]
    assert one(spark, DIFF).select(*X.diff_counts(F.col("text"))).first() == (3, 2)


def test_headings_titles_sections(spark):
    text = "intro\n# Top\ntext\n## Part \nbody\n### Deep\nmore\n## Next\nend\n####### no"
    assert [(r.line, r.level, r.title) for r in X.headings(one(spark, text), "id").orderBy("line").collect()] == [(2, 1, "Top"), (4, 2, "Part"), (6, 3, "Deep"), (8, 2, "Next")]
    assert one(spark, text).select(X.title(F.col("text"), F.lit("n")), X.title(F.lit("none"), F.lit("n"))).first() == ("Top", "n")
    assert one(spark, text).select(X.section(F.col("text"), "## Part"), X.section(F.col("text"), "## None")).first() == ("body\n### Deep\nmore", None)
    assert one(spark, "## [1.2.0] x\n## v1.1.0\n").select(X.versions(F.col("text"))).first()[0] == ["1.2.0", "v1.1.0"]


def test_colours_and_variables(spark):
    text = "a { color: #fff; }\n--main: #000;\n// #123456\nb { c: rgba(1, 2, 3, .5); d: hsl(1, 2%, 3%) }"
    assert sorted((r.line, r.kind, r.value, r.column) for r in X.colours(one(spark, text), "id").collect()) == [(1, "hex", "#fff", 11), (4, "hsl", "hsl(1, 2%, 3%)", 29), (4, "rgb", "rgba(1, 2, 3, .5)", 7)]
    assert [r.name for r in X.variables(one(spark, text), "id").collect()] == ["main"]


def test_mentions_keep_their_order(spark):
    found = X.mentions(one(spark, "v2.0.0 then 1.0.0, v2.0.0, Phase 3A, 12 passed"), "id").collect()
    assert {r.kind: list(r["values"]) for r in found} == {"version": ["v2.0.0", "1.0.0"], "phase": ["Phase 3A"], "test_baseline": ["12 passed"]}


def test_mentions_have_borders_of_ascii_and_all_values(spark):
    """As RE2, and so the SQL, has them: a letter that isn't of ASCII ends no value and begins none."""
    text = "hélas.mot überx.y_z.é v1.2.3é é1.2.3 1.2.3x Phase\x0b3 Phase 4é " + " ".join(f"9.9.{i}" for i in range(30))
    found = {r.kind: set(r["values"]) for r in X.mentions(one(spark, text), "id", most=None).collect()}
    assert found == {k: set(v) for k, v in ((k, duckdb.execute("SELECT regexp_extract_all(?, ?)", [text, p]).fetchone()[0]) for k, p in X.MENTIONS.items()) if v}
    assert "las.mot" in found["dotted_name"] and len(found["version"]) == 32


def test_order_of_equal_scores(spark):
    """Copies have the same score to the last bit, and with digits what is equal when rounded goes by key."""
    texts = [f"{'p ' * 3}j t {'fill ' * 5}"] * 400 + ["p j"] * 37 + ["t"] * 900 + ["p"] * 11 + ["none"] * 3000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(16)
    path = S.index(rows, "id", ["text"])
    for query in ("p j t", "t p j", "j t t p"):
        best = S.lookup(spark, path, query, 400).collect()
        assert [r.key for r in best] == list(range(400)) and len({r.score for r in best}) == 1
    near = spark.createDataFrame([(i, "w " * (1 + i % 2) + f"x{i} " * (400 + i % 2)) for i in range(40)], "id int, text string")
    at = S.index(near, "id", ["text"])
    assert [r.key for r in S.lookup(spark, at, "w", 40, digits=6).collect()] == sorted(range(40), key=lambda i: (-{r.key: round(r.score, 6) for r in S.lookup(spark, at, "w", 40).collect()}[i], i))
    assert [r.key for r in S.lookup(spark, at, "w", 40, digits=0).collect()] == list(range(40))


def test_bm25_is_that_of_sqlite(spark):
    texts = ["Color token for the café", "primary_color value", "token token color", "nothing", "cafe color", ""] + [f"filler {i} words" for i in range(20)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for query in ("color", "token color", "cafe", "absent"):
        want = {i: -s for i, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (query,))}
        got = {r.id: r.score for r in S.bm25(rows, "id", "text", query).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    path = S.index(rows, "id", ["text"])
    found = lambda q: [r.id for r in S.search(rows, "id", path, ["text"], q).collect()]
    assert found("primary_") == [1] and found("noth") == [3] and found("token color") == [2, 0] and found("no such") == []


def test_an_index_of_four_columns_is_that_of_sqlite(spark):
    """Several searches of one index; rows with nulls, empty rows and rows that repeat; a search reads its own folders."""
    rng = random.Random(4)
    words = ["user", "Order", "café", "src", "py", "größe", "v2", "the"] + [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(f"code:{i}:{some(3)}", rng.choice(["class", "function", None]), some(4), "/".join(some(5).split()) + ".py") for i in range(200)] + [("twice", "the", "the", "the")] * 2 + [("empty", None, None, None)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id, type, name, file_path)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    path = S.index(spark.createDataFrame(rows, "id string, type string, name string, file_path string"), "id", ["id", "type", "name", "file_path"])
    for query in ("user", "Order py", "cafe", "grosse", "größe src", "the the w1", "absent", "twice the"):
        want = sorted((-s, i) for i, s in con.execute("SELECT id, rank FROM t WHERE t MATCH ?", (query,)))
        got = sorted((r.score, r.key) for r in S.lookup(spark, path, query, 1000).collect())
        assert len(got) == len(want) and all(abs(a[0] - b[0]) < 1e-9 and a[1] == b[1] for a, b in zip(got, want, strict=True)), query
    best = [r.score for r in S.lookup(spark, path, "py", 5).collect()]
    assert len(best) == 5 and best == sorted(best, reverse=True)
    assert S.lookup(spark, path, "", 5).count() == 0
    plan = S.lookup(spark, path, "user")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ (= |IN )", plan)


def test_an_index_of_nothing_and_of_long_texts(spark):
    rows = spark.createDataFrame([(1, "long " * 100_000 + "end")], "id int, text string")
    path = S.index(rows, "id", ["text"])
    assert [r.key for r in S.lookup(spark, path, "end").collect()] == [1]
    assert S.lookup(spark, S.index(rows.limit(0), "id", ["text"]), "end").count() == 0
