from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import code as C
from tessera.operators import extract as E
from tessera.operators import graph as G
from tessera.operators import snapshot as S
from tessera.plans import sources
from tessera.plans.bindings import changes
from tessera.sources import trees
from tessera.streaming import runs

GO = '''package main

import "fmt"
import (
\t_ "a.org/x/driver"
\tm "a.org/x/models"
)

type User struct {
\tName string
}
type Store interface {
}
type ID = int

func Run() {}
func hidden[T any](x T) {}
func (u *User) Save(a int) error { return nil }
'''
TS = '''import React from 'react'
import { a as b, c } from "@/util"
import type { T } from './types'
import D, { e } from './service'
import * as ns from "@scope/pkg/deep"
import './style.css'
export { x } from './service'
export * from "./missing"
const y = require('left-pad')
export default function App() {}
export class Model {}
export interface Shape {}
export const run = async (q) => q
'''
PY = '''import os, a.b as ab
from . import sibling
from ..pkg import (
    one,
    two,
)
from requests import get
X = 1
class K(BaseModel):
    def m(self): pass
    def _p(self): pass
async def f(): pass
if __name__ == "__main__":
    f()
@app.route("/r")
def r(): pass
@app.post('/p')
def p(): pass
'''
FILES = {
    "main.go": GO, "src/app.tsx": TS, "src/util/index.ts": "export const z = 1", "src/service.ts": "", "src/types.ts": "export type T = 1",
    "pkg/mod/a.py": PY, "pkg/mod/sibling.py": "", "pkg/pkg/__init__.py": "", "bad.py": "def (", "node_modules/x/i.js": "function no() {}", ".hidden/y.py": "",
    "package.json": '{"name": "n", "main": "i.js", "dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}', "requirements.txt": "# c\nrequests>=2 ; python_version > '3'\n-r other\nnumpy\n",
    "go.mod": "module m\n\nrequire (\n\ta.org/x/driver v1.2.3\n)\n", "pyproject.toml": "[project]\ndependencies = [\n  'flask==3',\n  \"attrs\",\n]\n", "big.txt": "x" * 5000,
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return trees.files(spark, str(root), largest=4000).cache()


def test_scan(tree):
    rows = {r.path: r for r in tree.collect()}
    assert set(rows) == {n for n in FILES if not n.startswith(("node_modules", ".hidden", "big"))}
    assert rows["src/app.tsx"].language == "typescript" and rows["package.json"].kind == "config" and rows["main.go"].text == GO


def test_scans_are_those_of_a_walk(spark, tmp_path):
    """Names, hidden folders and files, and skipped ones, at any depth; nothing of a folder that isn't there."""
    names = [
        "a.py", "_x/__init__.py", "deep/er/still/b.go", ".env", ".git/config", "sub/.hidden/c.py", "node_modules/d.js", "vendor/e.go", "x.egg-info/f", "lib/poetry.lock", "m.pyc", "g.so", "sub/venv/h.py", "target/i", "coverage/j",
        "deep/.DS_Store", "empty.txt", "sub/k l.md",
    ]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.txt" else name)
    paths = lambda scan: {r.path for r in trees.walked(spark, str(tmp_path), scan).collect()}
    assert paths(trees.INDEX_SCAN) == {"a.py", "_x/__init__.py", "deep/er/still/b.go", ".env", "empty.txt", "sub/k l.md"}
    assert paths(trees.ARTIFACT_SCAN) == {"a.py", "_x/__init__.py", "deep/er/still/b.go", "vendor/e.go", "x.egg-info/f", "lib/poetry.lock", "g.so", "target/i", "coverage/j", "empty.txt", "sub/k l.md"}
    assert {r.path: r.text for r in trees.files(spark, str(tmp_path)).collect()}["sub/k l.md"] == "sub/k l.md"
    assert trees.walked(spark, str(tmp_path / "none")).count() == 0


MANIFEST = '{"name": "N", "version": "2", "manifest_version": 3, "permissions": ["tabs"]}'
ARTIFACTS = {
    "x/manifest.json": (MANIFEST, {("manifest", "N v2 (MV3)", None), ("config", "N v2", None)}),
    "s.scss": ("$a: 1px;\n:root {\n --b: #fff ;\n}", {("design_token", "$a", 1), ("design_token", "--b", 3)}),
    "s.css": ("$a: 1px;\n--b: 2;", {("design_token", "--b", 2)}),
    "README.md": ("x\n # Title \n", {("document", "Title", None)}),
    "LICENSE": ("words", {("document", "LICENSE", None)}),
    "m.py": ("import flask\n@dataclass\nclass A:\n  pass\nclass B(Model, X):\n  pass\n@app.route('/a/b')\ndef f(): pass", {
        ("model", "A", 2), ("model", "B", 5), ("api_endpoint", "GET /a/b", 7), ("server_file", "m", None), ("code:class", "A", 3), ("code:class", "B", 5), ("code:function", "f", 8), ("import", "flask", 1),
    }),
    "popup/a.js": ("chrome.tabs.query({})", {("extension_file", "a", None)}),
    "popup/b.js": ("", set()),
    "popup.js": ("", {("extension_file", "popup", None)}),
    "t.d.ts": ("export class T {}", set()),
}


def test_one_pass_finds_all_artifacts(spark):
    tree = spark.createDataFrame([(p, t) for p, (t, _) in ARTIFACTS.items()] + [("none.py", None)], "path string, text string")
    rows = E.extracted(tree).collect()
    assert not [r for r in rows if r.error]
    for path, (_, want) in ARTIFACTS.items():
        assert {(r.type, r.name, r.start_line) for r in rows if r.path == path} == want, path
    assert {r.id for r in rows if r.path == "m.py" and r.extractor == "endpoints"} == {"api:get:a_b"}


def test_a_failing_extractor_costs_its_own_rows(spark):
    def broken(path, text):
        yield f"b:{path}", "b", "first", 1, 1, {}
        raise KeyError("no such thing")

    tree = spark.createDataFrame([("a.py", "def f(): pass"), ("bad.py", "def ("), ("d.md", "# D")], "path string, text string")
    rows = E.extracted(tree, E.EXTRACTORS | {"broken": broken}).collect()
    lost = {(r.path, r.extractor) for r in rows if r.error}
    assert lost == {("a.py", "broken"), ("bad.py", "broken"), ("d.md", "broken"), ("bad.py", "symbols"), ("bad.py", "imports")}
    assert {(r.path, r.type, r.name) for r in rows if not r.error} == {("a.py", "code:function", "f"), ("d.md", "document", "D")}
    assert E.extracted(tree.limit(0)).count() == 0


def test_an_incremental_run_reads_what_changed(spark):
    old = spark.createDataFrame([("a.md", "# A"), ("b.md", "# B"), ("c.md", "# C")], "path string, text string")
    new = spark.createDataFrame([("a.md", "# A"), ("b.md", "# B2"), ("d.md", "# D")], "path string, text string")

    def once(path, text):
        if path == "a.md":
            raise ValueError("read again")
        yield from E.documents(path, text)

    actions = S.upsert(old, new, ["path"], ["text"])
    rows = E.refreshed(E.extracted(old), new, actions, {"documents": once}).collect()
    assert {(r.path, r.name, r.error) for r in rows} == {("a.md", "A", None), ("b.md", "B2", None), ("d.md", "D", None)}


def test_symbols(tree):
    found = C.symbols(tree)
    assert [r.path for r in found.filter("error IS NOT NULL").collect()] == ["bad.py"]
    rows = {(r.path, r.kind, r.parent, r.name, r.is_exported) for r in found.filter("error IS NULL").collect()}
    assert {r[1:] for r in rows if r[0] == "main.go"} == {("function", None, "Run", True), ("function", None, "hidden", False), ("method", "User", "Save", True), ("class", None, "User", True), ("interface", None, "Store", True)}
    assert {r[1:] for r in rows if r[0] == "src/app.tsx"} == {("function", None, "App", True), ("class", None, "Model", True), ("interface", None, "Shape", True), ("function", None, "run", True)}
    assert {r[1:] for r in rows if r[0] == "pkg/mod/a.py"} == {("variable", None, "X", True), ("class", None, "K", True), ("method", "K", "m", True), ("method", "K", "_p", False), ("function", None, "f", True), ("function", None, "r", True), ("function", None, "p", True)}
    ids = [r.id for r in C.symbol_ids(found).collect()]
    assert len(ids) == len(set(ids)) and "code:method:pkg/mod/a.py:K.m" in ids


def test_edges(tree):
    rows = C.edges(tree, trees.aliases('{ "compilerOptions": { // c\n "baseUrl": ".", "paths": { "@/*": ["src/*"], }, } }'.replace("// c", "")))
    by = {}
    for r in rows.collect():
        by.setdefault(r.source_id.removeprefix("code:module:"), set()).add((r.target_id, r.import_kind))
    assert by["main.go"] == {("external:go:fmt", "direct"), ("external:go:a.org/x/driver", "blank"), ("external:go:a.org/x/models", "alias")}
    service = "code:module:src/service.ts"
    assert by["src/app.tsx"] == {
        ("external:typescript:react", "default"), ("code:module:src/util/index.ts", "named"), ("code:module:src/types.ts", "type"), (service, "mixed"), (service, "re_export"), ("external:typescript:@scope/pkg", "namespace"),
        ("unresolved:relative_file_not_found:./style.css", "side_effect"), ("unresolved:relative_file_not_found:./missing", "re_export"), ("external:typescript:left-pad", "require"),
    }
    assert by["pkg/mod/a.py"] == {("external:python:os", "direct"), ("module:a.b", "direct"), ("unresolved:relative_file_not_found:.", "relative"), ("code:module:pkg/pkg/__init__.py", "relative"), ("module:requests", "from")}
    assert {r.target_id for r in G.hotspots(rows, 1).collect()} >= {service}
    # Scanning the same tree again adds nothing.
    assert rows.exceptAll(C.edges(tree, [("@/*", "src/*", ".")])).count() == 0


def test_alias_order():
    rules = [("@/*", "src/*", "."), ("@/core/*", "core/*", "."), ("@/core/x", "special.ts", "base")]
    first = lambda m: C.candidates("a.ts", "typescript", m, 0, rules)
    assert first("@/core/x")[1][0] == "base/special.ts" and first("@/core/y")[1][0] == "core/y" and first("@/z")[1][0] == "src/z"
    assert first("../up") == ("outside", []) and first("lodash") == ("external", [])


def test_manifests_and_detectors(tree):
    assert {(r.path, r.name, r.version) for r in trees.dependencies(tree).collect()} == {
        ("package.json", "react", "^18"), ("package.json", "vite", "5"), ("requirements.txt", "requests", ">=2"), ("requirements.txt", "numpy", ""),
        ("go.mod", "a.org/x/driver", "v1.2.3"), ("pyproject.toml", "flask", "==3"), ("pyproject.toml", "attrs", ""),
    }
    assert {(r.method, r.route) for r in C.endpoints(tree).collect()} == {("GET", "/r"), ("POST", "/p")}
    assert [r.name for r in C.models(tree).collect()] == ["K"]
    found = {r.technology: (r.n, round(r.confidence, 6)) for r in C.stacks(tree).collect()}
    assert found == {"Python": (2, 0.7), "Node.js": (1, 0.65), "React": (1, 0.7), "Vite": (1, 0.7)}
    assert {(r.path, r.kind) for r in C.entrypoints(tree).collect()} == {("pkg/mod/a.py", "python_main"), ("main.go", "server"), ("package.json", "node_main")}


def test_module_graph_and_configurations(spark, tree):
    assert {(r.path, r.label) for r in C.configurations(tree).collect()} == {("package.json", "package.json"), ("pyproject.toml", "pyproject.toml")}
    rows = [("a.py", "python", "import b", "source"), ("b.py", "python", "from . import c\nfrom .c import x", "source"), ("c.py", "python", "import a", "source"), ("d.py", "python", "import a", "source"), ("x.json", "json", '{"name": "n", "version": "1"}', "config")]
    small = spark.createDataFrame(rows, "path string, language string, text string, kind string")
    edges, cyclic = C.module_graph(small)
    assert {r.id for r in cyclic.collect()} == {"code:module:a.py", "code:module:b.py", "code:module:c.py"} and edges.count() == 4
    assert [r.label for r in C.configurations(small).collect()] == ["n@1"]


def test_git_texts(spark):
    lines = lambda *x: spark.createDataFrame([(t,) for t in x], "line string")
    assert [tuple(r) for r in lines("M  a", " M b", "?? c", "R  x -> y").select(*trees.git_status(F.col("line"))).collect()] == [("M", True, "a"), ("M", False, "b"), ("A", False, "c"), ("R", True, "y")]
    assert {tuple(r) for r in trees.git_diff(lines("1\t2\ta", "-\t-\tb"), lines("A\ta")).collect()} == {("a", "A", 1, 2), ("b", "M", 0, 0)}
    assert tuple(lines("abc feat: x").select(*trees.git_log(F.col("line"))).first()) == ("abc", "feat: x")
    assert [r.value for r in trees.json_lines(spark.createDataFrame([(1, "x")], "b int, a string")).collect()] == ['{"a":"x","b":1}']
    assert trees.listed("/nonexistent") is None


def test_streams_count_as_batches_do(spark, tmp_path):
    schema = "id int, ts timestamp, kind string, user int"
    rows = [(i, f"2024-01-0{1 + i // 20} 0{i % 10}:00:00", "ab"[i % 2], i % 3) for i in range(60)]
    df = spark.createDataFrame([(i, None, k, u) for i, _, k, u in rows], schema).drop("ts").join(spark.createDataFrame([(i, t) for i, t, _, _ in rows], "id int, ts string"), "id").select("id", F.to_timestamp("ts").alias("ts"), "kind", "user")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = runs.stream(spark, str(tmp_path / "in"), schema)

    def drained(out, mode, name):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    assert drained(runs.windows(live, "ts", "kind"), "complete", "w") == sorted(map(tuple, runs.windows(df, "ts", "kind").collect()))
    assert len(drained(runs.once(live.unionAll(live), "id", "ts", "10 days"), "append", "o")) == 60
    assert runs.sessions(df, "ts", "user", "1 hour").agg(F.sum("n")).first()[0] == 60


def test_files_are_parsed_once_by_several_tasks(spark, tmp_path):
    """A small file of many rows is no single task, and imports aren't parsed again for each use."""
    spark.range(50_000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'n' AS p_name", "'t' AS p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tree = sources.tree(spark, str(tmp_path))
    assert tree.rdd.getNumPartitions() == 3 and tree.count() == 50_000
    assert changes(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    plan = C.edges(tree.limit(50))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Broadcast" not in plan
