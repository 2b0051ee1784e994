"""Queries over source trees made of parts: a file for each part, whose symbols and imports follow from the part's columns.

Of parts whose key leaves 0, 1 or 2 when divided by four, the files are Python, TypeScript and Go; of the others manifests,
style sheets, logs of changes and scripts in turn. Queries parse the texts; their equivalents count from the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import code as C
from tessera.operators import extract as E
from tessera.operators import rules as R
from tessera.operators import snapshot as S
from tessera.operators import texts as X
from tessera.operators import upkeep as U
from tessera.operators.cycles import strong_components
from tessera.plans.bindings import CHANGES_SQL, changes, parts
from tessera.session import table
from tessera.sources import trees
from tessera.sources.store import written

PYTHON = """import os, lib.x as lx
from .m{next} import run{next}
from requests import get
LIMIT{k} = {s}
class Item{k}({base}):
    def load(self): pass
    def _hide(self): pass
async def run{k}(): pass
@app.get("/r/{k}")
def route{k}(): pass
if {guard}:
    run{k}()
"""
TYPESCRIPT = """import React from 'react'
import { a, b } from './c{next}'
import * as ns from "@/c{last}"
export { z } from '@scope/kit/deep'
const y = require('left-pad')
export default class View{k} {}
export function draw{k}() {}
const help{k} = async (q) => q
interface Shape{k} {}
"""
GO = """package srv

import "fmt"
import (
\t_ "x.org/d{k}"
\tm "x.org/models"
)

type Row{k} struct {
}
type store{k} interface {
}
func Run{k}() {}
func (r *Row{k}) save() error { return nil }
"""
PACKAGE = '{"name": "p{k}", "version": "1.{s}.0", "main": "i.js", "dependencies": {"react": "^{s}"}}'
STYLE = ":root {\n  --c{k}: #fff;\n}\n.a { color: #A1B2C3; }\n// #000\n"
LOG = "intro\n# Log {k}\n## [1.2.{s}] - now\nfirst {k}\n### Deep\nmore\n## 1.1.0\nold\n"
SCRIPT = """n = int(input())
v = request.args.get("q")
f = open(request.form)
os.system(cmd)
subprocess.run(a, shell=True)
subprocess.call(argv)
x = eval(code)
g = getattr(o, name)
h = getattr(o, "name")
password = "hunter{k}"
print(token)
k = "sk-abcdefghijklmnopqrst{k}"
# os.system(x)
"""
ALIASES = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/*"],},}} // of the tree'


def _filled(text: str) -> Column:
    k = F.col("k")
    values = {"k": k, "s": F.col("s"), "next": k + 4, "last": k - 4, "base": F.when(k % 8 == 0, "BaseModel").otherwise("Plain"), "guard": F.when(k % 12 == 0, '__name__ == "__main__"').otherwise("LIMIT")}
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def tree(spark: SparkSession, d: str) -> DataFrame:
    """path, language, kind and text of the files of all parts."""
    k = F.col("k")
    kinds = [(k % 4 == 0, "app/m", ".py", PYTHON), (k % 4 == 1, "web/c", ".ts", TYPESCRIPT), (k % 4 == 2, "srv/g", ".go", GO), (k % 16 == 3, "pkg/p", "/package.json", PACKAGE), (k % 16 == 7, "style/t", ".css", STYLE), (k % 16 == 11, "log/h", ".md", LOG), (k % 16 == 15, "bin/s", ".py", SCRIPT)]
    path = F.coalesce(*[F.when(on, F.concat(F.lit(start), k.cast("string"), F.lit(end))) for on, start, end, _ in kinds])
    text = F.coalesce(*[F.when(on, _filled(form)) for on, _, _, form in kinds])
    rows = parts(spark, d).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return rows.select(path.alias("path"), P.language(path).alias("language"), P.file_kind(path).alias("kind"), text.alias("text"))


def _rules() -> list[tuple[str, str, str]]:
    return trees.aliases(ALIASES.split(" //")[0])


def tree_symbols(spark: SparkSession, d: str) -> DataFrame:
    """EXT-01, EXT-02, EXT-04, EXT-05, EXT-13."""
    return C.symbol_ids(C.symbols(tree(spark, d))).select("id", "name", "parent", "start_line", "end_line", "is_exported", "confidence")


def tree_imports(spark: SparkSession, d: str) -> DataFrame:
    """EXT-14, EXT-15, EXT-16."""
    return C.imports(tree(spark, d)).select("path", "module", F.array_join("names", ",").alias("names"), "alias", "import_kind", "level", "line")


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """JOI-07, JOI-08, JOI-09, JOI-10, PRJ-11, SRC-09."""
    return C.edges(tree(spark, d), _rules())


def tree_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """EXT-06."""
    return C.endpoints(tree(spark, d))


def tree_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    """EXT-07, EXT-12, RUL-27."""
    return C.entrypoints(tree(spark, d)).withColumnRenamed("kind", "entry")


def tree_models(spark: SparkSession, d: str) -> DataFrame:
    """EXT-10."""
    return C.models(tree(spark, d))


def tree_configurations(spark: SparkSession, d: str) -> DataFrame:
    """EXT-11."""
    return C.configurations(tree(spark, d))


def tree_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """SRC-08."""
    return trees.dependencies(tree(spark, d))


def tree_variables(spark: SparkSession, d: str) -> DataFrame:
    """EXT-08."""
    return X.variables(tree(spark, d), "path")


def tree_colours(spark: SparkSession, d: str) -> DataFrame:
    """EXT-20."""
    return X.colours(tree(spark, d), "path").select("path", "line", "kind", "value", F.col("column").alias("at"))


def tree_logs(spark: SparkSession, d: str) -> DataFrame:
    """EXT-09, EXT-19, EXT-24: title, versions and a section of the logs of changes."""
    text = F.col("text")
    return tree(spark, d).filter("path LIKE '%.md'").select("path", X.title(text, F.col("path")).alias("title"), F.array_join(X.versions(text), ",").alias("versions"), X.section(text, "## 1.1.0").alias("section"))


def tree_security(spark: SparkSession, d: str) -> DataFrame:
    """RUL-04, RUL-05, RUL-06, RUL-07, RUL-08, RUL-09."""
    rows = X.lines(tree(spark, d).filter("path LIKE '%.py'"), "path")
    return R.security(rows).select("rule", "severity", "subject", "line")


def page_forms(spark: SparkSession, d: str) -> DataFrame:
    """RUL-04 of pages, to each third of which a tag over two lines is added."""
    more = F.when(F.col("page_id") % 3 == 0, '\n<input\n name="a">').when(F.col("page_id") % 3 == 1, "\n<INPUT required>\n<form>").otherwise("")
    pages = table(spark, d, "pages").select(F.concat(F.col("page_id"), F.lit(".html")).alias("path"), F.concat(F.coalesce("html", F.lit("")), more).alias("text"))
    return R.unchecked_tags(X.lines(pages, "path")).groupBy("subject", "severity").agg(F.count("*").alias("n"))


def tree_stacks(spark: SparkSession, d: str) -> DataFrame:
    """RUL-26 of the tree with a file at its top for each region."""
    names = ["pyproject.toml", "requirements.txt", "package.json", "Dockerfile", "vite.config.ts"]
    texts = ["[project]", "fastapi>=1", '{"dependencies": {"react": "1"}, "devDependencies": {"typescript": "5"}}', "FROM x", ""]
    at = F.col("r_regionkey") + 1
    top = table(spark, d, "region").select(F.element_at(F.array(*map(F.lit, names)), at.cast("int")).alias("path"), F.element_at(F.array(*map(F.lit, texts)), at.cast("int")).alias("text"))
    found = C.stacks(tree(spark, d).select("path", "text").unionAll(top))
    return found.select("technology", "n", F.round("confidence", 6).alias("confidence"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.concat(F.lit("d"), k, F.lit("/requirements.txt"))
    new, gone = k % 3 == 0, k % 3 == 1
    minus = F.when(new, "").otherwise(F.concat(F.lit("-old"), k, F.lit("==1\n-both=="), s, F.lit("\n")))
    plus = F.when(gone, "").otherwise(F.concat(F.lit("+both==9\n+new"), k, F.lit(">=2\n")))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- "), F.when(new, "/dev/null").otherwise(F.concat(F.lit("a/"), path)), F.lit("\n+++ "), F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/"), path)))
    return parts(spark, d).select(F.concat(head, F.lit("\n@@ -1,2 +"), s, F.lit(",3 @@\n"), minus, plus).alias("diff"))


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """EXT-21."""
    return X.added_lines(_diffs(spark, d))


def diff_manifests(spark: SparkSession, d: str) -> DataFrame:
    """EXT-23: which manifests come and go, and the dependencies that they gain, lose and change."""
    found = U.manifest_names(_diffs(spark, d))
    return found.select("path", "status", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed")])


#: For remainders of four: a manifest and the lines of its diff, of which some only move.
MANIFEST_DIFFS = [
    ("package.json", '-  "react": "^{s}",\n-  "a": "1",\n+  "a": "1",\n+  "react": "^99",\n+  "vue": "1"\n'),
    ("pyproject.toml", '-  "flask[async]>={s}",\n+  "flask[async]>=99",\n+attrs = "^1",\n-python = "3"\n+# "none"\n'),
    ("go.mod", "-\ta.org/x v1.0.{s}\n+\ta.org/x v1.99.0\n-require b.org/y v{s}\n module m\n"),
    ("requirements.txt", "-requests=={s} ; python_version > '3'\n-six\n+six\n+requests==99 # c\n+numpy\n"),
]


def _manifest_diffs(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in MANIFEST_DIFFS]), (k % 4 + 1).cast("int"))
    lines = F.element_at(F.array(*[F.replace(F.lit(x), F.lit("{s}"), s) for _, x in MANIFEST_DIFFS]), (k % 4 + 1).cast("int"))
    path = F.concat(F.lit("v"), k, F.lit("/"), name)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,9 +1,9 @@\n"))
    return parts(spark, d).select(F.concat(head, lines).alias("diff"))


def dependency_versions(spark: SparkSession, d: str) -> DataFrame:
    """EXT-23: what changes in manifests of every kind, with versions."""
    return U.manifest_changes(_manifest_diffs(spark, d))


def dependency_changes(spark: SparkSession, d: str) -> DataFrame:
    """RUL-03: findings on manifests and dependencies of diffs."""
    diffs = _diffs(spark, d)
    return R.dependency_findings(U.manifest_status(diffs), U.manifest_changes(diffs)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def dependency_audits(spark: SparkSession, d: str) -> DataFrame:
    """RUL-03: the audits that the changes ask for."""
    diffs = _manifest_diffs(spark, d)
    return U.audits(U.manifest_status(diffs), U.manifest_changes(diffs))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """Files that can't be parsed: one for each region."""
    return table(spark, d, "region").select(F.concat(F.lit("bad"), "r_regionkey", F.lit(".py")).alias("path"), F.lit("def (").alias("text"))


def tree_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """EXT-13: what all extractors find in the tree and in files that can't be parsed."""
    found = E.extracted(tree(spark, d).select("path", "text").unionAll(_broken(spark, d)))
    return found.groupBy("extractor", "type", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.coalesce(F.sum("start_line"), F.lit(0)).alias("lines"))


def tree_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """EXT-13 incrementally: every eleventh part's style sheet gets another variable, manifests of packages go."""
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    before = tree(spark, d).select("path", "text", F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("path").endswith(".css") & (k % 11 == 0), F.concat("text", F.lit(".b { --more: 1px; }\n"))).otherwise(F.col("text"))
    after = tree(spark, d).filter("path NOT LIKE 'pkg/%'").select("path", text.alias("text"), F.sha2(text, 256).alias("content_hash"))
    actions = written(S.upsert(before, after, ["path"], ["content_hash"]), "actions")
    return E.refreshed(E.extracted(before), after, actions).groupBy("extractor", "type").agg(F.count("*").alias("n"))


def tree_cycles(spark: SparkSession, d: str) -> DataFrame:
    """GRA-08, GRA-01: the files of the tree on cycles of imports, and the least path of their component."""
    rows = written(strong_components(C.inner_edges(tree(spark, d), _rules())), "cycles")
    least = rows.groupBy("root").agg(F.min("id").alias("first"))
    return rows.join(least.hint("merge"), "root").select(F.expr("substring(id, 13)").alias("path"), F.expr("substring(first, 13)").alias("first"))


def git_listings(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07: the status, log and counts of a path for each part, read from lines as git prints them."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.concat(F.lit("src/f"), k, F.lit(".py"))
    line = F.when(k % 3 == 0, F.concat(F.lit(" M "), path)).when(k % 3 == 1, F.concat(F.lit("?? "), path)).otherwise(F.concat(F.lit("R  src/o"), k, F.lit(".py -> "), path))
    part = table(spark, d, "part")
    status = part.select(*trees.git_status(line), *trees.git_log(F.concat(F.lit("a"), k, F.lit(" fix: size "), s)))
    counts = part.select(F.concat(F.when(k % 5 == 0, "-").otherwise(s), F.lit("\t"), F.when(k % 5 == 0, "-").otherwise("7"), F.lit("\t"), path).alias("line"))
    names = part.filter(k % 2 == 0).select(F.concat(F.lit("A\t"), path).alias("line"))
    return status.join(trees.git_diff(counts, names).withColumnRenamed("status", "change"), "path")


def pattern_cover(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-07: whether a pattern covers the path of each part."""
    k, path = F.col("id") % 5, F.col("path")
    wide = F.when(k == 0, "*").when(k == 1, "src/**").when(k == 2, path).when(k == 3, "src/*.py").otherwise("docs/*")
    return changes(spark, d).select("id", P.covers(wide, path).alias("covered"))


def nation_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06: rows as lines of JSON."""
    return trees.json_lines(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


QUERIES = {f.__name__: f for f in (tree_symbols, tree_imports, tree_edges, tree_endpoints, tree_entrypoints, tree_models, tree_configurations, tree_dependencies, tree_variables, tree_colours, tree_logs, tree_security, page_forms, tree_stacks, tree_artifacts, tree_refreshed, tree_cycles, diff_lines, diff_manifests, dependency_versions, dependency_changes, dependency_audits, git_listings, pattern_cover, nation_lines)}
_K = """k AS (SELECT p_partkey AS k, p_size AS s, CASE p_partkey % 4 WHEN 0 THEN concat('app/m', p_partkey, '.py') WHEN 1 THEN concat('web/c', p_partkey, '.ts') WHEN 2 THEN concat('srv/g', p_partkey, '.go')
    ELSE CASE p_partkey % 16 WHEN 3 THEN concat('pkg/p', p_partkey, '/package.json') WHEN 7 THEN concat('style/t', p_partkey, '.css') WHEN 11 THEN concat('log/h', p_partkey, '.md') ELSE concat('bin/s', p_partkey, '.py') END END AS path FROM part)"""
#: Symbols: which remainder of which divisor has them, kind, start of the name, whether the key follows, parent, lines, exported.
_SYMBOLS = [
    (4, 0, "variable", "LIMIT", True, None, 4, 4, True), (4, 0, "class", "Item", True, None, 5, 7, True), (4, 0, "method", "load", False, "Item", 6, 6, True),
    (4, 0, "method", "_hide", False, "Item", 7, 7, False), (4, 0, "function", "run", True, None, 8, 8, True), (4, 0, "function", "route", True, None, 10, 10, True),
    (4, 1, "class", "View", True, None, 6, 6, True), (4, 1, "function", "draw", True, None, 7, 7, True), (4, 1, "function", "help", True, None, 8, 8, False),
    (4, 1, "interface", "Shape", True, None, 9, 9, False), (4, 2, "class", "Row", True, None, 9, 9, True), (4, 2, "interface", "store", True, None, 11, 11, False),
    (4, 2, "function", "Run", True, None, 13, 13, True), (4, 2, "method", "save", False, "Row", 14, 14, False),
    *[(16, 15, "variable", name, False, None, line, line, True) for name, line in (("n", 1), ("v", 2), ("f", 3), ("x", 7), ("g", 8), ("h", 9), ("password", 10), ("k", 12))],
]
#: Imports: remainder of four, module (SQL), names (SQL), alias, kind, level, line.
_IMPORTS = [
    (0, "'os'", "''", None, "direct", 0, 1), (0, "'lib.x'", "''", "lx", "direct", 0, 1), (0, "concat('m', k + 4)", "concat('run', k + 4)", None, "relative", 1, 2), (0, "'requests'", "'get'", None, "from", 0, 3),
    (1, "'react'", "'React'", None, "default", 0, 1), (1, "concat('./c', k + 4)", "'a,b'", None, "named", 0, 2), (1, "concat('@/c', k - 4)", "''", None, "namespace", 0, 3),
    (1, "'@scope/kit/deep'", "'z'", None, "re_export", 0, 4), (1, "'left-pad'", "''", None, "require", 0, 5),
    (2, "'fmt'", "''", None, "direct", 0, 3), (2, "concat('x.org/d', k)", "''", "_", "blank", 0, 5), (2, "'x.org/models'", "''", "m", "alias", 0, 6),
]
_found = lambda k, target: f"CASE WHEN {k} IN (SELECT p_partkey FROM part) THEN concat('code:module:', {target}) END"
#: Targets of the imports: the file, if there is one, else the other id; and how the file resolves.
_TARGETS = [
    ("NULL", "'external:python:os'", "none"), ("NULL", "'module:lib.x'", "none"), (_found("k + 4", "concat('app/m', k + 4, '.py')"), "concat('unresolved:relative_file_not_found:.m', k + 4)", "relative"), ("NULL", "'module:requests'", "none"),
    ("NULL", "'external:typescript:react'", "none"), (_found("k + 4", "concat('web/c', k + 4, '.ts')"), "concat('unresolved:relative_file_not_found:./c', k + 4)", "relative"),
    (_found("k - 4", "concat('web/c', k - 4, '.ts')"), "concat('unresolved:alias_file_not_found:@/c', k - 4)", "alias"), ("NULL", "'external:typescript:@scope/kit'", "none"), ("NULL", "'external:typescript:left-pad'", "none"),
    ("NULL", "'external:go:fmt'", "none"), ("NULL", "concat('external:go:x.org/d', k)", "none"), ("NULL", "'external:go:x.org/models'", "none"),
]
#: Artifacts: extractor, type, which files have it and its first line (SQL).
_ARTIFACTS = [
    ("endpoints", "api_endpoint", "k % 4 = 0", "9"), ("design_tokens", "design_token", "k % 16 = 7", "2"), ("documents", "document", "k % 16 = 11", "NULL"), ("models", "model", "k % 8 = 0", "5"), ("configurations", "config", "k % 16 = 3", "NULL"),
    *[("symbols", f"code:{kind}", f"k % {by} = {rest}", str(start)) for by, rest, kind, _, _, _, start, _, _ in _SYMBOLS], *[("imports", "import", f"k % 4 = {x[0]}", str(x[6])) for x in _IMPORTS],
]
_FLAWS = [
    ("input_validation", "error", 1), ("input_validation", "warning", 2), ("input_validation", "warning", 3), ("path_traversal", "warning", 3), ("command_injection", "error", 4), ("command_injection", "error", 5),
    ("command_injection", "warning", 6), ("eval_exec", "error", 7), ("eval_exec", "info", 8), ("sensitive_data", "warning", 10), ("sensitive_data", "info", 11), ("sensitive_data", "error", 12),
]
_TECHNOLOGIES = "(VALUES ('Python', 0, 0.4, 0.15), ('Python', 1, 0.4, 0.15), ('FastAPI', 1, 0.4, 0.2), ('Node.js', 2, 0.5, 0.15), ('TypeScript', 2, 0.5, 0.25), ('React', 2, 0.5, 0.2), ('Docker', 3, 0.5, 0.2), ('Vite', 4, 0.5, 0.2)) AS t(technology, r, base, step)"


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _symbol(by: int, rest: int, kind: str, name: str, keyed: bool, parent: str | None, start: int, end: int, exported: bool) -> str:
    named = f"concat('{name}', k)" if keyed else f"'{name}'"
    above = f"concat('{parent}', k)" if parent else "CAST(NULL AS VARCHAR)"
    whole = f"concat({above}, '.', {named})" if parent else named
    trust = {(4, 0): 1.0, (4, 1): 0.55, (4, 2): 0.8, (16, 15): 1.0}[by, rest]
    return f"SELECT concat('code:{kind}:', path, ':', {whole}) AS id, {named} AS name, {above} AS parent, {start} AS start_line, {end} AS end_line, {exported} AS is_exported, {trust}::DOUBLE AS confidence FROM k WHERE k % {by} = {rest}"


ORACLES = {
    "tree_symbols": f"WITH {_K} " + " UNION ALL ".join(_symbol(*x) for x in _SYMBOLS),
    "tree_imports": f"WITH {_K} " + " UNION ALL ".join(f"SELECT path, {module} AS module, {names} AS names, {_text(alias)} AS alias, '{kind}' AS import_kind, {level} AS level, {line} AS line FROM k WHERE k % 4 = {rest}" for rest, module, names, alias, kind, level, line in _IMPORTS),
    "tree_edges": f"WITH {_K}, e AS ("
    + " UNION ALL ".join(f"SELECT path, CAST({file} AS VARCHAR) AS file, {other} AS other, '{how}' AS how, '{x[4]}' AS import_kind, {x[6]} AS line FROM k WHERE k % 4 = {x[0]}" for x, (file, other, how) in zip(_IMPORTS, _TARGETS, strict=True))
    + ") SELECT concat('code:module:', path) AS source_id, coalesce(file, other) AS target_id, 'imports' AS type, CASE WHEN file IS NULL THEN 'none' ELSE how END AS resolution, import_kind, line FROM e",
    "tree_endpoints": f"WITH {_K} SELECT path, 'GET' AS method, concat('/r/', k) AS route FROM k WHERE k % 4 = 0",
    "tree_entrypoints": f"WITH {_K} SELECT path, 'python_main' AS entry FROM k WHERE k % 12 = 0 UNION ALL SELECT path, 'node_main' FROM k WHERE k % 16 = 3",
    "tree_models": f"WITH {_K} SELECT path, concat('Item', k) AS name FROM k WHERE k % 8 = 0",
    "tree_configurations": f"WITH {_K} SELECT path, concat('p', k, '@1.', s, '.0') AS label FROM k WHERE k % 16 = 3",
    "tree_dependencies": f"WITH {_K} SELECT path, 'react' AS name, concat('^', s) AS version FROM k WHERE k % 16 = 3",
    "tree_variables": f"WITH {_K} SELECT path, concat('c', k) AS name FROM k WHERE k % 16 = 7",
    "tree_colours": f"WITH {_K} SELECT path, 4 AS line, 'hex' AS kind, '#A1B2C3' AS value, 12 AS at FROM k WHERE k % 16 = 7",
    "tree_logs": f"WITH {_K} SELECT path, concat('Log ', k) AS title, concat('1.2.', s, ',1.1.0') AS versions, 'old' AS section FROM k WHERE k % 16 = 11",
    "tree_security": f"WITH {_K} SELECT rule, severity, path AS subject, line FROM k, (VALUES {', '.join(map(str, _FLAWS))}) AS f(rule, severity, line) WHERE k % 16 = 15",
    "page_forms": """WITH p AS (SELECT concat(page_id, '.html') AS subject, concat(coalesce(html, ''), CASE page_id % 3 WHEN 0 THEN chr(10) || '<input' || chr(10) || ' name="a">' WHEN 1 THEN chr(10) || '<INPUT required>' || chr(10) || '<form>' ELSE '' END) AS text FROM pages),
        t AS (SELECT subject, unnest(regexp_extract_all(text, '(?i)<(?:input|form)\\b[^>]*>')) AS tag FROM p) SELECT subject, 'info' AS severity, count(*) AS n FROM t WHERE NOT regexp_matches(tag, '(?i)\\b(required|pattern)\\b') GROUP BY 1""",
    "tree_stacks": f"SELECT technology, count(*) AS n, round(any_value(base) + count(*) * any_value(step), 6)::DOUBLE AS confidence FROM region JOIN {_TECHNOLOGIES} ON r = r_regionkey GROUP BY 1",
    "diff_lines": "SELECT concat('d', p_partkey, '/requirements.txt') AS file, p_size + i AS line, CASE WHEN i = 0 THEN 'both==9' ELSE concat('new', p_partkey, '>=2') END AS text FROM part, (VALUES (0), (1)) AS t(i) WHERE p_partkey % 3 <> 1",
    "diff_manifests": """SELECT concat('d', k, '/requirements.txt') AS path, CASE r WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status, CASE r WHEN 0 THEN concat('both,new', k) WHEN 1 THEN '' ELSE concat('new', k) END AS added,
        CASE r WHEN 0 THEN '' WHEN 1 THEN concat('both,old', k) ELSE concat('old', k) END AS removed, CASE r WHEN 2 THEN 'both' ELSE '' END AS changed FROM (SELECT p_partkey AS k, p_partkey % 3 AS r FROM part)""",
    "dependency_versions": """SELECT concat('v', p_partkey, '/', file) AS path, dependency, kind, replace(old, '{s}', p_size::VARCHAR) AS old, new FROM part JOIN (VALUES
        (0, 'package.json', 'react', 'version_changed', '^{s}', '^99'), (0, 'package.json', 'vue', 'added', NULL, '1'), (1, 'pyproject.toml', 'flask[async]', 'version_changed', '>={s}', '>=99'),
        (1, 'pyproject.toml', 'attrs', 'added', NULL, '^1'), (1, 'pyproject.toml', '3', 'removed', '*', NULL), (2, 'go.mod', 'a.org/x', 'version_changed', 'v1.0.{s}', 'v1.99.0'), (2, 'go.mod', 'b.org/y', 'removed', 'v{s}', NULL),
        (3, 'requirements.txt', 'requests', 'version_changed', '=={s}', '==99'), (3, 'requirements.txt', 'numpy', 'added', NULL, '*')) AS t(r, file, dependency, kind, old, new) ON r = p_partkey % 4""",
    "dependency_audits": "SELECT * FROM (VALUES ('python', 'pip-audit'), ('nodejs', 'npm audit'), ('go', 'govulncheck ./...'), ('multi', 'semgrep --config=auto')) AS t(kind, audit)",
    "dependency_changes": """WITH f AS (SELECT unnest(CASE p_partkey % 3 WHEN 0 THEN ['manifest_added/info', 'dependency_added/warning', 'dependency_added/warning'] WHEN 1 THEN ['manifest_removed/error', 'dependency_removed/warning', 'dependency_removed/warning']
        ELSE ['dependency_added/warning', 'dependency_removed/warning', CASE WHEN p_size = 9 THEN '' ELSE 'dependency_version_changed/warning' END] END) AS x FROM part) SELECT split_part(x, '/', 1) AS rule, split_part(x, '/', 2) AS severity, count(*) AS n FROM f WHERE x <> '' GROUP BY 1, 2""",
    "tree_artifacts": f"WITH {_K}, f AS (" + " UNION ALL ".join(f"SELECT '{x}' AS extractor, '{t}' AS type, path, {line}::BIGINT AS line FROM k WHERE {on}" for x, t, on, line in _ARTIFACTS)
    + """), e AS (SELECT unnest(['symbols', 'imports']) AS extractor, concat('bad', r_regionkey) AS path FROM region)
        SELECT extractor, type, FALSE AS failed, count(*) AS n, count(DISTINCT path) AS n_files, coalesce(sum(line), 0)::BIGINT AS lines FROM f GROUP BY 1, 2 UNION ALL SELECT extractor, NULL, TRUE, count(*), count(DISTINCT path), 0 FROM e GROUP BY 1""",
    "tree_refreshed": f"WITH {_K}, f AS (" + " UNION ALL ".join(f"SELECT '{x}' AS extractor, '{t}' AS type, {'CASE WHEN k % 11 = 0 THEN 2 ELSE 1 END' if t == 'design_token' else 1} AS m FROM k WHERE {on}" for x, t, on, line in _ARTIFACTS if "% 16 = 3" not in on)
    + ") SELECT extractor, type, sum(m)::BIGINT AS n FROM f GROUP BY 1, 2",
    "tree_cycles": f"""WITH RECURSIVE {_K}, w AS (SELECT k, path FROM k WHERE k % 4 = 1), s AS (SELECT w.*, sum(CASE WHEN p.k IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY w.k) AS run FROM w LEFT JOIN w p ON p.k = w.k - 4)
        SELECT path, min(path) OVER (PARTITION BY run) AS first FROM s QUALIFY count(*) OVER (PARTITION BY run) > 1""",
    "git_listings": """SELECT concat('src/f', p_partkey, '.py') AS path, CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'A' ELSE 'R' END AS status, p_partkey % 3 = 2 AS staged, concat('a', p_partkey) AS hash, concat('fix: size ', p_size) AS header,
        CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'M' END AS change, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS added, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 7 END AS deleted FROM part""",
    "pattern_cover": "WITH c AS (" + CHANGES_SQL + ") SELECT id, id % 5 IN (0, 2) OR (id % 5 = 1 AND path LIKE 'src/%') OR (id % 5 = 3 AND path LIKE 'src/%.py') OR (id % 5 = 4 AND path LIKE 'docs/%') AS covered FROM c",
    "nation_lines": "SELECT CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS VARCHAR) AS value FROM nation",
}
