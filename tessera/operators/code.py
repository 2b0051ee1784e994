"""Symbols and imports of source files, and what the imports resolve to.

Python is parsed, other languages are read by patterns with a lower confidence. A file that can't be parsed gives a row
with an error and no symbol. Ids are relative to the tree and hold a method's class, so that equal names don't meet.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cycle_nodes
from tessera.sources.batches import bounded, slices
from tessera.sources.store import written

SYMBOLS = "path string, kind string, name string, parent string, start_line int, end_line int, is_exported boolean, confidence double, error string"
IMPORTS = "path string, language string, module string, names array<string>, alias string, import_kind string, level int, line int"
CONFIDENCE = {"python": 1.0, "javascript": 0.55, "typescript": 0.55, "go": 0.8}
#: Languages of the files that symbols and imports are read from.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go"}
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]
_JS = {
    "function": re.compile(r"^(export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)"),
    "class": re.compile(r"^(export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    "interface": re.compile(r"^(export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    "arrow": re.compile(r"^(export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
}
_GO = {
    "method": re.compile(r"^func\s+\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*([A-Za-z_]\w*)\s*[\[(]"),
    "function": re.compile(r"^func\s+()([A-Za-z_]\w*)\s*[\[(]"),
    "class": re.compile(r"^type\s+()([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b"),
    "interface": re.compile(r"^type\s+()([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b"),
}


def _python_symbols(text: str) -> Iterator[tuple]:
    for node in ast.parse(text).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield kind, node.name, None, node.lineno, node.end_lineno, not node.name.startswith("_")
            for inner in node.body if kind == "class" else ():
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield "method", inner.name, node.name, inner.lineno, inner.end_lineno, not inner.name.startswith("_")
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    yield "variable", target.id, None, node.lineno, node.end_lineno, not target.id.startswith("_")


def _pattern_symbols(text: str, patterns: dict[str, re.Pattern], go: bool) -> Iterator[tuple]:
    for number, line in enumerate(text.split("\n"), 1):
        for kind, pattern in patterns.items():
            if found := pattern.match(line):
                name = found[2]
                exported = name[:1].isupper() if go else bool(found[1])
                yield "function" if kind == "arrow" else kind, name, found[1] if kind == "method" else None, number, number, exported
                break


EXTRACTORS: dict[str, Callable[[str], Iterator[tuple]]] = {
    "python": _python_symbols,
    "javascript": lambda text: _pattern_symbols(text, _JS, False),
    "typescript": lambda text: _pattern_symbols(text, _JS, False),
    "go": lambda text: _pattern_symbols(text, _GO, True),
}


def _over(tree: DataFrame, schema: str, each: Callable[[str, str, str], Iterator[tuple]], kinds: list) -> DataFrame:
    """What `each` makes of path, language and text of each file, a few megabytes of them at a time."""
    bounded(tree.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [r for path, language, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in each(path, language, text or "")]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return tree.select("path", "language", "text").mapInArrow(run, schema)


def symbols(tree: DataFrame, extractors: dict | None = None) -> DataFrame:
    """EXT-01, EXT-02, EXT-04, EXT-05, EXT-13: the symbols of files whose language has an extractor. Another table of
    extractors replaces these; a language has one."""
    table = EXTRACTORS if extractors is None else extractors

    def each(path: str, language: str, text: str) -> Iterator[tuple]:
        if language not in table or path.endswith(".d.ts"):
            return
        trust = CONFIDENCE.get(language, 0.5)
        try:
            yield from [(path, *s, trust, None) for s in table[language](text)]
        except (SyntaxError, ValueError, RecursionError) as error:
            yield path, None, None, None, None, None, None, None, str(error)[:200]

    return _over(tree, SYMBOLS, each, [*[pa.string()] * 4, pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.string()])


def symbol_ids(rows: DataFrame) -> DataFrame:
    """rows of symbols() without errors, with an id of kind, path and name; a method's has its class."""
    return rows.filter("error IS NULL").withColumn("id", F.concat_ws(":", F.lit("code"), "kind", "path", F.concat_ws(".", "parent", "name")))


def _python_imports(text: str) -> Iterator[tuple]:
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield a.name, [], a.asname, "direct", 0, node.lineno
        elif isinstance(node, ast.ImportFrom):
            yield node.module or "", [a.name for a in node.names], None, "relative" if node.level else "from", node.level, node.lineno


_JS_IMPORT = re.compile(r"""(?ms)^[ \t]*(import|export)\s+(type\s+)?((?:[\w$*{][^;'"]*?)\s+from\s+)?["']([^"']+)["']""")
_JS_CALL = re.compile(r"""\b(require|import)\s*\(\s*["']([^"']+)["']\s*\)""")


def _js_imports(text: str) -> Iterator[tuple]:
    line = lambda at: text.count("\n", 0, at) + 1
    for m in _JS_IMPORT.finditer(text):
        clause = (m[3] or "").rsplit("from", 1)[0].strip()
        if m[1] == "export":
            if not clause:
                continue
            kind = "re_export"
        elif m[2]:
            kind = "type"
        else:
            kind = "side_effect" if not clause else "namespace" if clause.startswith("*") else "named" if clause.startswith("{") else "mixed" if "{" in clause else "default"
        inner = re.search(r"\{([^}]*)\}", clause)
        names = [x.split(" as ")[0].strip() for x in inner[1].split(",") if x.strip()] if inner else []
        first = clause.split(",")[0].strip()
        if first and first[0] not in "{*":
            names = [first, *names]
        yield m[4], names, None, kind, 0, line(m.start(4))
    for m in _JS_CALL.finditer(text):
        yield m[2], [], None, "require" if m[1] == "require" else "dynamic", 0, line(m.start())


_GO_ONE = re.compile(r'(?m)^import\s+([\w.]+\s+)?"([^"]+)"')
_GO_GROUP = re.compile(r"(?ms)^import\s*\((.*?)^\)")
_GO_LINE = re.compile(r'(?m)^\s*([\w.]+\s+)?"([^"]+)"')


def _go_imports(text: str) -> Iterator[tuple]:
    found = [(m.start(2), m[1], m[2]) for m in _GO_ONE.finditer(text)]
    for group in _GO_GROUP.finditer(text):
        found += [(group.start(1) + m.start(2), m[1], m[2]) for m in _GO_LINE.finditer(group[1])]
    for at, alias, module in found:
        alias = (alias or "").strip()
        kind = {"_": "blank", ".": "dot", "": "direct"}.get(alias, "alias")
        yield module, [], alias or None, kind, 0, text.count("\n", 0, at) + 1


IMPORTERS = {"python": _python_imports, "javascript": _js_imports, "typescript": _js_imports, "go": _go_imports}


_IMPORT_KINDS = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32()]


def _imports_of(path: str, language: str, text: str) -> list[tuple]:
    try:
        return [(path, language, *i) for i in IMPORTERS[language](text)] if language in IMPORTERS else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def imports(tree: DataFrame) -> DataFrame:
    """EXT-14, EXT-15, EXT-16: the imports of files; those of a file that can't be parsed are left out."""
    return _over(tree, IMPORTS, _imports_of, _IMPORT_KINDS)


def normal(path: str) -> str | None:
    """A path without . and .., null if it leaves the tree."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def candidates(path: str, language: str, module: str, level: int, rules: list[tuple[str, str, str]]) -> tuple[str, list[str]]:
    """JOI-07, JOI-08, JOI-09: how a module resolves and the paths that it may be, in the order in which they are tried.

    Rules are (pattern, target, base): an exact pattern goes before one with a star, a longer prefix before a shorter.
    """
    here = path.rpartition("/")[0]
    if language == "python":
        if level:
            base = here
            for _ in range(level - 1):
                base = base.rpartition("/")[0]
            stem = "/".join(x for x in (base, module.replace(".", "/")) if x)
            return "relative", [f"{stem}.py", f"{stem}/__init__.py"]
        stem = module.replace(".", "/")
        return "module", [f"{stem}.py", f"{stem}/__init__.py", f"src/{stem}.py", f"src/{stem}/__init__.py"]
    if language == "go":
        return "external", []
    if module.startswith("."):
        kind, stem = "relative", normal(f"{here}/{module}")
    else:
        kind, stem = "external", None
        for pattern, target, base in sorted(rules, key=lambda r: ("*" in r[0], -len(r[0].split("*")[0]))):
            prefix, star, tail = pattern.partition("*")
            if module == pattern or star and module.startswith(prefix) and module.endswith(tail):
                kind, stem = "alias", normal(f"{base}/{target.replace('*', module[len(prefix) : len(module) - len(tail)]) if star else target}")
                break
    if stem is None:
        return ("outside" if kind != "external" else kind), []
    return kind, [stem, *[stem + e for e in EXTENSIONS], *[f"{stem}/index{e}" for e in EXTENSIONS]]


def edges(tree: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """JOI-10, PRJ-11: source_id, target_id, type, resolution and line of the imports of a tree, whose files are parsed once.

    The first candidate that is a file is the target; without one an import is external, unresolved, or, in Python outside
    the standard library, a module by name. External ids name the package, with its scope, or Go's whole path.
    """
    rules = rules or []

    def each(path: str, language: str, text: str) -> Iterator[tuple]:
        for row in _imports_of(path, language, text):
            yield *row, *candidates(path, language, row[2], row[6], rules)

    found = written(_over(tree, IMPORTS + ", kind string, tried array<string>", each, [*_IMPORT_KINDS, pa.string(), pa.list_(pa.string())]), "imports")
    known = tree.select(F.col("path").alias("target")).distinct()
    key = ["path", "module", "level"]
    tried = found.select(*key, "kind", "tried").dropDuplicates(key).select(*key, F.posexplode("tried").alias("at", "target"))
    first = tried.join(known.hint("merge"), "target", "left_semi").groupBy(*key).agg(F.min_by("target", "at").alias("target"))
    rows = found.drop("tried").join(first.hint("merge"), key, "left")
    package = F.when(F.col("module").startswith("@"), F.regexp_extract("module", "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("module", "^([^/]+)", 1))
    top = F.substring_index("module", ".", 1)
    target = (
        F.when(F.col("target").isNotNull(), F.concat(F.lit("code:module:"), "target"))
        .when(F.col("language") == "go", F.concat(F.lit("external:go:"), "module"))
        .when((F.col("language") == "python") & (F.col("level") == 0) & top.isin(sorted(sys.stdlib_module_names)), F.concat(F.lit("external:python:"), top))
        .when((F.col("language") == "python") & (F.col("level") == 0), F.concat(F.lit("module:"), "module"))
        .when(F.col("kind") == "external", F.concat(F.lit("external:"), "language", F.lit(":"), package))
        .when(F.col("kind") == "alias", F.concat(F.lit("unresolved:alias_file_not_found:"), "module"))
        .otherwise(F.concat(F.lit("unresolved:relative_file_not_found:"), F.repeat(F.lit("."), F.col("level")), "module"))
    )
    return rows.select(F.concat(F.lit("code:module:"), "path").alias("source_id"), target.alias("target_id"), F.lit("imports").alias("type"), F.when(F.col("target").isNotNull(), F.col("kind")).otherwise("none").alias("resolution"), "import_kind", "line")


def endpoints(tree: DataFrame) -> DataFrame:
    """EXT-06: path, method and route of decorators of Python files; route() means GET."""
    form = r"""@\w+\.(get|post|put|delete|patch|route)\(\s*["']([^"']+)["']"""
    hits = F.arrays_zip(F.regexp_extract_all("text", F.lit(form), 1).alias("m"), F.regexp_extract_all("text", F.lit(form), 2).alias("r"))
    return tree.filter("language = 'python'").select("path", F.explode(hits).alias("h")).select("path", F.when(F.col("h.m") == "route", "GET").otherwise(F.upper("h.m")).alias("method"), F.col("h.r").alias("route"))


# Base classes of data models.
MODEL_BASES = ["BaseModel", "Schema", "Model", "Document", "AbstractBaseUser", "db.Model"]


def models(tree: DataFrame) -> DataFrame:
    """EXT-10: path and name of data models: classes one of whose bases is known, or dataclasses."""
    form = r"(?m)^class\s+(\w+)\(([^)]*)\)"
    plain = r"(?m)^@dataclass(?:\([^)]*\))?\s*\nclass\s+(\w+)"
    classes = F.arrays_zip(F.regexp_extract_all("text", F.lit(form), 1).alias("name"), F.regexp_extract_all("text", F.lit(form), 2).alias("bases"))
    based = F.filter(classes, lambda c: F.exists(F.split(c["bases"], ","), lambda x: F.trim(x).isin(MODEL_BASES)))
    names = F.array_distinct(F.concat(F.transform(based, lambda c: c["name"]), F.regexp_extract_all("text", F.lit(plain), 1)))
    return tree.filter("language = 'python'").select("path", F.explode(names).alias("name"))


# What tells a technology: (name, files at the top of a tree, dependencies in package.json, base confidence, step).
STACKS = [
    ("Python", ["pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile"], [], 0.4, 0.15),
    ("Node.js", ["package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"], [], 0.5, 0.15),
    ("TypeScript", ["tsconfig.json"], ["typescript"], 0.5, 0.25),
    ("FastAPI", [], [], 0.4, 0.2),
    ("Vue.js", ["vue.config.js"], ["vue", "@vue/cli-service"], 0.5, 0.25),
    ("React", [], ["react", "react-dom", "next"], 0.5, 0.2),
    ("Tailwind CSS", ["tailwind.config.js", "tailwind.config.ts"], ["tailwindcss"], 0.5, 0.2),
    ("Docker", ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore"], [], 0.5, 0.2),
    ("Vite", ["vite.config.ts", "vite.config.js", "vite.config.mjs"], ["vite"], 0.5, 0.2),
    ("Chrome Extension MV2", [], [], 0.4, 0.12),
    ("Chrome Extension MV3", [], [], 0.4, 0.12),
    ("Git", [".git"], [], 1.0, 0.0),
]
EXTENSION_KEYS = ["background.service_worker", "action", "side_panel", "content_scripts"]


def stacks(tree: DataFrame, table: list = STACKS) -> DataFrame:
    """RUL-26 over path and text: the technologies of a tree with n, the different signs of each at its top, and confidence,
    base + n * step up to one. Lock files alone are no sign of Node.js, nor is an extension's manifest without a version."""
    spark: SparkSession = tree.sparkSession
    marks = [(name, base, step) for name, _, _, base, step in table]
    wanted = [(name, kind, sign) for name, files, packages, _, _ in table for kind, signs in (("file", files), ("package", packages)) for sign in signs]
    marks, wanted = F.broadcast(spark.createDataFrame(marks, "technology string, base double, step double")), F.broadcast(spark.createDataFrame(wanted, "technology string, kind string, sign string"))
    top = tree.filter(~F.col("path").contains("/")).select("path", "text")
    path, text = F.col("path"), F.col("text")
    json = F.try_parse_json("text")
    sign = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("sign"))
    packages = F.concat(*[F.coalesce(F.map_keys(F.from_json(F.try_variant_get(json, f"$.{k}", "string"), "map<string,string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    named = top.select(F.explode(F.concat(F.array(sign("file", path)), F.when(path == "package.json", F.transform(packages, lambda x: sign("package", x))).otherwise(F.array().cast("array<struct<kind:string,sign:string>>")))).alias("s")).select("s.*").distinct()
    known = named.join(wanted, ["kind", "sign"]).groupBy("technology").agg(F.count("*").alias("n"), F.bool_or(F.col("sign") == "package.json").alias("package"))
    known = known.filter((F.col("technology") != "Node.js") | F.col("package")).select("technology", "n")
    asked = path.isin("requirements.txt", "pyproject.toml") & F.lower(text).contains("fastapi")
    runs = path.isin("main.py", "app.py", "server.py") & (text.contains("FastAPI") | text.contains("from fastapi"))
    fast = top.agg((F.count_if(asked) + F.coalesce(F.max(runs.cast("int")), F.lit(0))).alias("n")).filter("n > 0").select(F.lit("FastAPI"), "n")
    version = F.try_variant_get(json, "$.manifest_version", "int")
    n = sum((F.try_variant_get(json, f"$.{k}", "variant").isNotNull().cast("long") for k in EXTENSION_KEYS), F.lit(2).cast("long"))
    extension = top.filter((path == "manifest.json") & version.isin(2, 3)).select(F.concat(F.lit("Chrome Extension MV"), version), n)
    found = known.unionAll(fast).unionAll(extension).join(marks, "technology")
    return found.select("technology", "n", F.least(F.lit(1.0), F.col("base") + F.col("n") * F.col("step")).alias("confidence"))


def entrypoints(tree: DataFrame) -> DataFrame:
    """RUL-27, EXT-07, EXT-12: path and kind of where programs start: main guards, servers, main and bin of package.json,
    background of extensions."""
    own = F.regexp_extract("path", "([^/]*)$", 1)
    json = F.try_parse_json("text")
    kinds = F.array_compact(F.array(
        F.when((F.col("language") == "python") & F.col("text").rlike(r"""(?m)^if\s+__name__\s*==\s*["']__main__["']"""), "python_main"),
        F.when(own.isin("server.py", "app.py", "server.js", "server.ts", "main.go"), "server"),
        F.when((own == "package.json") & F.try_variant_get(json, "$.main", "string").isNotNull(), "node_main"),
        F.when((own == "package.json") & F.try_variant_get(json, "$.bin", "string").isNotNull(), "node_bin"),
        F.when((own == "manifest.json") & F.try_variant_get(json, "$.manifest_version", "int").isNotNull(), "extension"),
    ))
    return tree.select("path", F.explode(kinds).alias("kind"))


def configurations(tree: DataFrame) -> DataFrame:
    """EXT-11: path and label of configuration files; of a JSON text with a name and a version, these, else the file's name."""
    json, own = F.try_parse_json("text"), F.regexp_extract("path", "([^/]*)$", 1)
    label = F.concat(F.try_variant_get(json, "$.name", "string"), F.lit("@"), F.try_variant_get(json, "$.version", "string"))
    return tree.filter("kind = 'config'").select("path", F.coalesce(F.when(own.endswith(".json"), label), own).alias("label"))


def inner_edges(tree: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """GRA-08: the edges between files of a tree."""
    return edges(tree, rules).filter(F.col("target_id").startswith("code:module:"))


def module_graph(tree: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """GRA-08: the edges between files of a tree and the files on import cycles. Dotted Python names that are files resolve
    to them, others stay outside."""
    inner = inner_edges(tree, rules)
    return inner, cycle_nodes(inner)
