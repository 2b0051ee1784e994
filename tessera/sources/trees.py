"""Source trees as tables: files with their contents, and text that tools print about repositories."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.sources.store import written

LARGEST = 1 << 20
# Folders, hidden ones aside, and files that the index leaves out, and those that artifacts aren't looked for in. The
# forms with a star are meant as patterns.
SKIPPED_FOLDERS = ["__pycache__", "node_modules", "venv", "dist", "build", "coverage", "target", "vendor", "eggs", "*.egg-info"]
SKIPPED_FILES = [
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.o", "*.a", "*.lib", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "poetry.lock", "Pipfile.lock", ".DS_Store", "Thumbs.db",
]
ARTIFACT_FOLDERS = ["__pycache__", "node_modules", "venv", "dist", "build"]
ARTIFACT_FILES = ["*.pyc", "*.pyo"]


@dataclass(frozen=True)
class Scan:
    """Which folders and files a scan leaves out, by patterns of their names; hidden folders always, hidden files if so."""

    folders: tuple[str, ...]
    files: tuple[str, ...]
    hidden_files: bool

    def enters(self, name: str) -> bool:
        return not name.startswith(".") and not any(fnmatchcase(name, p) for p in self.folders)

    def takes(self, name: str) -> bool:
        return (self.hidden_files or not name.startswith(".")) and not any(fnmatchcase(name, p) for p in self.files)


INDEX_SCAN = Scan(tuple(SKIPPED_FOLDERS), tuple(SKIPPED_FILES), True)
ARTIFACT_SCAN = Scan(tuple(ARTIFACT_FOLDERS), tuple(ARTIFACT_FILES), False)


def listed(root: str, seconds: int = 30) -> list[str] | None:
    """SRC-01: tracked files and untracked ones that aren't ignored; null where git has no answer in time."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted(set(out.stdout.splitlines()))


def walked(spark: SparkSession, root: str, scan: Scan = INDEX_SCAN, folders: int = 64) -> DataFrame:
    """SRC-02, SRC-05: path below root, size and modified_at of the files that a scan takes.

    Folders are listed on executors, those of one depth in one round, which is written to the shared folder; the driver sees how many
    there are and no name. A folder that goes meanwhile is empty. The skip lists are applied where names are read.
    """
    system, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else Path(root).resolve().as_uri())
    schema = "path string, is_folder boolean, size long, modified_at long"

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(pyarrow.fs.FileSelector(f"{base.rstrip('/')}/{folder}", recursive=False, allow_not_found=True))
                took = [i for i in found if (scan.enters if i.type == pyarrow.fs.FileType.Directory else scan.takes)(i.base_name) and i.type != pyarrow.fs.FileType.NotFound]
                columns = [[f"{folder}/{i.base_name}".lstrip("/") for i in took], [not i.is_file for i in took], [i.size for i in took], [int(i.mtime.timestamp()) if i.mtime else None for i in took]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "is_folder", "size", "modified_at"])

    depth, found = spark.createDataFrame([("",)], "path string"), []
    while n := depth.count():
        now = written(depth.repartition(max(1, min(folders, n)), "path").mapInArrow(listing, schema), "listing")
        found.append(now.filter("NOT is_folder").select("path", "size", "modified_at"))
        depth = now.filter("is_folder").select("path")
    return reduce(DataFrame.unionAll, found)


def files(spark: SparkSession, root: str, largest: int = LARGEST, scan: Scan = INDEX_SCAN, partitions: int = 64) -> DataFrame:
    """SRC-02, SRC-03, SRC-05: path below root, language, kind, size, modified_at, content_hash and text of the files of a scan up to
    `largest` bytes.

    Large files go before anything of them is read. Spark's own file readers leave out empty files and names that begin with an
    underscore, which trees of sources have.
    """
    system, base = pyarrow.fs.FileSystem.from_uri(root if "://" in root else Path(root).resolve().as_uri())
    names = walked(spark, root, scan).filter(F.col("size") <= largest).repartition(partitions, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(batch.num_rows):  # one file at a time, as each may be a megabyte
                row = batch.slice(lo, 1)
                with system.open_input_file(f"{base.rstrip('/')}/{row.column(0)[0].as_py()}") as file:
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([file.read()], pa.binary())], names=["path", "size", "modified_at", "content"])

    rows, at = names.mapInArrow(read, "path string, size long, modified_at long, content binary"), F.col("path")
    return rows.select("path", P.language(at).alias("language"), P.file_kind(at).alias("kind"), "size", "modified_at", F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def git_status(lines: Column) -> list[Column]:
    """SRC-07: status, staged and path of lines of a short status; of a rename the new path."""
    x, y = F.substring(lines, 1, 1), F.substring(lines, 2, 1)
    path = F.regexp_replace(F.substring(lines, 4, 1 << 20), r"^.* -> ", "")
    return [F.when(x == "?", "A").when(x != " ", x).otherwise(y).alias("status"), ((x != " ") & (x != "?")).alias("staged"), F.regexp_replace(path, '^"|"$', "").alias("path")]


def git_diff(numstat: DataFrame, name_status: DataFrame) -> DataFrame:
    """SRC-07: path, status, added and deleted from lines (a column line) of the two listings; a binary file's counts are 0
    and a path without a status is modified."""
    part = lambda k: F.get(F.split("line", "\t"), F.lit(k))
    counts = numstat.select(part(2).alias("path"), *[F.coalesce(part(k).try_cast("int"), F.lit(0)).alias(n) for k, n in ((0, "added"), (1, "deleted"))])
    status = name_status.select(F.element_at(F.split("line", "\t"), -1).alias("path"), F.substring(part(0), 1, 1).alias("status"))
    return counts.join(status, "path", "left").select("path", F.coalesce("status", F.lit("M")).alias("status"), "added", "deleted")


def git_log(lines: Column) -> list[Column]:
    """SRC-07: hash and header of lines of a short log."""
    return [F.substring_index(lines, " ", 1).alias("hash"), F.regexp_replace(lines, r"^\S+\s*", "").alias("header")]


def git_tags(lines: Column) -> Column:
    """SRC-07: the name of a tag of a line of a listing of tags, null for a blank line."""
    return F.nullif(F.trim(lines), F.lit(""))


# Names of manifests and their kinds.
MANIFEST_KINDS = {"package.json": "npm", "pyproject.toml": "python", "requirements.txt": "pip", "go.mod": "go", "manifest.json": "extension"}


def dependencies(tree: DataFrame) -> DataFrame:
    """SRC-08, JOI-12: path, name and version of what package.json, requirements.txt and go.mod ask for (path and text).

    Of pyproject.toml the array of dependencies is read. What can't be parsed asks for nothing.
    """
    own, text = P.name(F.col("path")), F.col("text")
    parsed = F.try_parse_json(text)
    maps = F.array(*[F.from_json(F.try_variant_get(parsed, f"$.{k}", "string"), "map<string,string>") for k in ("dependencies", "devDependencies", "peerDependencies")])
    npm = tree.filter(own == "package.json").select("path", F.explode(maps).alias("m")).select("path", F.explode("m").alias("name", "version"))
    line = r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([=<>!~][^;#\n]*)?"
    pip = tree.filter(own.rlike(r"^requirements.*\.txt$")).select("path", F.explode(F.split(F.regexp_replace("text", r"(?m)^\s*(#|-).*$", ""), "\n")).alias("l")).filter("trim(l) <> ''")
    pip = pip.select("path", F.regexp_extract("l", line, 1).alias("name"), F.trim(F.regexp_extract("l", line, 2)).alias("version"))
    quoted = F.explode(F.regexp_extract_all(F.regexp_extract(text, r"(?ms)^dependencies\s*=\s*\[(.*?)\]\s*$", 1), F.lit(r"""["']([^"']+)["']"""), 1))
    python = tree.filter(own == "pyproject.toml").select("path", quoted.alias("l")).select("path", F.regexp_extract("l", line, 1).alias("name"), F.trim(F.regexp_extract("l", line, 2)).alias("version"))
    form = r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)"
    go = tree.filter(own == "go.mod").select("path", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(form), 1).alias("name"), F.regexp_extract_all(text, F.lit(form), 2).alias("version"))).alias("d")).select("path", "d.name", "d.version")
    return npm.unionAll(pip).unionAll(python).unionAll(go).filter("name <> ''").distinct()


def aliases(config: str) -> list[tuple[str, str, str]]:
    """SRC-09: (pattern, target, base) of the paths of a tsconfig's text, first targets only; comments and trailing commas
    are let pass, and what is no JSON has none."""
    text = re.sub(r"(?m)^\s*//.*$|/\*.*?\*/", "", config, flags=re.S | re.M)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    return [(k, v[0], options.get("baseUrl", ".")) for k, v in options.get("paths", {}).items() if v]


def alias_rules(tree: DataFrame) -> list[tuple[str, str, str]]:
    """SRC-09 over path and text: the rules of the first configuration at the top of a tree that has some, of tsconfig.json and jsconfig.json."""
    names = ["tsconfig.json", "jsconfig.json"]
    texts = {r["path"]: r["text"] for r in tree.filter(F.col("path").isin(names)).select("path", "text").collect()}  # two rows at most
    return next((rules for n in names if n in texts and (rules := aliases(texts[n] or ""))), [])


def json_lines(df: DataFrame) -> DataFrame:
    """SNK-06: each row as one JSON text with its columns in the order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
