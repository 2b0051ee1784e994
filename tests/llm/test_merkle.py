from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tessera.llm.numbering import numbered

FIELDS = ["doc_id", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """The root, and for each node its siblings with their sides."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append("" if other >= len(level) else ("L" if p % 2 else "R") + level[other])
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def fold(digest, path):
    for s in path:
        digest = h(s[1:], digest) if s.startswith("L") else h(digest, s[1:])
    return digest


def plain(rows, tampered):
    """Sorted rows of the result by the definition."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0))
        trees[g] = own, *tree([leaf(r) for r in own])
    root, outer = tree([trees[g][1] for g in keys])
    out = []
    for g, above in zip(keys, outer, strict=True):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths, strict=True):
            told = leaf((*r[:2], r[2] + 1, *r[3:])) if tampered(r) else leaf(r)
            path = path + above
            end = fold(told, path)
            out.append((r[0], leaf(r), subroot, root, h(*[s[1:] for s in path]), end, end == root))
    return sorted(out, key=repr)


def seventh(r):
    return r[0] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def got(spark, rows, levels):
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_chars long, text string, path string, leaf int")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.verified(merkle.manifest(df, "doc_id", "lang", FIELDS, {"n_chars": changed}, levels))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("n,levels", [(1, 2), (2, 2), (5, 1), (37, 2), (64, 3), (90, 2)])
def test_manifest_equals_the_definition(spark, n, levels):
    """Groups of many blocks and turns, of powers of two and beyond, of one row, and of a null."""
    rows = [(i, ["en", "en", "de", "é"][i % 4] if i % 11 else None, i % 9 if i % 5 else None, ["", None, "ü\n" * i][i % 3], "p", 1) for i in range(n)]
    assert got(spark, rows, levels) == plain([r[:4] for r in rows], seventh)


def test_repeated_and_null_keys(spark):
    rows = [(3, "en", 1, "a", "", 0)] * 5 + [(None, "en", 1, "b", "", 0), (4, "en", 2, "long " * 100_000, "", 0)]
    assert got(spark, rows, 1) == plain([r[:4] for r in rows], seventh)
    assert got(spark, [], 2) == []


def test_numbers(spark):
    rows = [("x" if i % 3 else None, (i * 7) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    seen = {}
    for r in numbered(df, ["g"], ["v"]).collect():
        seen.setdefault(r.g, []).append((r.place, r.v, r.size))
    for g, found in seen.items():
        found.sort()
        assert [p for p, *_ in found] == list(range(len(found))) and {s for *_, s in found} == {len(found)}
        assert [v for _, v, _ in found] == sorted(v for x, v in rows if x == g)
    assert sorted(r.place for r in numbered(df, [], ["v"]).collect()) == list(range(200))
