from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.sources import snapshots as N
from tessera.sources.store import fresh_path

SCHEMA = "path string, hash string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, version=None):
    return {r.path: (r.hash, r.n) for r in N.read(spark, path, version).collect()}


def acts(df):
    return {r.path: r.action for r in df.collect()}


def test_upserts_are_versions(spark):
    path = fresh_path(spark, "table")
    first = [(f"f{i}", "a", i) for i in range(200)]
    assert set(acts(N.upsert(path, frame(spark, first), ["path"], ["hash"])).values()) == {"inserted"}
    second = [("f3", "b", 0), ("f4", "a", 99), ("new", "c", 1)]
    assert acts(N.upsert(path, frame(spark, second), ["path"], ["hash"])) == {"f3": "updated", "f4": "skipped", "new": "inserted"}
    assert N.versions(spark, path) == [0, 1] and held(spark, path, 0) == {p: (h, n) for p, h, n in first}
    now = held(spark, path)
    # A row that is skipped stays as it was, and keys that an upsert lacks stay.
    assert len(now) == 201 and now["f3"] == ("b", 0) and now["f4"] == ("a", 4) and now["new"] == ("c", 1)
    old, new = N.folders(spark, path, 0), N.folders(spark, path, 1)
    changed = {b for b in new if old.get(b) != new[b]}
    assert 1 <= len(changed) <= 2 and len(new) > 40
    assert acts(N.upsert(path, frame(spark, second), ["path"], ["hash"])) == {"f3": "skipped", "f4": "skipped", "new": "skipped"}
    assert N.folders(spark, path, 2) == new


def test_a_whole_table_removes(spark):
    path = fresh_path(spark, "table")
    N.upsert(path, frame(spark, [("a", "1", 1), ("b", "1", 1), (None, "1", 1)]), ["path"], ["hash", "n"])
    got = acts(N.upsert(path, frame(spark, [("a", "1", 1), (None, None, 1)]), ["path"], ["hash", "n"], whole=True))
    assert got == {"a": "skipped", "b": "removed", None: "updated"} and held(spark, path) == {"a": ("1", 1), None: (None, 1)}
    N.upsert(path, frame(spark, []), ["path"], ["hash"], whole=True)
    assert held(spark, path) == {} and held(spark, path, 0).keys() == {"a", "b", None}


def test_of_rows_of_one_key_the_last_counts(spark):
    path = fresh_path(spark, "table")
    rows = [("a", "x", 1), ("a", "y", 3), ("a", "z", 2), ("b", "long " * 100_000, 1)]
    N.upsert(path, frame(spark, rows), ["path"], ["hash"], order=["n"])
    assert held(spark, path)["a"] == ("y", 3) and len(held(spark, path)["b"][0]) == 500_000


def test_only_one_of_two_writers_makes_a_version(spark):
    path = fresh_path(spark, "table")
    N.upsert(path, frame(spark, [("a", "1", 1)]), ["path"], ["hash"])

    def write(k):
        try:
            N._commit(spark, path, 1, N._told(spark, path, 0) | {"writer": k})
        except N.Conflict:
            return None
        return k

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(write, range(4)) if k is not None]
    assert len(won) == 1 and N._told(spark, path, 1)["writer"] == won[0]
    assert [f for f in os.listdir(f"{path.removeprefix('file://')}/versions") if f.startswith("draft")] == []
    with pytest.raises(N.Conflict):
        N._commit(spark, path, 0, {})
    assert held(spark, path) == {"a": ("1", 1)}
