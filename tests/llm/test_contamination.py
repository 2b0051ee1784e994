from __future__ import annotations

from tests.compare import oracle, rows
from tests.llm import brute
from tessera.llm import contamination as C

ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (2, "Short Item"), (3, ""), (4, None), (5, ITEM), (None, "word " * 9), (6, " ".join(f"w{i}" for i in range(90)))]
DOCS = [
    (1, "before " * 400 + ITEM.upper() + " after" * 400), (2, "x short\n item y"), (3, ""), (4, None), (1, ITEM),
    (5, ITEM.replace("twelve", "dozen") + " and more"), (6, ITEM.replace("six", "6")), (7, "word " * 50), (None, ITEM),
    (8, " ".join(f"w{i}" for i in range(85)) + " end"), (9, "one two three four"), (10, "short"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_search_is_complete(spark, monkeypatch):
    docs, items = frames(spark)
    for block in (C.BLOCK_BYTES, 60):
        monkeypatch.setattr(C, "BLOCK_BYTES", block)
        for least in (0.5, 0.8, 1.0):
            got = sorted([(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in C.search(docs, items, least=least).collect()], key=str)
            assert set(got) == brute.leaks(DOCS, ITEMS, least)
            assert len(got) == sum(1 for d in DOCS for _ in brute.leaks([d], [i for i in ITEMS], least))


def test_clean_keeps_columns_and_clean_rows(spark):
    docs, items = frames(spark)
    held = {d for d, *_ in brute.leaks(DOCS, ITEMS)}
    out = C.clean(docs.withColumnRenamed("doc_id", "item_id"), items)
    assert out.columns == ["item_id", "text"]
    named = C.clean(docs.withColumnRenamed("doc_id", "holds_item"), items)
    assert named.columns == ["holds_item", "text"] and sorted([tuple(r) for r in named.collect()], key=str) == sorted([tuple(r) for r in out.collect()], key=str)
    kept = [(k, t) for k, t in DOCS if not brute.leaks([(k, t)], ITEMS)]
    assert sorted([tuple(r) for r in out.collect()], key=str) == sorted(kept, key=str) and held
    assert C.search(docs.limit(0), items).count() == C.search(docs, items.limit(0)).count() == 0
    assert C.clean(docs, items.limit(0)).count() == len(DOCS)


def test_a_very_long_text(spark):
    docs, items = frames(spark)
    long = spark.createDataFrame([(1, "word " * 400_000 + ITEM + " tail" * 400_000), (2, "word " * 400_000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in C.search(long, items).collect()} == {(1, 1), (1, 5), (1, None), (2, None)}


def test_query(spark, sf_dir):
    from tessera.llm.queries import ORACLES, op8_contamination

    assert rows(op8_contamination(spark, sf_dir)) == oracle(ORACLES["op8_contamination"], sf_dir)
