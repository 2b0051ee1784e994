from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.bpe import read_ranks
from tessera.llm.queries import PACKED

ODD = ["", "a", " ", "  lead", "tabs\t\there \n\n x", "it's we'll I'M", "Grüße, señor – “quoted”… 12,5 ² ¼", "日本語 テキスト", "a\x1cb\x1d c\x85d e", "<|endoftext|> x", "a" * 5000, " " * 3000 + "b", "é" * 700, "​　 x y", "𝔘𝔫𝔦 1²3"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PACKED[0])
    t.encode_special_tokens = True
    return t


def test_ids_are_the_tokenizers(spark, sf_dir, tokenizer, monkeypatch):
    with open(PACKED[0], encoding="utf-8") as file:
        coder = packing.Coder(file.read(), read_ranks(PACKED[1]), PACKED[2])
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    for size in (packing.SEGMENT, 50):
        monkeypatch.setattr(packing, "SEGMENT", size)
        for text in texts:
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def held(rows, docs, tokenizer, capacity=1024):
    """The rows keep the rules; how many sequences there are, and the fewest that could do."""
    ids = {key: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for key, text in docs}
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for key, found in pieces.items():
        own, at = ids[key], 0
        for i, (piece, start, length, crc) in enumerate(sorted(found)):
            assert (piece, start) == (i, at) and crc == zlib.crc32(np.array(own[at : at + length], "<u4").tobytes())
            assert length == capacity or i == 0
            at += length
        assert at == len(own) and len(found) == -(-len(own) // capacity)
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(map(len, ids.values())) // capacity)


def test_query_keeps_the_rules_and_wastes_little(spark, sf_dir, tokenizer):
    from tessera.llm.queries import op13_packing

    sf = sf_dir.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = held(op13_packing(spark, sf).collect(), docs, tokenizer)
    assert n <= least * 1.02


def test_odd_rows(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate([None, *ODD, "word " * 30_000, *["same text"] * 40])]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, Length int, room int")
    out = packing.pack(packing.pieces(df, *PACKED))
    n, least = held(out.collect(), docs, tokenizer)
    assert n <= least + 1
    assert packing.pack(packing.pieces(df.limit(0), *PACKED)).count() == 0
    twice = packing.pack(packing.pieces(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string"), *PACKED))
    assert sorted((r.offset, r.length) for r in twice.collect()) == [(0, 2), (2, 2), (4, 2)]


def test_sequences_hold_their_pieces(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"text {i} of many " * (i % 700)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, *PACKED, ids=True))
    rows, whole = packed.collect(), {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(packed).collect()}
    assert whole.keys() == {r.sequence_id for r in rows}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length].tobytes() == bytes(r.ids)


def first_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


@pytest.mark.parametrize("low,high,n", [(1, 1000, 3000), (300, 420, 2000), (330, 360, 900), (1, 40, 2000), (513, 1023, 300), (700, 701, 50), (100, 260, 1500)])
def test_plans_need_few_sequences(low, high, n):
    rng, capacity = random.Random(low), 1024
    counts = Counter(rng.randrange(low, high) for _ in range(n))
    plan, used = packing.large_plan({x: k for x, k in counts.items() if x > 256}, capacity, 48, 0)
    load, took = Counter(), Counter()
    for length, lo, hi, first, each, base in plan:
        for r in range(lo, hi):
            load[base + (r - first) // each] += length
            took[length, r] += 1
    assert not load or max(load.values()) <= capacity and max(load) < used
    later = packing.small_plan({x: k for x, k in counts.items() if x <= 256}, Counter(capacity - v for v in load.values() if v < capacity), capacity)
    more, new = Counter(), set()
    for length, lo, hi, first, each, room, base in later:
        for r in range(lo, hi):
            more[room, base + (r - first) // each] += length
            took[length, r] += 1
            if room == capacity:
                new.add(base + (r - first) // each)
    assert all(v <= room for (room, _), v in more.items())
    assert took == Counter({(x, r): 1 for x, k in counts.items() for r in range(k)})
    lengths = list(counts.elements())
    assert len(load) + len(new) <= max(first_fit(lengths, capacity) * 1.03 + 2, -(-sum(lengths) // capacity) * 1.01 + 2)
