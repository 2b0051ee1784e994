from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.queries import BPE_RANKS

RANKS = bpe.read_ranks(BPE_RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(RANKS, P.PATTERN)


def packed(text):
    ids = REFERENCE.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def test_odd_texts(coder):
    texts = ["", " ", "  ", "a  b", "a \n b\n", "aaaa" * 3000, "it's we'll 'S", "x 12 3　y", "!!! ???", "é" * 999, "\x00\x01", "🙂🙂 🙂", "A" * 20000 + "\n\n" + "ab" * 9000]
    assert coder.encode(texts) == [packed(t) for t in texts]
    for t in texts:
        assert coder.decode(np.frombuffer(packed(t), "<u4")) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abé \n\t'sS1_!　漢"), max_size=40), max_size=5))
def test_random_texts(texts):
    assert bpe.Bpe(RANKS, P.PATTERN).encode(texts) == [packed(t) for t in texts] if texts else True


def test_vocabularies_whose_merges_can_make_lower_ranks():
    """Merges of any order: the result is that of always taking the least rank, leftmost first."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = {bytes([i]): i for i in range(256)}
        words = set()
        while len(words) < 25:
            words.add("".join(rng.choice("ab") for _ in range(rng.randint(2, 6))).encode())
        order = list(range(256, 256 + len(words)))
        rng.shuffle(order)
        ranks = tokens | dict(zip(sorted(words), order, strict=True))
        coder = bpe.Bpe(ranks, P.PATTERN)
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 25))).encode() for _ in range(30)]
        want = []
        for piece in pieces:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while True:
                pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            want.append(struct.pack(f"<{len(parts)}I", *[ranks[p] for p in parts]))
        assert coder.merge(pieces) == want


def test_frames(spark):
    rows = [(1, "Hello world", 7), (2, None, 8), (3, "", 9), (1, "Hello world", 7), (None, "x" * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    out = bpe.decode(bpe.encode(docs, BPE_RANKS, P.PATTERN), BPE_RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        assert bytes(r.ids) == packed(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4
    assert bpe.encode(docs.limit(0), BPE_RANKS, P.PATTERN).count() == 0


def test_query(spark, sf_dir):
    from tessera.llm.queries import op7_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op7_bpe(spark, sf_dir).collect():
        ids = packed(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
