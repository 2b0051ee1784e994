from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import text as X
from tests.llm import brute


def grouped(values, at):
    return [list(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n ", max_size=30)), max_size=6), st.integers(4, 40))
def test_tokens_and_shingles_are_those_of_split(texts, piece):
    old, X.PIECE = X.PIECE, piece
    try:
        data, at = X.raw(pa.array(texts, pa.string()))
        words, ends = X.tokens(data, at)
    finally:
        X.PIECE = old
    want = [brute.words(t) for t in texts]
    assert [len(g) for g in grouped(words, ends)] == [len(w) for w in want]
    known = {}
    for g, w in zip(grouped(words, ends), want, strict=True):
        for h, x in zip(g, w, strict=True):
            assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)
    values, row = X.shingles(words, ends)
    assert [len(set(values[row == i])) for i in range(len(texts))] == [len(brute.shingles(t)) for t in texts]


def test_a_token_longer_than_a_piece():
    data, at = X.raw(pa.array(["x" * (3 * X.PIECE) + " y", None, "y"]))
    words, ends = X.tokens(data, at)
    assert ends.tolist() == [0, 2, 2, 3] and words[1] == words[2]


def test_sliced_columns():
    column = pa.array(["a b", "c", "d e f"]).slice(1, 2)
    data, at = X.raw(column)
    assert np.diff(X.tokens(data, at)[1]).tolist() == [1, 3]
