from __future__ import annotations

import pytest

from tessera.llm.queries import ORACLES, QUERIES
from tests.compare import oracle, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir)) == oracle(ORACLES[name], sf_dir)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
