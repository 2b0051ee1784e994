from __future__ import annotations

import os

import pytest

from tessera import catalog
from tests.compare import SMALL, oracle, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, name):
    assert rows(catalog.QUERIES[name](spark, SMALL)) == oracle(catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_entry_point_guards_the_optional_subpackage():
    """Nothing outside imports the subpackage."""
    for folder, _, names in os.walk("tessera"):
        if folder.startswith("tessera/llm"):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "tessera.llm" not in open(f"{folder}/{name}", encoding="utf-8").read()
