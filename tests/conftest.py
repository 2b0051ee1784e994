from __future__ import annotations

import os

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

import pytest

from tessera.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
