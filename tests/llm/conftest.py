from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    return SMALL
