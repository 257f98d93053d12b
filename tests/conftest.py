"""Shared fixtures: one local Spark session and the driver table folders."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))

# sf used by the oracle tests (the driver checks sf0.01; sf0.001 keeps the suite quick)
TEST_SF = os.environ.get("ASPECTRA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from aspectra.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="aspectra-tests",
                      warehouse=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not Path(TEST_SF).exists():
        pytest.skip(f"test data not found at {TEST_SF}")
    return TEST_SF


@pytest.fixture()
def tmp_dir(tmp_path) -> str:
    return str(tmp_path)
