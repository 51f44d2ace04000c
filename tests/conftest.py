from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from trailmill.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "4g", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
