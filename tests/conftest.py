from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelforge.session import builder, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = builder("local[4]", 4).config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
