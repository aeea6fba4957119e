"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
from queryset import ORACLES, QUERIES  # noqa: E402
from tools.check import compare, duck  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry
    tiles = entry(spark)
    assert tiles.columns == ["layer", "z", "x", "y", "part", "n_parts", "tile", "n_features", "keys"]
    assert tiles.count() > 0
