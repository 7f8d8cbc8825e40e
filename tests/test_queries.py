"""Every registered query against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from paperloom.queries import load
from oracle import compare, connect

FOLDER = contract.SMOKE_FOLDER
SPARK, DUCK = load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "score"] and df.count() > 0


def test_keys():
    assert set(DUCK) == set(SPARK)
    assert set(SPARK) <= set(contract.queries()) and set(DUCK) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SPARK))
def test_query(spark, duck, name):
    rows, _, verdict = compare(spark, duck, FOLDER, SPARK[name], DUCK.get(name))
    assert verdict == "ok", verdict
