"""Every query of the core that SQL can express, against DuckDB; the others run and keep their schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from kumikata import catalog
from tests.oracle import same


#: Queries whose gates nothing passes at the smallest scale.
GATED = {"decision_criteria"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_are_those_of_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), sf, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_come_and_come_again(spark, sf, name):
    frame = catalog.QUERIES[name](spark, sf)
    first = sorted(map(str, frame.collect()))
    assert first or name in GATED
    assert first == sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "target", "weight", "ok"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
