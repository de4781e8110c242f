"""Every topic query with SQL gives the same rows on DuckDB."""

import pytest

from tests.oracle import compare
from topiloom.plans import flagship
from topiloom.plans.oracle import ORACLES
from topiloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    rows, differing = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert rows or name == "catalog_rows"  # at this size every topic is too small to be accepted
    assert not differing


def test_flagship(spark):
    rows, differing = compare(flagship.topic_report(spark, SF), flagship.ORACLE, SF)
    assert rows == 10 and not differing


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
