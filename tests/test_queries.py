"""Every registered query against its SQL check, over the whole smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle
from motorwatch.querybook import checks, registered

D = "/root/testdata/sf0.001"
QUERIES, CHECKS = registered(), checks()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_its_check(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, D), con, CHECKS[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"oem_group", "recalls"}
