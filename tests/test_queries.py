"""Every query with a SQL check gives the same rows; the others give a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tools.check import compare

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, checker, name):
    result = compare(spark, checker, SF_DIR, name, QUERIES[name], CHECKS[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
