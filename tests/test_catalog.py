"""Every query with SQL equals DuckDB at the smallest scale; the others run."""

import pytest

from newsquant.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

# Slow fits: their operators have tests of their own, on small planted data.
SLOW = {"logistic_grid", "svm_grid", "holdout_svm", "kmedoids_history", "lasso_cv"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF).toArrow(), duck.execute(ORACLES[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_foreign_keys_hold(duck):
    """The event view skips joins it does not need; that relies on complete foreign keys."""
    for child, key, parent, pk in [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ]:
        missing = duck.execute(f"SELECT COUNT(*) FROM {child} WHERE {key} NOT IN (SELECT {pk} FROM {parent})").fetchone()
        twice = duck.execute(f"SELECT COUNT(*) - COUNT(DISTINCT {pk}) FROM {parent}").fetchone()
        assert missing == (0,) and twice == (0,)


def test_event_ids_unique(spark):
    from newsquant.sources.tables import news

    ids = news(spark, SF, "event_id")
    assert ids.count() == ids.distinct().count()
