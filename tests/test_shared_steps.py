"""Steps that many news queries share: page domains, joins of the event view, day impact, medoid costs."""

from newsquant.operators import impact, medoids
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.explore import COUNTRIES, TYPES1, TYPES2, _impact_input
from newsquant.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_domains_are_made_per_page_not_per_event(spark):
    """The suffix rules stand below the join with the pages."""
    text = plan(pl.mini_news(spark, SF))
    join = next(i for i, line in enumerate(text.splitlines()) if "LeftOuter" in line)
    rules = [i for i, line in enumerate(text.splitlines()) if "regexp_extract(url" in line]
    assert rules and min(rules) > join


def test_lineitem_is_joined_to_the_orders_after_the_customers(spark):
    text = plan(tables.news(spark, SF, "sqldate", "actor2_name")).splitlines()
    depth = {name: next(line.index("Join") for line in text if "Join" in line and name in line) for name in ("o_custkey", "o_orderkey")}
    assert depth["o_custkey"] > depth["o_orderkey"]


def test_impact_reads_the_events_once(spark):
    cells = impact.impact_cells(_impact_input(spark, SF), COUNTRIES, "h3", TYPES1, TYPES2)
    assert plan(cells).count("l_linestatus#") and sum("lineitem" in line or "Relation [l_orderkey" in line for line in plan(cells).splitlines()) == 1


def test_joined_costs_keep_an_event_in_one_row(spark, monkeypatch):
    """No row per (event, column) is grouped by the event's id."""
    monkeypatch.setattr(medoids, "MAX_CELLS", 0)
    df = spark.createDataFrame([("a", 0, 1.0, None), ("b", 0, 3.0, "x"), ("c", 0, -0.0, "x"), ("d", 1, 0.0, "x")],
                               "event_id string, cluster_id int, v double, w string")
    out = medoids.medoid_costs(df, ["v"], ["w"])
    assert "Generate" not in plan(out)
    assert {r.event_id: r.cost for r in out.collect()} == {"a": 6.0, "b": 6.0, "c": 5.0, "d": 0.0}
