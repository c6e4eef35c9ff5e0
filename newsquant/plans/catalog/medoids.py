"""Queries on k-medoids under the mixed distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.functions.distance import MINI_CATEGORY, MINI_NUMERIC
from newsquant.operators import medoids, nearest
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.news import DOMAIN_SQL, seeds_sql
from newsquant.plans.catalog.registry import query
from newsquant.session import cut_lineage

K = 6

MINI_SQL = DOMAIN_SQL + """,
mini AS (SELECT event_id, order_no, CAST(sqldate - DATE '1970-01-01' AS INT) AS day_no, event_code,
  CAST(quad_class AS VARCHAR) AS quad_class, goldstein, actor1_name, actor2_name, is_root, num_mentions, num_sources,
  num_articles, avg_tone, CAST(actor1_geo_type AS VARCHAR) AS actor1_geo, CAST(actor2_geo_type AS VARCHAR) AS actor2_geo,
  domain FROM news LEFT JOIN domains USING (page_id)),""" + seeds_sql(K, "mini") + """,
centres AS (SELECT s.i, m.* FROM seeds s JOIN mini m USING (event_id))"""

_RHO = " + ".join(
    [f"ABS(x.{c} - y.{c})" for c in MINI_NUMERIC]
    + [f"CASE WHEN x.{c} = y.{c} THEN 0 ELSE 1 END" for c in MINI_CATEGORY]
)
ASSIGN_SQL = MINI_SQL + f""",
near AS (SELECT event_id, MIN(ROW(d, i)) AS r FROM (
  SELECT x.event_id, y.i, ROUND({_RHO}, 9) AS d FROM mini x CROSS JOIN centres y) q GROUP BY 1),
assigned AS (SELECT m.*, r[2] AS cluster_id, r[1] AS dist FROM mini m JOIN near USING (event_id))"""


def _costs_sql() -> str:
    """Cost per member from window sums below and above each value, and from frequencies."""
    terms = []
    for c in MINI_NUMERIC:
        low = f"(PARTITION BY cluster_id ORDER BY {c})"
        whole = "(PARTITION BY cluster_id)"
        terms.append(
            f"(CAST({c} AS DOUBLE) * COUNT(*) OVER {low} - SUM(CAST({c} AS DOUBLE)) OVER {low} + SUM(CAST({c} AS DOUBLE)) OVER {whole}"
            f" - SUM(CAST({c} AS DOUBLE)) OVER {low} - CAST({c} AS DOUBLE) * (COUNT(*) OVER {whole} - COUNT(*) OVER {low}))"
        )
    for c in MINI_CATEGORY:
        terms.append(f"(COUNT(*) OVER (PARTITION BY cluster_id) - CASE WHEN {c} IS NULL THEN 0 ELSE "
                     f"COUNT(*) OVER (PARTITION BY cluster_id, {c}) END)")
    return f"costs AS (SELECT event_id, cluster_id, ROUND({' + '.join(terms)}, 3) AS cost FROM assigned)"


def assigned(spark, sf_dir):
    events = cut_lineage(pl.mini_news(spark, sf_dir))
    return nearest.assign_mixed(events, medoids.seed_medoids(events, K, "order_no"))


@query("kmedoid_assign", "news", ASSIGN_SQL, "SELECT event_id, cluster_id, ROUND(dist, 6) AS dist FROM assigned")
def kmedoid_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("event_id", "cluster_id", F.round("dist", 6).alias("dist"))


@query("medoid_cost", "news", ASSIGN_SQL + ",\n" + _costs_sql(), "SELECT event_id, cluster_id, cost FROM costs")
def medoid_cost(spark, sf_dir):
    return medoids.medoid_costs(assigned(spark, sf_dir)).select("event_id", "cluster_id", F.round("cost", 3).alias("cost"))


@query("medoid_step", "news", ASSIGN_SQL + ",\n" + _costs_sql(), """
SELECT cluster_id, MIN(ROW(cost, event_id))[2] AS medoid_id, MIN(cost) AS total, COUNT(*) AS size FROM costs GROUP BY 1""")
def medoid_step(spark, sf_dir):
    return medoids.medoid_step(assigned(spark, sf_dir)).select(
        "cluster_id", F.col("event_id").alias("medoid_id"), F.round("total", 3).alias("total"), "size"
    )


@query("kmedoids_history")
def kmedoids_history(spark, sf_dir):
    return medoids.kmedoids(pl.mini_news(spark, sf_dir), K, "order_no")[1]
