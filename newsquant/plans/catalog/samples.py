"""Queries on reproducible samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.operators import dataset, sample, series
from newsquant.plans.catalog.registry import query
from newsquant.sources import tables


def key_sql(expr: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat({expr}, ':{seed}')), 1, 8) AS BIGINT)"


def _ids(spark, sf_dir):
    return tables.news(spark, sf_dir, "event_id", "pub_day")


@query("sample_equal", "news", "", f"""
SELECT pub_day, event_id FROM (SELECT pub_day, event_id, ROW_NUMBER() OVER (PARTITION BY pub_day
  ORDER BY {key_sql('event_id', 7)}, event_id) AS rn FROM news) q WHERE rn <= 5""")
def sample_equal(spark, sf_dir):
    return sample.sample_per_day(_ids(spark, sf_dir), 5, 7).select("pub_day", "event_id")


@query("sample_prop", "news", """
per_day AS (SELECT pub_day, COUNT(*) AS n_day FROM news GROUP BY 1),
quotas AS (SELECT pub_day, n_day, CAST(FLOOR(n_day * 5000 / SUM(n_day) OVER ()) AS BIGINT) AS q FROM per_day),
spare AS (SELECT *, LEAST(5000, SUM(n_day) OVER ()) - SUM(q) OVER () AS rest,
  COALESCE(SUM(n_day - q) OVER (ORDER BY pub_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM quotas),
final AS (SELECT pub_day, q + GREATEST(LEAST(n_day - q, rest - before), 0) AS quota FROM spare)""", f"""
SELECT pub_day, event_id FROM (SELECT pub_day, event_id, ROW_NUMBER() OVER (PARTITION BY pub_day
  ORDER BY {key_sql('event_id', 3)}, event_id) AS rn FROM news) r JOIN final f USING (pub_day) WHERE rn <= quota""")
def sample_prop(spark, sf_dir):
    return sample.sample_proportional(_ids(spark, sf_dir), 5000, 3).select("pub_day", "event_id")


@query("bootstrap", "news", f"""
numbered AS (SELECT event_id, ROW_NUMBER() OVER (ORDER BY {key_sql('event_id', 5)}, event_id) - 1 AS pos FROM news),
draws AS (SELECT i AS draw, {key_sql('i', 6)} % (SELECT COUNT(*) FROM news) AS target FROM range(0, 10000) t(i))""", """
SELECT draw, event_id FROM draws JOIN numbered ON pos = target""")
def bootstrap(spark, sf_dir):
    return sample.bootstrap(_ids(spark, sf_dir).select("event_id"), 10000, 5).select("draw", "event_id")


@query("holdout", "prices", "ids AS (SELECT concat(symbol, CAST(day AS VARCHAR)) AS id FROM prices)", f"""
SELECT id, CAST(draw AS INT) AS draw, CASE WHEN ROW_NUMBER() OVER (PARTITION BY draw ORDER BY
  {key_sql("concat(id, ':', draw)", 0)}, concat(id, ':', draw)) <= FLOOR((SELECT COUNT(*) FROM ids) * 0.7) THEN 'train' ELSE 'test' END AS split
FROM ids CROSS JOIN range(0, 100) t(draw)""")
def holdout(spark, sf_dir):
    ids = tables.prices(spark, sf_dir).select(F.concat("symbol", F.col("day").cast("string")).alias("id"))
    return sample.repeated_holdout(ids, 0.7, 100, 0, "id")


@query("splits", "prices", """
numbered AS (SELECT symbol, day, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY symbol) AS n,
  CAST(price > LAG(price) OVER w AS INT) AS up FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day))""", """
SELECT symbol, day, CASE WHEN pos < FLOOR(n * 0.6) THEN 'train' WHEN pos < FLOOR(n * 0.8) THEN 'valid' ELSE 'test' END AS split
FROM numbered""")
def splits(spark, sf_dir):
    return dataset.split_ratio(tables.prices(spark, sf_dir)).select("symbol", "day", "split")


@query("class_balance", "prices", """
numbered AS (SELECT symbol, day, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY symbol) AS n,
  COALESCE(CAST(price > LAG(price) OVER w AS INT), 0) AS up FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day)),
named AS (SELECT symbol, up, CASE WHEN pos < FLOOR(n * 0.6) THEN 'train' WHEN pos < FLOOR(n * 0.8) THEN 'valid' ELSE 'test' END AS split
  FROM numbered)""", """
SELECT symbol, split, COUNT(*) AS n, CAST(SUM(up) AS BIGINT) AS positives, ROUND(AVG(up), 8) AS fraction FROM named GROUP BY 1, 2""")
def class_balance(spark, sf_dir):
    labelled = series.up_label(dataset.split_ratio(tables.prices(spark, sf_dir)), 0)
    out = dataset.class_balance(labelled, "up", ["symbol", "split"])
    return out.withColumn("fraction", F.round("fraction", 8))


@query("date_splits", "prices", "", """
SELECT symbol, CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
  WHEN day BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'valid' ELSE 'test' END AS split, COUNT(*) AS n
FROM prices WHERE day BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY 1, 2""")
def date_splits(spark, sf_dir):
    ranges = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
    named = dataset.split_dates(tables.prices(spark, sf_dir), ranges)
    return named.groupBy("symbol", "split").agg(F.count("*").alias("n"))
