"""Queries that run as streams and must equal the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.news import SUMMARY_SQL, assigned_sql
from newsquant.plans.catalog.registry import query
from newsquant.schema import IMPORTANCE
from newsquant.session import cut_lineage, shared_folder
from newsquant.streaming import day_summary as ds

DELAY = 30


def _drain(spark, folder, schema, models, out, delay_days):
    events = spark.readStream.schema(schema).parquet(folder)
    writer = ds.summarise_stream(events, lambda: models, out, pl.NEWS_LAYOUT, delay_days=delay_days)
    writer.option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start().awaitTermination()


def _cleaned(spark, sf_dir):
    cleaned = cut_lineage(pl.cleaned_news(spark, sf_dir))
    return cleaned, {pl.NEWS_K: pl.news_model(cleaned)}, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_day_summary", "news", assigned_sql(pl.NEWS_K) + SUMMARY_SQL.format(k=pl.NEWS_K), f"""
SELECT pub_day, cluster_id, {', '.join(f'ROUND({m}, 8) AS {m}' for m in [*IMPORTANCE, 'share'])}, n FROM summary""")
def stream_day_summary(spark, sf_dir):
    """Day summaries from a stream of cleaned events with the model inside; no day is closed before the end."""
    cleaned, models, out = _cleaned(spark, sf_dir)
    _drain(spark, cleaned._landed_at, cleaned.schema, models, out, 100_000)
    rows = ds.streamed_summary(spark, out, None).withColumnRenamed("day", "pub_day").drop("k")
    return rows.withColumns({m: F.round(m, 8) for m in [*IMPORTANCE, "share"]})


@query("stream_late_rows", "news", assigned_sql(pl.NEWS_K) + f""",
cut AS (SELECT MAX(pub_day) - {DELAY} AS closed FROM cleaned)""", """
SELECT pub_day AS day, COUNT(*) AS rows FROM cleaned, cut WHERE order_no % 5 = 0 AND pub_day < closed GROUP BY 1""")
def stream_late_rows(spark, sf_dir):
    """Two days' worth of files: those of every fifth order arrive after the others, when most of their days are closed."""
    cleaned, models, out = _cleaned(spark, sf_dir)
    last = F.max("pub_day")
    newest, whole = cleaned.agg(F.max(F.when(F.col("order_no") % 5 != 0, F.col("pub_day"))), last).first()
    folder = f"{out}/in"
    for late in (False, True):
        part = cleaned.filter(F.col("order_no") % 5 == 0 if late else F.col("order_no") % 5 != 0)
        part.write.mode("append").parquet(folder)
        _drain(spark, folder, cleaned.schema, models, out, DELAY - (whole - newest).days)
    return ds.late_rows(spark, out).groupBy("day").agg(F.sum("rows").alias("rows"))
