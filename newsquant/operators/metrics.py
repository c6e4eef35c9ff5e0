"""Scores of predictions and tables of runs, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1, precision, recall, support-weighted recall and average precision of 0/1 predictions.

    Average precision on hard predictions is recall x precision + (1 - recall) x prevalence.
    """
    t, p = F.col(y), F.col(yhat)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
    )
    tp, n = F.col("tp").cast("double"), F.col("n").cast("double")
    scored = counts.withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / n,
        "precision": F.coalesce(F.try_divide(tp, F.col("tp") + F.col("fp")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, F.col("tp") + F.col("fn")), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)),
    })
    ap = F.col("recall") * F.col("precision") + (1 - F.col("recall")) * (F.col("tp") + F.col("fn")) / n
    return scored.withColumns({"recall_w": F.col("accuracy"), "ap": ap})


def cutoff_metrics(df: DataFrame, y: str, probability: str, cutoffs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
                   invert: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of `P(class 1) > cutoff` per cut-off; `invert` thresholds P(class 0) instead."""
    p = 1 - F.col(probability) if invert else F.col(probability)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("cutoff"), (p > c).cast("int").alias("_yhat")) for c in cutoffs
    ])).alias("c")
    scored = df.select(*by, y, rows).select(*by, y, "c.*")
    return classification_metrics(scored, y, "_yhat", [*by, "cutoff"])


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, R2 (may be negative) and sign accuracy."""
    t, p = F.col(y), F.col(yhat)
    sums = df.filter(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(t - p)).alias("mae"), F.sum((t - p) * (t - p)).alias("_sse"),
        (F.var_pop(y) * F.count("*")).alias("_sst"), F.avg(((t > 0) == (p > 0)).cast("double")).alias("sign_accuracy"),
    )
    return sums.withColumn("r2", 1 - F.try_divide("_sse", "_sst")).drop("_sse", "_sst")


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"))


def improvement(full: DataFrame, baseline: DataFrame, on: Sequence[str], score: str = "test_r2") -> DataFrame:
    """Full-model score minus the baseline's."""
    base = baseline.select(*on, F.col(score).alias(f"baseline_{score}"))
    return full.join(base, list(on)).withColumn("improvement", F.col(score) - F.col(f"baseline_{score}"))


def rank_results(df: DataFrame, metric: str, ties: Sequence[str]) -> DataFrame:
    """Results sorted by the metric, best first."""
    return df.orderBy(F.desc_nulls_last(metric), *ties)


def best_params(df: DataFrame, metric: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Row with the best metric; on a tie the first in grid order wins."""
    names = [c for c in df.columns if c not in by]
    key = F.struct(F.col(metric), -F.col(order))
    best = df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*names), key).alias("b"))
    return best.select(*by, *[F.col("b").getField(c).alias(c) for c in names])


def error_by_k(runs: DataFrame) -> DataFrame:
    """Mean and population std of train and test error per K, and the best test error of each K."""
    return runs.groupBy("k").agg(
        F.avg("train_error").alias("train_mean"), F.stddev_pop("train_error").alias("train_std"),
        F.avg("test_error").alias("test_mean"), F.stddev_pop("test_error").alias("test_std"),
        F.min("test_error").alias("best"), F.count("*").alias("n"),
    )
