"""Exploration of actor sparsity and value distributions; returns data, draws nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsquant.operators.ranking import exact_quantiles, top_per_group


def actor_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Events per ordered actor pair; the one shuffle behind the per-actor counts."""
    both = df.filter((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != ""))
    return both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _directions(pairs: DataFrame) -> DataFrame:
    sides = F.explode(F.array(
        F.struct(F.lit("1to2").alias("direction"), F.col("a").alias("actor")),
        F.struct(F.lit("2to1").alias("direction"), F.col("b").alias("actor")),
    ))
    return pairs.select(sides.alias("s"), "n", "a", "b").select("s.*", "n", "a", "b")


def co_actors(df: DataFrame, a: str, b: str, approx: bool = False) -> DataFrame:
    """Distinct partners per actor, both directions: `(direction, actor, n_co_actors)`.

    Pairs are made distinct first, so a hot actor is counted from partial sums.
    `approx` uses a sketch and skips the pair shuffle.
    """
    if approx:
        raw = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(1).alias("n"))
        other = F.when(F.col("direction") == "1to2", F.col("b")).otherwise(F.col("a"))
        return _directions(raw).groupBy("direction", "actor").agg(F.approx_count_distinct(other).alias("n_co_actors"))
    return _directions(actor_pairs(df, a, b)).groupBy("direction", "actor").agg(F.count("*").alias("n_co_actors"))


def events_per_actor(df: DataFrame, a: str, b: str, distinct: str | None = None) -> DataFrame:
    """Events per actor, both directions; `distinct` counts distinct values of a column instead."""
    if distinct is None:
        return _directions(actor_pairs(df, a, b)).groupBy("direction", "actor").agg(F.sum("n").alias("n_events"))
    sides = F.explode(F.array(
        F.struct(F.lit("1to2").alias("direction"), F.col(a).alias("actor")),
        F.struct(F.lit("2to1").alias("direction"), F.col(b).alias("actor")),
    ))
    pairs = df.select(sides.alias("s"), distinct).select("s.*", distinct).filter(F.coalesce("actor", F.lit("")) != "")
    return pairs.distinct().groupBy("direction", "actor").agg(F.count(distinct).alias("n_events"))


def five_number(df: DataFrame, column: str, by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Exact min, quartiles and max."""
    qs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return exact_quantiles(df, column, qs, by, method)


def histogram(df: DataFrame, column: str, width: float, lo: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bin, `bin` is the lower edge's index."""
    bins = F.floor((F.col(column) - F.lit(lo)) / F.lit(width))
    return df.filter(F.col(column).isNotNull()).groupBy(*by, bins.alias("bin")).agg(F.count("*").alias("n"))


def box_outliers(df: DataFrame, column: str, by: Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than `reach` interquartile ranges."""
    quartiles = exact_quantiles(df, column, {"q1": 0.25, "q3": 0.75}, by)
    span = F.col("q3") - F.col("q1")
    if by:
        joined = df.join(quartiles, list(by))
    else:
        q = quartiles.select(F.struct("q1", "q3")).scalar()
        joined = df.withColumns({"q1": q.getField("q1"), "q3": q.getField("q3")})
    c = F.col(column)
    return joined.filter((c < F.col("q1") - reach * span) | (c > F.col("q3") + reach * span)).drop("q1", "q3")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the intersection over the size of the union of two row sets.

    One aggregation instead of separate intersect and union jobs.
    """
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    keys = [c for c in both.columns if c != "_side"]
    marked = both.groupBy(*keys).agg(F.min("_side").alias("lo"), F.max("_side").alias("hi"))
    return marked.agg(
        F.count_if(F.col("lo") != F.col("hi")).alias("n_both"), F.count("*").alias("n_any"),
    ).withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_any")))


def freq_band(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rows with `lo <= value < hi`."""
    if lo is not None:
        df = df.filter(F.col(column) >= lo)
    if hi is not None:
        df = df.filter(F.col(column) < hi)
    return df


def top_k(df: DataFrame, order: str, k: int, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest k values, ties by `tie`."""
    keys = [F.desc(order), F.col(tie)]
    return top_per_group(df, by, keys, k) if by else df.orderBy(*keys).limit(k)


def trim_quantile(df: DataFrame, column: str, q: float, method: str = "linear") -> DataFrame:
    """Rows below the q-quantile of the column."""
    cut = exact_quantiles(df, column, {"cut": q}, method=method).scalar()
    return df.filter(F.col(column) < cut)
