"""Ranks, cumulative sums and exact quantiles that never put a whole group in one task.

A plain window over a group sorts the group in a single task. The functions
here split each group into ordered parts, total the parts (a small table),
and finish inside the parts. The results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.hashing import key_bucket, random_key
from newsquant.session import cut_lineage

ROWS_PER_BUCKET = 20_000


def keyed_rank(df: DataFrame, by: Sequence[str], id_col: str, seed=0, rank: str = "rank") -> DataFrame:
    """1-based rank of a row inside its group by `(random key, id)`.

    The key is uniform, so a group of n rows splits into n / ROWS_PER_BUCKET
    equal key ranges; one shuffle on (group, bucket) serves the join and the window.
    """
    by = list(by)
    pos = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", id_col))
    placed = _bucketed(df, by, id_col, seed).withColumn("_pos", pos)
    return placed.withColumn(rank, (F.col("_before") + F.col("_pos")).cast("bigint")).drop(
        "_key", "_bucket", "_before", "_pos")


def keyed_first(df: DataFrame, by: Sequence[str], id_col: str, quota: str, seed=0, size: str | None = None) -> DataFrame:
    """The `quota` first rows of each group by `(random key, id)`; quota is a column.

    `size` names a column that already holds the group's row count.
    Buckets that start at or after the quota are dropped before any sort.
    """
    by = list(by)
    placed = _bucketed(df, by, id_col, seed, size).filter(F.col("_before") < F.col(quota))
    pos = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", id_col))
    cut = placed.withColumn("_pos", pos).filter(F.col("_before") + F.col("_pos") <= F.col(quota))
    return cut.drop("_key", "_bucket", "_before", "_pos")


def _bucketed(df: DataFrame, by: list[str], id_col: str, seed, size: str | None = None) -> DataFrame:
    """Add the random key, its bucket and `_before`, the number of rows in earlier buckets of the group."""
    if size is not None:
        sized = df.withColumn("_n", F.col(size))
    elif by:
        sized = df.join(df.groupBy(*by).agg(F.count("*").alias("_n")), by)
    else:
        sized = df.withColumn("_n", df.agg(F.count("*").alias("n")).scalar())
    keyed = sized.withColumn("_key", random_key(id_col, seed))
    keyed = keyed.withColumn("_bucket", key_bucket(F.col("_key"), F.ceil(F.col("_n") / ROWS_PER_BUCKET))).drop("_n")
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_count"))
    # One row per bucket.
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    return keyed.join(offsets, [*by, "_bucket"])


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int,
                  rank: str | None = None) -> DataFrame:
    """The n first rows of each group.

    Spark cuts every input partition to n rows per group before the shuffle
    (window group limit), so a hot group sends n rows per task at most.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def value_prefix(counts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Running totals over distinct values: adds `<s>_upto` (inclusive) and `<s>_all`.

    `counts` has one row per (group, value). It is range-partitioned by (group,
    value) and landed with its partition number, so a group may span any number
    of partitions; earlier partitions of a group enter by their totals.
    """
    by, sums = list(by), list(sums)
    ranged = cut_lineage(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    # One row per (group, partition).
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums],
    )
    inner = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(totals, [*by, "_part"])
    for s in sums:
        out = out.withColumn(f"{s}_upto", F.col(f"_{s}_before") + F.sum(s).over(inner))
    out = out.drop("_part", *[f"_{s}_before" for s in sums])
    out._reads = (ranged,)
    return out


def exact_quantiles(df: DataFrame, column: str, qs: dict[str, float], by: Sequence[str] = (),
                    method: str = "linear") -> DataFrame:
    """Exact quantiles, one row per group, one column per entry of `qs`.

    Values are counted first (map-side), then ranked by `value_prefix`.
    `method`: 'linear' interpolates at (n-1)q, 'hazen' at nq - 1/2, and
    'inverse_cdf' takes the value at ceil(nq).
    """
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    ranked = value_prefix(counts, by, column, ["n"])
    v, upto, total = F.col(column).cast("double"), F.col("n_upto"), F.col("n_all")
    aggs = []
    for name, q in qs.items():
        if method == "linear":
            at = (total - 1) * F.lit(float(q))
        elif method == "hazen":
            at = F.greatest(F.least(total * F.lit(float(q)) - 0.5, total - 1), F.lit(0.0))
        else:
            at = F.greatest(F.ceil(total * F.lit(float(q))) - 1, F.lit(0)).cast("double")
        low = F.min(F.when(upto > F.floor(at), v))
        high = F.min(F.when(upto > F.ceil(at), v))
        part = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*aggs)
