"""Day summaries of clustered events, shares and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsquant.schema import IMPORTANCE

TOTAL = -1


def day_summary(assigned: DataFrame, k: int | str, zero_fill: bool = True, day: str = "pub_day",
                measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Per day and cluster: sum of each importance measure and the event count, over the day's events N.

    Rows `(day, cluster_id, measures..., share, n)`; `cluster_id` -1 is the
    whole day. `k` is the cluster count, or the name of a column with it: then
    several models are summarised side by side and the column is kept. One
    shuffle of partial sums on (k, day, cluster); totals, N and zero rows come
    from that small result.
    """
    keys = [day] if isinstance(k, int) else [k, day]
    sums = [F.sum(F.col(m).cast("double")).alias(m) for m in measures]
    cells = assigned.groupBy(*keys, "cluster_id").agg(*sums, F.count("*").alias("events"))
    return summarise_cells(cells, k, zero_fill, day, measures)


def summarise_cells(cells: DataFrame, k: int | str, zero_fill: bool = True, day: str = "pub_day",
                    measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """`day_summary` from finished sums and `events` per (day, cluster)."""
    keys = [day] if isinstance(k, int) else [k, day]
    count = F.lit(k) if isinstance(k, int) else F.col(k)
    # One array per day (at most K cells) gives the total and the empty clusters without a join.
    values = F.struct(*measures, "events")
    listed = F.collect_list(F.struct(F.col("cluster_id").alias("id"), values.alias("v"))).alias("cells")
    whole = F.struct(*[F.sum(m).alias(m) for m in measures], F.sum("events").alias("events"))
    days = cells.groupBy(*keys).agg(listed, whole.alias("whole"))
    blocks = [F.col("cells"), F.array(F.struct(F.lit(TOTAL).alias("id"), F.col("whole").alias("v")))]
    if zero_fill:
        zero = F.struct(*[F.lit(0.0).alias(m) for m in measures], F.lit(0).cast("bigint").alias("events"))
        absent = F.array_except(F.sequence(F.lit(0), (count - 1).cast("int")), F.transform("cells", lambda c: c["id"]))
        blocks.append(F.transform(absent, lambda i: F.struct(i.alias("id"), zero.alias("v"))))
    rows = days.select(*keys, F.col("whole.events").alias("n"), F.explode(F.concat(*blocks)).alias("c"))
    return rows.select(
        *keys, F.col("c.id").alias("cluster_id"), *[(F.col(f"c.v.{m}") / F.col("n")).alias(m) for m in measures],
        (F.col("c.v.events") / F.col("n")).alias("share"), "n",
    )


def flatten_summary(summary: DataFrame, k: int | str, day: str = "pub_day",
                    measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Export form: one array per day, index `cluster * 8 + measure`, block k is the total, N last."""
    keys = [day] if isinstance(k, int) else [k, day]
    block = F.when(F.col("cluster_id") == TOTAL, F.lit(k) if isinstance(k, int) else F.col(k)).otherwise(F.col("cluster_id"))
    values = F.array(*[F.col(m) for m in measures], F.col("share"))
    blocks = F.array_sort(F.collect_list(F.struct(block.alias("b"), values.alias("v"))))
    flat = F.flatten(F.transform(blocks, lambda x: x["v"]))
    return summary.groupBy(*keys).agg(F.concat(flat, F.array(F.max("n").cast("double"))).alias("vector"))


def tiny_cells(summary: DataFrame, eps: float = 5e-8, day: str = "pub_day",
               measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Cells of the day vector below `eps` (negative ones included)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in [*measures, "share"]
    ])).alias("c")
    return summary.select(day, "cluster_id", cells).select(day, "cluster_id", "c.*").filter(F.col("value") < eps)


def wide_summary(summary: DataFrame, ids: Sequence[int], day: str = "pub_day",
                 measures: Sequence[str] = ("share",)) -> DataFrame:
    """One column per (measure, cluster), named `<measure>_<id>` (`total` for -1)."""
    name = {i: "total" if i == TOTAL else str(i) for i in ids}
    aggs = [
        F.max(F.when(F.col("cluster_id") == i, F.col(m))).alias(f"{m}_{name[i]}") for i in ids for m in measures
    ]
    return summary.groupBy(day).agg(*aggs)


def calendar(spark, start: str, end: str) -> DataFrame:
    """Every day of `[start, end)`."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    return spark.range(1).select(F.explode(days).alias("day"))


def event_counts(df: DataFrame, start: str, end: str, day: str = "sqldate") -> DataFrame:
    """Events per date of `[start, end)`, zero for empty dates."""
    counts = df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    return calendar(df.sparkSession, start, end).join(counts, "day", "left").fillna(0, ["n"])


def cluster_share(assigned: DataFrame, day: str = "pub_day") -> DataFrame:
    """Share of each cluster in its day; counted first, then divided inside the small day table."""
    cells = assigned.groupBy(day, "cluster_id").agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(day)))
