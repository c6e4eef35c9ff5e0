"""Keyed loads: upsert, key-range scan, uniform seed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_key(lines: DataFrame, column: str = "value") -> DataFrame:
    """`key` is the text before the first tab, `rest` the remainder.

    A line without a tab or with an empty key gets a NULL key.
    """
    c = F.col(column)
    key = F.when(F.contains(c, F.lit("\t")), F.substring_index(c, "\t", 1))
    return lines.withColumn("key", F.when(key != "", key)).withColumn(
        "rest", F.when(F.col("key").isNotNull(), F.expr(f"substring(`{column}`, length(key) + 2)"))
    )


def rejected(keyed: DataFrame, key: str = "key") -> DataFrame:
    return keyed.filter(F.col(key).isNull())


def upsert_events(df: DataFrame, key: str = "key", order: list[str] | None = None,
                  values: list[str] | None = None) -> DataFrame:
    """Last write wins per key; rows without a key are left out.

    `max_by` combines map-side, so a key written a billion times costs one
    row per task in the shuffle.
    """
    order = order or ["load_seq"]
    values = values or [c for c in df.columns if c != key and c not in order]
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(latest).select(key, "v.*")


def scan_range(df: DataFrame, lo=None, hi=None, key: str = "key", as_text: bool = False) -> DataFrame:
    """Rows with `lo <= key <= hi`; open ends by default.

    `as_text` compares keys as strings; the default compares them in their own type.
    """
    c = F.col(key).cast("string") if as_text else F.col(key)
    cast = (lambda v: F.lit(str(v))) if as_text else F.lit
    if lo is not None:
        df = df.filter(c >= cast(lo))
    if hi is not None:
        df = df.filter(c <= cast(hi))
    return df


def uniform_keys(df: DataFrame, k: int, order: str, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """K seeds spread evenly over the key range: `(i, id_col, carry...)`.

    Target i is `lo + i * floor((hi - lo) / k)`; its seed is the row with the
    smallest `(order, id)` at or after the target, which is the smallest row
    of the first non-empty stride from i on. The strides are reduced to their
    smallest order value first (numbers only, map-side); the rows themselves
    are fetched by a semi join on at most k values.
    """
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    span = span.select(F.struct("lo", F.greatest(F.floor((F.col("hi") - F.col("lo")) / k), F.lit(1)).alias("step")))
    s = span.scalar()
    lo, step = s.getField("lo"), s.getField("step")
    stride = F.least(F.floor((F.col(order) - lo) / step), F.lit(k - 1)).cast("int")
    firsts = df.filter(F.col(order).isNotNull()).groupBy(stride.alias("i")).agg(F.min(order).alias("_first"))
    # At most k rows: each stride's first value also serves the empty strides before it.
    previous = F.lag("i", 1, -1).over(Window.orderBy("i"))
    seeds = firsts.withColumn("previous", previous).select(
        F.explode(F.sequence(F.col("previous") + 1, F.col("i"))).alias("i"), "_first"
    )
    rows = df.select(F.col(order).alias("_order"), id_col, *carry).join(
        F.broadcast(firsts.select(F.col("_first").alias("_order"))), "_order", "left_semi"  # k rows at most
    )
    picked = rows.groupBy(F.col("_order").alias("_first")).agg(
        *[F.min_by(c, F.col(id_col)).alias(c) for c in (id_col, *carry)]
    )
    return seeds.join(picked, "_first").select("i", id_col, *carry)
