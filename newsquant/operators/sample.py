"""Reproducible samples, keyed by a hash of the row id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.hashing import key_bucket, random_key
from newsquant.operators.nearest import freeze, once
from newsquant.operators.ranking import ROWS_PER_BUCKET, keyed_first, top_per_group

#: Rows of the key range that is put in order to find a cut.
CUT_ROWS = 2_000


def sample_per_day(df: DataFrame, n: int, seed: int = 0, day: str = "pub_day", id_col: str = "event_id") -> DataFrame:
    """Equal allocation: n random rows of every day.

    Small n is cut before the shuffle; for large n only the bucket that the
    limit cuts is ranked.
    """
    if n < 1000:
        return top_per_group(df, [day], [random_key(id_col, seed), F.col(id_col)], n)
    return keyed_first(df.withColumn("_quota", F.lit(n)), [day], id_col, "_quota", seed).drop("_quota")


def sample_proportional(df: DataFrame, n: int, seed: int = 0, day: str = "pub_day", id_col: str = "event_id") -> DataFrame:
    """Proportional allocation: `floor(n_day / total * n)` per day, the remainder from the first days.

    The remainder goes one by one to the days in order, without duplicates.
    """
    per_day = df.groupBy(day).agg(F.count("*").alias("n_day"))
    total = F.sum("n_day").over(Window.partitionBy())  # one row per day
    quota = F.floor(F.col("n_day") * F.lit(n) / total)
    quotas = per_day.withColumn("_floor", quota).withColumn("_spare", F.col("n_day") - F.col("_floor"))
    left = F.least(F.lit(n), total) - F.sum("_floor").over(Window.partitionBy())
    before = F.coalesce(
        F.sum("_spare").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    extra = F.greatest(F.least(F.col("_spare"), left - before), F.lit(0))
    quotas = quotas.select(day, "n_day", (F.col("_floor") + extra).alias("_quota")).filter(F.col("_quota") > 0)
    return keyed_first(df.join(quotas, day), [day], id_col, "_quota", seed, "n_day").drop("_quota", "n_day")


def bootstrap(df: DataFrame, n: int, seed: int = 0, id_col: str = "event_id") -> DataFrame:
    """n draws with replacement, `(draw, row...)`.

    Draw i takes the row whose position in key order is `hash(i) mod N`. Rows
    are counted by key range; each drawn position is led to its range by the
    counts before it, and only rows of ranges that were drawn are put in order.
    """
    total = df.count()
    keyed = df.withColumn("_key", random_key(id_col, seed))
    keyed = keyed.withColumn("_bucket", key_bucket(F.col("_key"), F.lit(max(1, -(-total // ROWS_PER_BUCKET)))))
    counts = sorted((r["_bucket"], r["n"]) for r in keyed.groupBy("_bucket").agg(F.count("*").alias("n")).collect())  # one row per range
    buckets, before = np.array([b for b, _ in counts], dtype=np.int32), np.cumsum([0, *(c for _, c in counts)])

    @F.pandas_udf("bucket int, pos bigint")
    def routed(ranks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for r in ranks:
            at = np.searchsorted(before, r.to_numpy(), side="right") - 1
            yield pd.DataFrame({"bucket": buckets[at], "pos": r.to_numpy() - before[at] + 1})

    if not total:
        return keyed.select(F.lit(0).cast("bigint").alias("draw"), *df.columns)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (random_key("id", seed + 1) % total).alias("_rank"))
    draws = draws.select("draw", once(routed)("_rank").alias("r")).select("draw", F.col("r.bucket").alias("_bucket"), F.col("r.pos").alias("_pos"))
    touched = keyed.join(draws.select("_bucket").distinct(), "_bucket", "left_semi")
    pos = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col)).cast("bigint")
    return draws.join(touched.withColumn("_pos", pos), ["_bucket", "_pos"]).select("draw", *df.columns)


def _many(df: DataFrame, times: int, seed: int, id_col: str) -> DataFrame:
    """Every row once per draw, with `_id` and its uniform `_key` in that draw."""
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    many = many.withColumn("_id", F.concat_ws(":", F.col(id_col).cast("string"), F.col("draw").cast("string")))
    return many.withColumn("_key", random_key("_id", seed))


def holdout_cuts(df: DataFrame, frac: float, times: int, seed: int = 0, id_col: str = "event_id") -> DataFrame:
    """`(draw, cut)`: key and id of each draw's last training row, one row a draw.

    Keys are counted by equal ranges where the rows lie; only the one range
    that holds a draw's cut is put in order.
    """
    total = df.count()
    wanted = int(total * frac)
    keyed = _many(df.select(id_col), times, seed, id_col)
    keyed = keyed.withColumn("_bucket", key_bucket(F.col("_key"), F.lit(max(1, -(-total // CUT_ROWS)))))
    upto = Window.partitionBy("draw").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # one row per range
    counts = keyed.groupBy("draw", "_bucket").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    held = counts.filter((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted))
    inside = keyed.join(held.select("draw", "_bucket", (F.lit(wanted) - F.col("_upto") + F.col("_n")).alias("_at")), ["draw", "_bucket"])
    place = F.row_number().over(Window.partitionBy("draw").orderBy("_key", "_id"))
    return inside.withColumn("_place", place).filter("_place = _at").select("draw", F.struct("_key", "_id").alias("cut"))


def repeated_holdout(df: DataFrame, frac: float = 0.7, times: int = 100, seed: int = 0,
                     id_col: str = "event_id") -> DataFrame:
    """`times` random splits: adds `draw` and `split` ('train' for the first floor(frac * N) by hash).

    The cut of every draw is found first, so the rows themselves are neither ranked nor moved.
    """
    cuts = freeze(holdout_cuts(df, frac, times, seed, id_col))
    split = F.when(F.struct("_key", "_id") <= F.col("cut"), "train").otherwise("test")
    return _many(df, times, seed, id_col).join(cuts, "draw", "left").withColumn("split", split).select(*df.columns, "draw", "split")
