"""Joining news with prices, and splitting samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.events import band_label


def join_features(news_daily: DataFrame, price_features: DataFrame, how: str = "inner", on: str = "day") -> DataFrame:
    """News of a day beside the price features of the day.

    'inner' keeps trading days with news; 'left' keeps every news day.
    Both sides hold one row per day (and symbol), so no key is hot.
    """
    return news_daily.join(price_features, on, how)


def restrict_days(df: DataFrame, days: DataFrame, on: str = "day") -> DataFrame:
    """Rows whose day occurs in `days`."""
    return df.join(days.select(on).distinct(), on, "left_semi")


def join_price(forecasts: DataFrame, prices: DataFrame, how: str = "left",
               on: Sequence[str] = ("symbol", "day")) -> DataFrame:
    return forecasts.join(prices, list(on), how)


def merge_returns(returns: DataFrame, news_daily: DataFrame, on: str = "day", ret: str = "ret",
                  threshold: float = 0.005) -> DataFrame:
    """Full outer merge on the day, then only rows with a return; `class` marks the band."""
    merged = returns.join(news_daily, on, "full_outer").filter(F.col(ret).isNotNull())
    return merged.withColumn("class", band_label(ret, threshold))


def bind_states(shares: DataFrame, states: DataFrame, on: str = "day") -> DataFrame:
    return shares.join(states, on)


def param_grid(spark, **lists: Sequence) -> DataFrame:
    """All combinations of a few short parameter lists."""
    out = spark.range(1).select()
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def split_ratio(df: DataFrame, ratios: Sequence[float] = (60.0, 20.0, 20.0), key: str = "symbol",
                day: str = "day") -> DataFrame:
    """Chronological split by row position; cut points are truncated."""
    total = float(sum(ratios))
    n = F.count("*").over(Window.partitionBy(key))
    position = F.row_number().over(Window.partitionBy(key).orderBy(day)) - 1
    first = F.floor(n * F.lit(ratios[0]) / F.lit(total))
    second = F.floor(n * F.lit(ratios[0] + ratios[1]) / F.lit(total))
    name = F.when(position < first, "train").when(position < second, "valid").otherwise("test")
    return df.withColumn("split", name)


def split_dates(df: DataFrame, ranges: dict[str, tuple[str, str]], day: str = "day") -> DataFrame:
    """Named inclusive date ranges; the first range that holds the day wins, rows outside all are dropped."""
    name = F.lit(None).cast("string")
    for label, (lo, hi) in reversed(list(ranges.items())):
        name = F.when(F.col(day).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), label).otherwise(name)
    return df.withColumn("split", name).filter(F.col("split").isNotNull())


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(F.col(label).cast("double")).alias("fraction")
    )


def walk_forward_ols(df: DataFrame, x: str, y: str, window: int, step: int = 1, key: str = "symbol",
                     day: str = "day") -> DataFrame:
    """Sliding-window regression of y on x with a one-step forecast.

    Row t is predicted from the coefficients of rows t-window..t-1:
    `(key, day, pred, actual)`. The sums of the sliding frame are enough, so no
    window is copied; `step` > 1 keeps every step-th origin.
    """
    order = Window.partitionBy(key).orderBy(day)
    frame = order.rowsBetween(-window, -1)
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.regr_slope(y, x).over(frame)
    intercept = F.regr_intercept(y, x).over(frame)
    out = pairs.select(
        key, day, F.col(y).alias("actual"), (intercept + slope * F.col(x)).alias("pred"),
        F.count(y).over(frame).alias("_n"), (F.row_number().over(order) - 1).alias("_at"),
    )
    return out.filter((F.col("_n") == window) & ((F.col("_at") - window) % step == 0)).select(key, day, "pred", "actual")
