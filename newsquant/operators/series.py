"""Windows over price series.

A series has one row per symbol and calendar day, so a window partition holds
at most the days of the calendar; symbols run in parallel. All functions order
by day themselves and need no sorted input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.lookup import scan


def by_day(key: str = "symbol", day: str = "day"):
    return Window.partitionBy(key).orderBy(day)


def rolling_mean(df: DataFrame, windows: Sequence[int] = (5, 10, 30), value: str = "price", key: str = "symbol",
                 day: str = "day") -> DataFrame:
    """Mean of the last n rows as `ma<n>`, NULL until n values are there."""
    out = {}
    for n in windows:
        w = by_day(key, day).rowsBetween(-(n - 1), 0)
        out[f"ma{n}"] = F.when(F.count(value).over(w) == n, F.avg(value).over(w))
    return df.withColumns(out)


def diff(df: DataFrame, value: str = "price", out: str = "diff", key: str = "symbol", day: str = "day") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(by_day(key, day)))


def up_label(df: DataFrame, horizon: int = 1, value: str = "price", out: str = "up", key: str = "symbol",
             day: str = "day") -> DataFrame:
    """1 if the price rises. Horizon 0: against the previous row, first row 0.

    Horizon h > 0: the row h ahead against this one, NULL at the end.
    """
    w = by_day(key, day)
    if horizon == 0:
        label = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(False))
    else:
        label = F.lead(value, horizon).over(w) > F.col(value)
    return df.withColumn(out, label.cast("int"))


def scaled_log_return(df: DataFrame, scale: float = 1e6, value: str = "price", out: str = "scaled_log_ret",
                      key: str = "symbol", day: str = "day") -> DataFrame:
    """Difference of the truncated integers `scale * ln(price)`."""
    level = (F.lit(float(scale)) * F.ln(value)).cast("bigint")
    return df.withColumn("_level", level).withColumn(
        out, F.col("_level") - F.lag("_level").over(by_day(key, day))
    ).drop("_level")


def simple_ret(df: DataFrame, value: str = "price", out: str = "ret", key: str = "symbol", day: str = "day") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value), F.lag(value).over(by_day(key, day))) - 1)


def log_ret(df: DataFrame, value: str = "price", out: str = "log_ret", key: str = "symbol", day: str = "day") -> DataFrame:
    return df.withColumn(out, F.ln(value) - F.ln(F.lag(value).over(by_day(key, day))))


def lag_matrix(df: DataFrame, column: str, lags: Sequence[int] = (1, 2, 14, 20, 21), key: str = "symbol",
               day: str = "day", prefix: str | None = None) -> DataFrame:
    """Lagged copies `<prefix><lag>`, all over one sort."""
    name = prefix if prefix is not None else "lag"
    return df.withColumns({f"{name}{n}": F.lag(column, n).over(by_day(key, day)) for n in lags})


def ema(df: DataFrame, n: int = 14, backfill: bool = True, value: str = "price", key: str = "symbol",
        day: str = "day") -> DataFrame:
    """Exponential mean `ema` seeded by the mean of the first n rows, and `ret_ema`.

    With `backfill` the first n rows take the value of row n+1. `ret_ema` is
    the difference of the logs, 0 on the first row. A missing value leaves the
    mean as it is. The recursion is a fold over each symbol's days as one array.
    """
    rest = [c for c in df.columns if c != key]
    whole = F.sort_array(F.collect_list(F.struct(day, *[c for c in rest if c != day]))).alias("_days")
    rows = df.groupBy(key).agg(whole).withColumn("_x", F.transform("_days", lambda d: d[value].cast("double")))
    head = F.filter(F.slice("_x", F.lit(1), F.lit(n)), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(head, F.lit(0.0), lambda a, x: a + x), F.size(head))
    alpha = 2 / (n + 1)
    later = F.slice("_x", F.lit(n + 1), F.greatest(F.size("_x") - n, F.lit(0)))
    path = scan(later, F.struct(F.col("_seed").alias("e")), lambda s, x: F.struct(F.coalesce((1 - alpha) * s["e"] + alpha * x, s["e"]).alias("e")),
                lambda s: s["e"], "double")
    rows = rows.withColumn("_seed", F.when(F.size("_x") >= n, mean)).withColumn("_path", path)
    first = F.array_repeat(F.get("_path", F.lit(0)), n) if backfill else F.concat(F.array_repeat(F.lit(None).cast("double"), n - 1), F.array("_seed"))
    means = F.slice(F.concat(first, "_path"), F.lit(1), F.size("_days"))
    each = rows.select(key, F.explode(F.arrays_zip(F.col("_days").alias("d"), means.alias("ema"))).alias("_r"))
    out = each.select(key, *[F.col(f"_r.d.{c}").alias(c) for c in rest], F.col("_r.ema").alias("ema")).select(*df.columns, "ema")
    w = by_day(key, day)
    step = F.ln("ema") - F.ln(F.lag("ema").over(w))
    return out.withColumn("ret_ema", F.when(F.row_number().over(w) == 1, 0.0).otherwise(step))


def acf(df: DataFrame, max_lag: int, value: str = "price", key: str = "symbol", day: str = "day") -> DataFrame:
    """Autocorrelation `(key, lag, acf, band)`; band is 1.96 / sqrt(n)."""
    w = by_day(key, day)
    mean = F.avg(value).over(Window.partitionBy(key))
    centred = df.select(key, day, (F.col(value) - mean).alias("d"))
    lags = [F.struct(F.lit(k).alias("lag"), (F.col("d") * F.lag("d", k).over(w)).alias("p")) if k else
            F.struct(F.lit(0).alias("lag"), (F.col("d") * F.col("d")).alias("p")) for k in range(max_lag + 1)]
    pairs = centred.select(key, F.array(*lags).alias("a")).select(key, F.explode("a").alias("a"))
    sums = pairs.groupBy(key, "a.lag").agg(F.sum("a.p").alias("s"), F.count("*").alias("n"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(key))
    return sums.select(key, "lag", (F.col("s") / zero).alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def pacf(df: DataFrame, max_lag: int, value: str = "price", key: str = "symbol", day: str = "day") -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on the ACF.

    The state of the fold is `(phi[1..m], pacf[1..m])`; it reads the L+1 ACF
    values of a series as one array.
    """
    values = F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"])
    rho = acf(df, max_lag, value, key, day).groupBy(key).agg(values.alias("r"))
    empty = F.array().cast("array<double>")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, m: Column) -> Column:
        phi = state["phi"]
        # rho[m-1], ..., rho[1] lines up with phi[1], ..., phi[m-1].
        head = F.slice(F.col("r"), F.lit(2), m - 1)
        top = F.element_at("r", m + 1) - dot(phi, F.reverse(head))
        last = top / (F.lit(1.0) - dot(phi, head))
        shifted = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(
            F.concat(shifted, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out")
        )

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), F.struct(empty.alias("phi"), empty.alias("out")), step)
    return rho.select(key, F.posexplode(fold["out"]).alias("pos", "pacf")).select(
        key, (F.col("pos") + 1).alias("lag"), "pacf"
    )


def state_runs(df: DataFrame, state: str, key: str = "symbol", day: str = "day") -> DataFrame:
    """Maximal runs of equal state: `(key, state, start, end, n)`."""
    w = by_day(key, day)
    change = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    return runs.groupBy(key, "_run", F.col(state).alias("state")).agg(
        F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n")
    ).drop("_run")


def volatility(df: DataFrame, column: str, by: str = "symbol") -> DataFrame:
    return df.groupBy(by).agg(F.stddev_samp(column).alias("volatility"))
