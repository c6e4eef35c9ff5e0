"""Kelly back-tests over many (symbol, rate) portfolios at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.finance import ci_to_var, kelly_fraction, lognormal_var, simple_return
from newsquant.functions.lookup import let, scan


def price_moments(df: DataFrame, mean: str = "mean", hi: str = "hi", lo: str = "lo") -> DataFrame:
    """Simple-return moments of log-return forecasts: adds `expected` and `variance`."""
    var = ci_to_var(hi, lo)
    return df.withColumns({"expected": simple_return(mean), "variance": lognormal_var(mean, var)})


def kelly(df: DataFrame, capital: float = 15.0, r: float | None = 0.0, method: str = "fold",
          key: Sequence[str] = ("symbol",), day: str = "day", price: str = "price") -> DataFrame:
    """Wealth before each day's trade, from `expected`, `variance` and a price.

    Each day everything is sold and the fraction f of wealth is invested;
    borrowed cash (f > 1) grows by the rate. `r=None` reads the rate from a
    column `r`. Adds `fraction` and `wealth`, plus a step-0 row per portfolio.

    'fold' carries (wealth, money, units) over the portfolio's days and always
    holds. 'product' multiplies the step factors in a window; it is right only
    while wealth stays positive and raises where it does not. Either way a
    portfolio has one row per calendar day.
    """
    key = list(key)
    rate = F.col("r") if r is None else F.lit(float(r))
    f = df.withColumn("fraction", kelly_fraction("expected", "variance", rate))
    if r is not None:
        f = f.withColumn("r", rate)
    group = Window.partitionBy(*key, "r").orderBy(day)
    numbered = f.withColumn("step", F.row_number().over(group))
    if method == "product":
        ahead = F.lead(price).over(group) / F.col(price)
        borrow = F.when(F.col("fraction") > 1, F.lit(1.0) + F.col("r")).otherwise(1.0)
        factor = (1 - F.col("fraction")) * borrow + F.col("fraction") * ahead
        past = group.rowsBetween(Window.unboundedPreceding, -1)
        walked = numbered.withColumn("_factor", factor)
        walked = walked.withColumn("wealth", capital * F.coalesce(F.product("_factor").over(past), F.lit(1.0)))
        lost = F.raise_error(F.lit("wealth is not positive: use method='fold'")).cast("double")
        walked = walked.withColumn("wealth", F.when(F.col("wealth") > 0, F.col("wealth")).otherwise(lost)).drop("_factor")
    else:
        walked = _fold(numbered, capital, key, price)
    first = walked.filter(F.col("step") == 1).withColumns({"step": F.lit(0), "fraction": F.lit(0.0)})
    return walked.unionByName(first)


def _fold(numbered: DataFrame, capital: float, key: list[str], price: str) -> DataFrame:
    """Wealth day by day: one array per portfolio, at most a calendar long, folded in the JVM."""
    rest = [c for c in numbered.columns if c not in (*key, "r")]
    day = F.struct("step", *[c for c in rest if c != "step"])
    paths = numbered.groupBy(*key, "r").agg(F.sort_array(F.collect_list(day)).alias("days"))
    trades = F.transform("days", lambda d: F.struct(d["fraction"].alias("f"), d[price].cast("double").alias("p")))
    paths = paths.select(*key, "r", "days", trades.alias("trades"))

    def state(money, units, wealth) -> Column:
        return F.struct(money.alias("money"), units.alias("units"), wealth.alias("wealth"))

    def trade(now, d):
        def after(wealth):
            left = wealth - d["f"] * wealth
            return state(left * F.when(left < 0, 1 + F.col("r")).otherwise(1.0), d["f"] * wealth / d["p"], wealth)

        return let(now["money"] + now["units"] * d["p"], after)

    wealth = scan(F.col("trades"), state(F.lit(float(capital)), F.lit(0.0), F.lit(0.0)), trade, lambda s: s["wealth"], "double")
    each = paths.select(*key, "r", F.explode(F.arrays_zip(F.col("days").alias("day"), wealth.alias("wealth"))).alias("x"))
    return each.select(*key, "r", *[F.col(f"x.day.{c}").alias(c) for c in rest], F.col("x.wealth").alias("wealth")).select(
        *numbered.columns, "wealth")


def kelly_metrics(path: DataFrame, capital: float = 15.0, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Total return, sample std of relative net value, and largest |fraction| per portfolio."""
    relative = F.col("wealth") / capital - 1
    return path.groupBy(*key, "r").agg(
        F.max_by(relative, "step").alias("total_return"), F.stddev_samp(relative).alias("std"),
        F.max(F.abs("fraction")).alias("max_leverage"),
    )


def kelly_sweep(df: DataFrame, rates: Sequence[float], capital: float = 15.0, method: str = "fold",
                key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metrics for every rate, all portfolios in one job."""
    grid = df.withColumn("r", F.explode(F.array(*[F.lit(float(x)) for x in rates])))
    return kelly_metrics(kelly(grid, capital, None, method, key), capital, key)
