"""Autoregressions, order choice and unit-root test over many series at once.

Series are independent and bounded by the calendar, so each (series, order)
cell is one Arrow group and the cells run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsquant.operators.linear import coefficient_table, fit_ols
from newsquant.operators.series import by_day

# Asymptotic 1, 5 and 10 % points of the unit-root test with a constant.
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}


def adf(df: DataFrame, lags: int = 0, value: str = "price", key: str = "symbol", day: str = "day") -> DataFrame:
    """Augmented Dickey-Fuller: t-statistic of the lagged level in the regression of the change.

    `(key, t_stat, stationary)`; stationary at the 5 % point.
    """
    w = by_day(key, day)
    data = df.select(key, day, F.lag(value).over(w).alias("level"), (F.col(value) - F.lag(value).over(w)).alias("change"))
    names = ["level"]
    if lags:
        data = data.withColumns({f"change{i}": F.lag("change", i).over(w) for i in range(1, lags + 1)})
        names += [f"change{i}" for i in range(1, lags + 1)]
    table = coefficient_table(fit_ols(data, names, "change", [key]), names, [key])
    t = table.filter(F.col("term") == "level").select(key, "t_stat")
    return t.withColumn("stationary", F.col("t_stat") < ADF_CRITICAL["5%"])


def fit_ar(df: DataFrame, columns: Sequence[str], target: str, window: int | None = None, key: str = "symbol",
           day: str = "day") -> DataFrame:
    """One-step forecasts of an (exogenous) autoregression whose lag columns are given.

    Without `window` one fit per series on all rows, in-sample; with it the
    coefficients come from the `window` rows before each forecast.
    `(key, day, mean, lo, hi, actual)`, the interval from the residual variance.
    """
    columns = list(columns)
    schema = f"{key} string, {day} date, mean double, lo double, hi double, actual double"

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        x = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(dtype=float)])
        y = pdf[target].to_numpy(dtype=float)
        rows = []
        if window is None:
            spans = [(0, len(y), range(len(y)))] if len(y) > x.shape[1] else []
        else:
            spans = [(t - window, t, [t]) for t in range(window, len(y))]
        for lo, hi, targets in spans:
            beta, *_ = np.linalg.lstsq(x[lo:hi], y[lo:hi], rcond=None)
            free = max(hi - lo - x.shape[1], 1)
            sigma = np.sqrt(((y[lo:hi] - x[lo:hi] @ beta) ** 2).sum() / free)
            for t in targets:
                m = x[t] @ beta
                rows.append((pdf[key].iloc[t], pdf[day].iloc[t], m, m - 1.96 * sigma, m + 1.96 * sigma, y[t]))
        return pd.DataFrame(rows, columns=[key, day, "mean", "lo", "hi", "actual"])

    complete = df.dropna(subset=[*columns, target]).select(key, day, target, *[c for c in columns if c != target])
    return complete.groupBy(key).applyInPandas(forecast, schema)


def arma_order(df: DataFrame, ps: Sequence[int], qs: Sequence[int], value: str = "ret", exog: Sequence[str] = (),
               long_order: int = 10, key: str = "symbol", day: str = "day") -> DataFrame:
    """AIC of ARMA(p, q) by two regressions: a long AR for the residuals, then lags of both.

    `(key, p, q, aic, n, best)`; all orders use the same rows, so AICs compare.
    """
    exog = list(exog)
    start = long_order + max([*ps, *qs])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        x = pdf[value].to_numpy(dtype=float)
        n = len(x) - start
        if n <= p + q + len(exog) + 1:
            return pd.DataFrame(columns=[key, "p", "q", "aic", "n"])
        design = np.column_stack([np.ones(len(x) - long_order)]
                                 + [x[long_order - i:len(x) - i] for i in range(1, long_order + 1)])
        beta, *_ = np.linalg.lstsq(design, x[long_order:], rcond=None)
        e = np.concatenate([np.zeros(long_order), x[long_order:] - design @ beta])
        cols = [np.ones(n)] + [x[start - i:len(x) - i] for i in range(1, p + 1)]
        cols += [e[start - i:len(x) - i] for i in range(1, q + 1)]
        cols += [pdf[c].to_numpy(dtype=float)[start:] for c in exog]
        second = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(second, x[start:], rcond=None)
        sigma2 = float(np.mean((x[start:] - second @ beta) ** 2))
        aic = n * np.log(max(sigma2, 1e-300)) + 2 * (second.shape[1] + 1)
        return pd.DataFrame([(pdf[key].iloc[0], p, q, aic, n)], columns=[key, "p", "q", "aic", "n"])

    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in ps for q in qs])).alias("g")
    cells = df.dropna(subset=[value, *exog]).select(key, day, value, *exog, grid).select(key, day, value, *exog, "g.*")
    table = cells.groupBy(key, "p", "q").applyInPandas(score, f"{key} string, p int, q int, aic double, n int")
    best = table.groupBy(key).agg(F.min(F.struct("aic", "p", "q")).alias("b"))
    return table.join(best, key).withColumn("best", (F.col("p") == F.col("b.p")) & (F.col("q") == F.col("b.q"))).drop("b")
