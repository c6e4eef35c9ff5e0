"""ARMA models with exogenous columns, refitted in every moving window.

The model is y_t = c + sum phi_i y_{t-i} + beta x_t + sum theta_j e_{t-j} + e_t.
Given the first p values of a window and innovations of zero before them, the
innovations follow by recursion, and least squares over them is the
conditional likelihood. Damped Gauss-Newton steps minimise it for many windows
at once: the recursion runs along the window, every step of it over all
windows of a block. A block starts from the coefficients of the window before.

Series are independent and as long as the calendar, so each is one Arrow group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that are fitted together.
BLOCK = 512
MAX_ROUNDS = 60
#: Largest root of the moving-average part; beyond it the innovations would not die out.
LARGEST_ROOT = 0.999


def _base(y: np.ndarray, x: np.ndarray, p: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that do not depend on innovations (constant, lags of y, x) and targets, from place `skip` of each window on."""
    n = y.shape[1]
    lags = [y[:, skip - i:n - i] for i in range(1, p + 1)]
    ones = np.ones((len(y), n - skip))
    return np.concatenate([np.stack([ones, *lags], axis=2), x[:, skip:]], axis=2), y[:, skip:]


def _filter(base: np.ndarray, target: np.ndarray, coef: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Innovations and their derivatives by the coefficients (base columns first, then theta)."""
    fixed = base.shape[2]
    e = target - np.einsum("wlk,wk->wl", base, coef[:, :fixed])
    slope = np.concatenate([-base, np.zeros((*e.shape, q))], axis=2)
    theta = coef[:, fixed:]
    for t in range(1, e.shape[1] if q else 0):
        for j in range(1, min(q, t) + 1):
            e[:, t] -= theta[:, j - 1] * e[:, t - j]
            slope[:, t] -= theta[:, j - 1, None] * slope[:, t - j]
            slope[:, t, fixed + j - 1] -= e[:, t - j]
    return e, slope


def _invertible(theta: np.ndarray) -> np.ndarray:
    q = theta.shape[1]
    if q == 0:
        return np.ones(len(theta), bool)
    companion = np.zeros((len(theta), q, q))
    companion[:, 0] = -theta
    companion[:, np.arange(1, q), np.arange(q - 1)] = 1.0
    return np.abs(np.linalg.eigvals(companion)).max(axis=1) < LARGEST_ROOT


def fit_windows(y: np.ndarray, x: np.ndarray, p: int, q: int, start: np.ndarray | None = None,
                skip: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (constant, phi, beta, theta), innovations and their sum of squares, for windows (w, n) and columns (w, n, m)."""
    base, target = _base(y, x, p, p if skip is None else skip)
    k = base.shape[2] + q
    coef = np.zeros((len(y), k)) if start is None else np.broadcast_to(start, (len(y), k)).copy()
    with np.errstate(over="ignore", invalid="ignore"):
        e, slope = _filter(base, target, coef, q)
        sse = (e * e).sum(axis=1)
        damping, live = np.zeros(len(y)), np.arange(len(y))
        for _ in range(MAX_ROUNDS):
            gram = np.einsum("wlk,wlm->wkm", slope[live], slope[live])
            scale = 1 / np.sqrt(np.maximum(np.einsum("wkk->wk", gram), 1e-300))
            unit = gram * scale[:, :, None] * scale[:, None] + damping[live, None, None] * np.eye(k)
            pull = scale * np.einsum("wlk,wl->wk", slope[live], e[live])
            move = -scale * np.einsum("wkm,wm->wk", np.linalg.pinv(unit, rcond=1e-12, hermitian=True), pull)
            trial = coef[live] + move
            e2, slope2 = _filter(base[live], target[live], trial, q)
            sse2 = (e2 * e2).sum(axis=1)
            better = (sse2 <= sse[live]) & _invertible(trial[:, k - q:])
            gain = sse[live] - np.where(better, sse2, sse[live])
            won = live[better]
            coef[won], e[won], slope[won], sse[won] = trial[better], e2[better], slope2[better], sse2[better]
            damping[won] = np.where(damping[won] > 1e-9, damping[won] / 10, 0.0)
            lost = live[~better]
            damping[lost] = np.maximum(damping[lost] * 10, 1e-3)
            open_ = np.where(better, gain > 1e-12 * sse[live], damping[live] < 1e8)
            live = live[open_]
            if not len(live):
                break
    return coef, e, sse


def _aic(sse: np.ndarray, n: int, k: int) -> np.ndarray:
    return n * np.log(np.maximum(sse / n, 1e-300)) + 2 * (k + 1)


def _first_window(y: np.ndarray, x: np.ndarray, ps: Sequence[int], qs: Sequence[int], window: int) -> list[tuple[float, int, int]]:
    """(AIC, p, q) over the first window; all orders are scored on the same rows."""
    skip, out = max(ps), []
    for p in ps:
        for q in qs:
            coef, _, sse = fit_windows(y[None, :window], x[None, :window], p, q, skip=skip)
            out.append((float(_aic(sse, window - skip, coef.shape[1])[0]), p, q))
    return out


def _series(pdf: pd.DataFrame, value: str, exog: list[str], day: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(day)
    return pdf, pdf[value].to_numpy(dtype=float), pdf[exog].to_numpy(dtype=float).reshape(len(pdf), len(exog))


def arma_aic(df: DataFrame, ps: Sequence[int], qs: Sequence[int], window: int, value: str = "log_ret", exog: Sequence[str] = (),
             key: str = "symbol", day: str = "day") -> DataFrame:
    """AIC of every order on the first `window` rows of each series: `(key, p, q, aic, best)`; ties go to the smaller order."""
    exog = list(exog)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, x = _series(pdf, value, exog, day)
        table = _first_window(y, x, ps, qs, window) if len(y) >= window else []
        rows = [(pdf[key].iloc[0], p, q, aic, (aic, p, q) == min(table)) for aic, p, q in table]
        return pd.DataFrame(rows, columns=[key, "p", "q", "aic", "best"])

    complete = df.dropna(subset=[value, *exog]).select(key, day, value, *exog)
    return complete.groupBy(key).applyInPandas(score, f"{key} string, p int, q int, aic double, best boolean")


def arma_forecast(df: DataFrame, ps: Sequence[int], qs: Sequence[int], window: int, value: str = "log_ret",
                  exog: Sequence[str] = (), key: str = "symbol", day: str = "day") -> DataFrame:
    """One-step forecasts with 95 % intervals, refitted on the `window` rows before each day.

    The order is the one of least AIC on a series' first window and stays; the
    coefficients are estimated anew for every day. `exog` columns of a row must
    be known before its value (lag them). `(key, day, p, q, mean, lo, hi, actual)`;
    a series of `window` rows or fewer has no forecast.
    """
    exog = list(exog)

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, x = _series(pdf, value, exog, day)
        names = [key, day, "p", "q", "mean", "lo", "hi", "actual"]
        if len(y) <= window:
            return pd.DataFrame(columns=names)
        _, p, q = min(_first_window(y, x, ps, qs, window))
        ys = np.lib.stride_tricks.sliding_window_view(y, window)[:-1]
        xs = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)[:-1].transpose(0, 2, 1)
        start, mean, sigma = None, [], []
        for lo in range(0, len(ys), BLOCK):
            if start is None:
                start = fit_windows(ys[:1], xs[:1], p, q)[0][0]
            part = slice(lo, lo + BLOCK)
            coef, e, sse = fit_windows(ys[part], xs[part], p, q, start)
            start = coef[-1]
            lags = [ys[part][:, -i] for i in range(1, p + 1)]
            columns = [np.ones(len(e)), *lags, *x[window:][part].T, *(e[:, -j] for j in range(1, q + 1))]
            mean.append((np.stack(columns, axis=1) * coef).sum(axis=1))
            sigma.append(np.sqrt(sse / max(e.shape[1] - coef.shape[1], 1)))
        mean, half = np.concatenate(mean), 1.96 * np.concatenate(sigma)
        return pd.DataFrame(dict(zip(names, (pdf[key].iloc[0], pdf[day].iloc[window:], p, q, mean, mean - half, mean + half, y[window:]), strict=True)))

    complete = df.dropna(subset=[value, *exog]).select(key, day, value, *exog)
    return complete.groupBy(key).applyInPandas(
        forecast, f"{key} string, {day} date, p int, q int, mean double, lo double, hi double, actual double")


def ma_profile(df: DataFrame, thetas: Sequence[float], value: str = "log_ret", key: str = "symbol", day: str = "day") -> DataFrame:
    """Sum of squared innovations of the series around its mean for given MA(1) coefficients: `(key, theta, sse, n, best)`.

    The recursion is a fold over the series as one array.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(day, value))), lambda r: r[value]).alias("y"), F.avg(value).alias("m"))

    def total(theta: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("s"))

        def step(state: Column, v: Column) -> Column:
            e = v - F.col("m") - theta * state["e"]
            return F.struct(e.alias("e"), (state["s"] + e * e).alias("s"))

        return F.aggregate("y", zero, step, lambda state: state["s"])

    cells = F.transform(F.array(*[F.lit(float(t)) for t in thetas]), lambda t: F.struct(t.alias("theta"), total(t).alias("sse")))
    least = F.array_min(F.transform("cells", lambda c: F.struct(c["sse"], c["theta"])))
    out = rows.select(key, F.size("y").cast("bigint").alias("n"), cells.alias("cells")).withColumn("least", least)
    return out.select(key, "n", "least", F.explode("cells").alias("c")).select(
        key, "c.theta", "c.sse", "n", (F.col("c.theta") == F.col("least.theta")).alias("best"))
