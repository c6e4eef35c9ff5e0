"""Lasso forecasts in moving windows at several sparsities.

Columns and target are standardised in every window, so lambda is in standard
deviations of the target and only the window's sums of products matter. These
slide: a day's products come in, the oldest day's go out, and every `BLOCK`
days the sums are taken afresh, which bounds rounding. Coordinate descent then
runs on the correlation matrices of a block's windows at once, along falling
lambdas, each started from the solution before it.

The lambda of least error is found per window by folds that follow in time: a
fold's products are part of the window's, so leaving it out is a subtraction.

Series are independent and as long as the calendar, so each is one Arrow group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Windows that are solved together.
BLOCK = 128
MAX_ROUNDS = 100_000
TOLERANCE = 1e-9


def products(rows: np.ndarray, window: int) -> np.ndarray:
    """Sums of products [1, x, y]'[1, x, y] of every window of consecutive rows."""
    m, k = len(rows) - window + 1, rows.shape[1]
    out = np.empty((max(m, 0), k, k))
    for lo in range(0, m, BLOCK):
        hi = min(lo + BLOCK, m)
        out[lo] = rows[lo:lo + window].T @ rows[lo:lo + window]
        come, go = rows[lo + window:hi + window - 1], rows[lo:hi - 1]
        change = come[:, :, None] * come[:, None] - go[:, :, None] * go[:, None]
        out[lo + 1:hi] = out[lo] + np.cumsum(change, axis=0)
    return out


def correlations(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlation matrix of [x, y], means, standard deviations) from sums of products; constant columns get zeros."""
    n = gram[:, :1, 0]
    mean = gram[:, 0, 1:] / n
    cov = gram[:, 1:, 1:] / n[:, :, None] - mean[:, :, None] * mean[:, None]
    var = np.einsum("wkk->wk", cov)
    sd = np.sqrt(np.where(var > 1e-12 * np.maximum(mean * mean, 1e-300), var, 0.0))
    unit = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    corr = cov * unit[:, :, None] * unit[:, None]
    k = np.arange(corr.shape[1])
    corr[:, k, k] = 1.0  # a constant column correlates with nothing and keeps a coefficient of zero
    return corr, mean, sd


def exact(corr: np.ndarray, lam: float, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions with the signs and zeros of `beta`, and whether they meet the conditions of the minimum."""
    p = corr.shape[1] - 1
    sign = np.sign(beta)
    on = sign != 0
    both = on[:, :, None] & on[:, None]
    system = np.where(both, corr[:, :p, :p], np.eye(p))
    system[:, np.arange(p), np.arange(p)] += 1e-13
    solved = np.linalg.solve(system, np.where(on, corr[:, :p, p] - lam * sign, 0.0)[:, :, None])[:, :, 0]
    pull = corr[:, :p, p] - np.einsum("wjk,wk->wj", corr[:, :p, :p], solved)
    fits = np.where(on, (np.sign(solved) == sign) & (np.abs(pull - lam * sign) < TOLERANCE), np.abs(pull) <= lam + TOLERANCE)
    return solved, fits.all(axis=1)


def descend(corr: np.ndarray, lam: float, beta: np.ndarray) -> np.ndarray:
    """Minimises b'Rb/2 - r'b + lam |b| per window by cyclic coordinate descent; corr holds R and, last, r.

    Once the zeros and signs of a window stand, its solution is that of a linear
    system and is taken from there.
    """
    p = corr.shape[1] - 1
    beta = beta.copy()
    live = np.arange(len(corr))
    for turn in range(MAX_ROUNDS):
        part, b = corr[live], beta[live]
        pull = part[:, :p, p] - np.einsum("wjk,wk->wj", part[:, :p, :p], b)
        most = np.zeros(len(live))
        for j in range(p):
            z = pull[:, j] + b[:, j]
            new = np.sign(z) * np.maximum(np.abs(z) - lam, 0.0)
            step = new - b[:, j]
            if step.any():
                pull -= part[:, :p, j] * step[:, None]
                b[:, j] = new
                np.maximum(most, np.abs(step), out=most)
        done = most <= TOLERANCE
        if turn % 4 == 1:
            solved, fits = exact(part, lam, b)
            b[fits], done = solved[fits], done | fits
        beta[live] = b
        live = live[~done]
        if not len(live):
            return beta
    raise ValueError(f"no solution after {MAX_ROUNDS} rounds")


def path(corr: np.ndarray, lambdas: Sequence[float]) -> np.ndarray:
    """Coefficients (window, lambda, column) along falling lambdas, in the order given."""
    out = np.zeros((len(corr), len(lambdas), corr.shape[1] - 1))
    beta = out[:, 0].copy()
    for i in sorted(range(len(lambdas)), key=lambda i: -lambdas[i]):
        beta = descend(corr, lambdas[i], beta)
        out[:, i] = beta
    return out


def _raw(beta: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and slopes on the scale of the data."""
    slope = np.divide(beta * sd[:, None, -1:], sd[:, None, :-1], out=np.zeros_like(beta), where=sd[:, None, :-1] > 0)
    return mean[:, -1:] - np.einsum("wlk,wk->wl", slope, mean[:, :-1]), slope


def fold_errors(rows: np.ndarray, window: int, folds: int, lambdas: Sequence[float], windows: slice) -> np.ndarray:
    """Squared error (window, lambda) of `folds` equal spans at a window's end, each predicted from the rows before it."""
    span = window // (folds + 1)
    total = np.zeros((windows.stop - windows.start, len(lambdas)))
    for f in range(folds):
        train = window - (folds - f) * span
        some = rows[windows.start:windows.stop - 1 + window]
        learn = products(some[:len(some) - (window - train)], train)
        held = products(some[train:len(some) - (window - train - span)], span)
        corr, mean, sd = correlations(learn)
        cut, slope = _raw(path(corr, lambdas), mean, sd)
        full = np.concatenate([-cut[:, :, None], -slope, np.ones((*cut.shape, 1))], axis=2)
        total += np.einsum("wlj,wjk,wlk->wl", full, held, full)
    return total


def lasso_forecast(df: DataFrame, columns: Sequence[str], target: str, window: int, lambdas: Sequence[float], folds: int = 0,
                   key: str = "symbol", day: str = "day") -> DataFrame:
    """One-step forecasts of every day from a lasso on the `window` rows before it, one row per lambda.

    `(key, day, penalty, pred, nonzero, best, actual)`. `columns` of a row must be
    known before its target (lag them). With `folds` > 0, `best` marks the lambda
    of least error in the window's folds (the larger one on ties), else it is
    null. A series of `window` rows or fewer has no forecast.
    """
    columns, lambdas = list(columns), [float(v) for v in lambdas]

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        values = pdf[[*columns, target]].to_numpy(dtype=float)
        rows = np.column_stack([np.ones(len(values)), values])
        m, parts = len(rows) - window, []
        names = [key, day, "penalty", "pred", "nonzero", "best", "actual"]
        for lo in range(0, m, BLOCK):
            hi = min(lo + BLOCK, m)
            corr, mean, sd = correlations(products(rows[lo:hi + window - 1], window))
            beta = path(corr, lambdas)
            cut, slope = _raw(beta, mean, sd)
            pred = cut + np.einsum("wlk,wk->wl", slope, rows[lo + window:hi + window, 1:-1])
            best = np.full(pred.shape, None, object)
            if folds:
                order = np.argsort(lambdas)[::-1]
                chosen = order[fold_errors(rows, window, folds, lambdas, slice(lo, hi))[:, order].argmin(axis=1)]
                best = np.arange(len(lambdas))[None] == chosen[:, None]
            each = len(lambdas)
            parts.append(pd.DataFrame({
                key: pdf[key].iloc[0], day: np.repeat(pdf[day].to_numpy()[lo + window:hi + window], each), "penalty": np.tile(lambdas, hi - lo),
                "pred": pred.ravel(), "nonzero": (beta != 0).sum(axis=2).ravel().astype("int32"), "best": best.ravel(),
                "actual": np.repeat(values[lo + window:hi + window, -1], each)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    complete = df.dropna(subset=[*columns, target]).select(key, day, *columns, target)
    return complete.groupBy(key).applyInPandas(
        forecast, f"{key} string, {day} date, penalty double, pred double, nonzero int, best boolean, actual double")
