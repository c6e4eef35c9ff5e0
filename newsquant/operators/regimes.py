"""Two-state market regimes for all series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _forward_backward(like: np.ndarray, start: np.ndarray, move: np.ndarray):
    """State posteriors, expected transitions and log-likelihood of one series."""
    n, k = like.shape
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = start * like[0]
    for t in range(n):
        if t:
            a = (alpha[t - 1] @ move) * like[t]
        scale[t] = max(a.sum(), 1e-300)
        alpha[t] = a / scale[t]
    beta, moves = np.ones(k), np.zeros((k, k))
    post = np.empty((n, k))
    post[-1] = alpha[-1]
    for t in range(n - 2, -1, -1):
        ahead = like[t + 1] * beta / scale[t + 1]
        moves += alpha[t][:, None] * move * ahead[None, :]
        beta = move @ ahead
        post[t] = alpha[t] * beta
    return post, moves, float(np.log(scale).sum())


def _baum_welch(x: np.ndarray, k: int, seed: int, max_iter: int, tol: float = 1e-6):
    rng = np.random.default_rng(seed)
    post = rng.dirichlet(np.ones(k), size=len(x))
    start, move, last = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)), -np.inf
    np.fill_diagonal(move, 0.9)
    floor = np.maximum(x.var(axis=0), 1e-12) * 1e-3
    for _ in range(max_iter):
        weight = post.sum(axis=0)[:, None] + 1e-12
        mean = post.T @ x / weight
        var = np.maximum(post.T @ (x * x) / weight - mean * mean, floor)
        gap = (x[:, None, :] - mean[None]) ** 2 / var[None]
        log_like = -0.5 * (gap + np.log(2 * np.pi * var)[None]).sum(axis=2)
        top = log_like.max(axis=1, keepdims=True)
        post, moves, ll = _forward_backward(np.exp(log_like - top), start, move)
        ll += float(top.sum())
        start = post[0] / post[0].sum()
        move = (moves + 1e-6) / (moves + 1e-6).sum(axis=1, keepdims=True)
        if ll - last < tol * abs(ll):
            break
        last = ll
    return post, mean, ll


def hmm_states(df: DataFrame, n_states: int = 2, columns: tuple[str, ...] = ("log_ret", "ret_ema"), restarts: int = 3,
               max_iter: int = 50, key: str = "symbol", day: str = "day") -> DataFrame:
    """Regime of every row: `(key, day, state, prob, log_lik)`.

    A Gaussian hidden Markov model per (series, restart), one Arrow group
    each; a group has at most one row per calendar day. The restart with the
    best likelihood wins. States are numbered by the mean of the first column.
    """
    columns = list(columns)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        x = pdf[columns].to_numpy(dtype=float)
        post, mean, ll = _baum_welch(x, n_states, int(pdf["restart"].iloc[0]) + 1, max_iter)
        order = np.argsort(mean[:, 0], kind="stable")
        ranked = post[:, order]
        return pd.DataFrame({
            key: pdf[key].to_numpy(), day: pdf[day].to_numpy(), "restart": pdf["restart"].to_numpy(),
            "state": ranked.argmax(axis=1).astype("int32"), "prob": ranked.max(axis=1), "log_lik": ll,
        })

    many = df.dropna(subset=columns).select(key, day, *columns).withColumn(
        "restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    schema = f"{key} string, {day} date, restart int, state int, prob double, log_lik double"
    fits = many.groupBy(key, "restart").applyInPandas(label, schema)
    # `restarts` rows per (series, day).
    best = F.max_by(F.struct("state", "prob", "log_lik"), F.struct("log_lik", -F.col("restart"))).alias("b")
    return fits.groupBy(key, day).agg(best).select(key, day, "b.*")
