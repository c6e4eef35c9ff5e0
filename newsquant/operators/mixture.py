"""Dirichlet-process mixture of diagonal Gaussians by truncated variational EM.

One Spark pass per iteration: every partition sums its responsibilities and
first two moments per component; only components x dimensions numbers reach
the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsquant.functions.hashing import random_key
from newsquant.operators.encode import Layout
from newsquant.operators.nearest import MAX_MODEL_CELLS, _expanded_inputs, event_centroids, model_rows, once


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (x < 6).any():
        out = np.where(x < 6, out - 1 / x, out)
        x = np.where(x < 6, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _log_weights(params: dict, x: np.ndarray) -> np.ndarray:
    """Unnormalised log responsibilities, rows x components."""
    m, beta, a, b = params["m"], params["beta"], params["a"], params["b"]
    ratio = a[:, None] / b
    const = params["log_pi"] + 0.5 * (digamma(a)[:, None] - np.log(b) - np.log(2 * np.pi) - 1 / beta[:, None]).sum(axis=1)
    quad = (x * x) @ ratio.T - 2 * x @ (ratio * m).T + (ratio * m * m).sum(axis=1)
    return const - 0.5 * quad


def _maximise(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, alpha: float) -> dict:
    """Parameters of the variational posterior from the three sums (prior mean 0, unit scale)."""
    g1, rest = 1 + n, np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0.0]])
    g2 = alpha + rest
    both = digamma(g1 + g2)
    stay = np.concatenate([[0.0], np.cumsum(digamma(g2) - both)[:-1]])
    beta0, a0, b0 = 1.0, 1.0, 1.0
    mean = s1 / np.maximum(n, 1e-12)[:, None]
    spread = np.maximum(s2 - n[:, None] * mean * mean, 0)
    beta = beta0 + n
    return {
        "log_pi": digamma(g1) - both + stay, "beta": beta, "m": s1 / beta[:, None], "a": a0 + n / 2,
        "b": b0 + 0.5 * (spread + beta0 * n[:, None] * mean * mean / beta[:, None]), "n": n,
    }


def _climb(start: np.ndarray, alpha: float, sums: Callable[[dict], tuple], max_iter: int | None, tol: float) -> tuple[dict, float]:
    """Parameters and mean log-likelihood once a round gains less than `tol`; a round limit that comes first is an error."""
    params, score = _maximise(np.ones(len(start)), start, start * start, alpha), float("-inf")
    for step in count():
        if step == max_iter:
            raise RuntimeError(f"the mixture still gains after {max_iter} rounds")
        last = score
        n, s1, s2, score = sums(params)
        params = _maximise(n, s1, s2, alpha)
        if score - last < tol:
            return params, score


def fit_dpgmm(df: DataFrame, column: str, n_max: int, alpha: float, max_iter: int | None = None, seed: int = 0,
              id_col: str = "vec_id", tol: float = 1e-4) -> tuple[DataFrame, float, int]:
    """Fit, until the mean log-likelihood gains less than `tol`, on a standardised array column: `(components, mean log-likelihood, effective components)`.

    `n_max` is the truncation; with `max_iter`, a fit that still gains then is
    an error. The components table is `(cluster_id, weight, centroid, n)`, the
    same shape any cluster model has.
    """
    firsts = df.select(F.col(column).alias("x"), random_key(id_col, seed).alias("k"), F.col(id_col).alias("id"))
    start = np.array([r["x"] for r in firsts.orderBy("k", "id").limit(n_max).collect()], dtype=float)
    t, d = start.shape
    if t * d > MAX_MODEL_CELLS:
        raise ValueError("mixture too large")
    params, score = _climb(start, alpha, lambda p: _sums(df, column, p, t, d), max_iter, tol)
    weight = params["n"] / params["n"].sum()
    rows = [(i, float(weight[i]), params["m"][i].tolist(), float(params["n"][i])) for i in range(t)]
    table = df.sparkSession.createDataFrame(rows, "cluster_id int, weight double, centroid array<double>, n double")
    return table, score, int((params["n"] > 0.5).sum())


def _sums(df: DataFrame, column: str, params: dict, t: int, d: int):
    shared = df.sparkSession.sparkContext.broadcast(params)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        n, s1, s2, ll, rows = np.zeros(t), np.zeros((t, d)), np.zeros((t, d)), 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.array(pdf["x"].tolist(), dtype=float)
            w = _log_weights(p, x)
            top = w.max(axis=1, keepdims=True)
            r = np.exp(w - top)
            total = r.sum(axis=1, keepdims=True)
            ll += float((top + np.log(total)).sum())
            r /= total
            n, s1, s2, rows = n + r.sum(axis=0), s1 + r.T @ x, s2 + r.T @ (x * x), rows + len(x)
        if rows:
            yield pd.DataFrame({"c": np.arange(t), "n": n, "s": list(np.hstack([s1, s2]))})
            yield pd.DataFrame({"c": [-1], "n": [float(rows)], "s": [[ll]]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": group["c"].iloc[:1], "n": [group["n"].sum()], "s": [np.sum(group["s"].tolist(), axis=0)]})

    # one row per component and task is shuffled, its sums as one array
    schema = "c long, n double, s array<double>"
    parts = df.select(F.col(column).alias("x")).mapInPandas(expect, schema)
    got = {r["c"]: r for r in parts.groupBy("c").applyInPandas(add, schema).collect()}
    shared.unpersist()
    tail = got.pop(-1)
    sums = np.array([got[c]["s"] for c in range(t)])
    return np.array([got[c]["n"] for c in range(t)]), sums[:, :d], sums[:, d:], tail["s"][0] / tail["n"]


class _Slots:
    """Standardised slots of coded events: one-hot blocks as the value of an absent and a present code, numbers as they are."""

    def __init__(self, lay: Layout, stats: DataFrame):
        stat = sorted(stats.collect(), key=lambda r: r["slot"])  # `width` rows
        mean, std = np.array([r["mean"] for r in stat]), np.array([r["std"] for r in stat])
        self.zero, self.one = -mean / std, (1 - mean) / std
        self.blocks = [np.arange(at, at + r.size) for r, at in lay.categories]
        self.numbers = np.array([at for _, at in lay.numerics] + [s for r, at in lay.vectors for s in range(at, at + r.size)], dtype=int)
        self.mean, self.std = mean[self.numbers], std[self.numbers]
        self.n_numeric, self.width = len(lay.numerics), lay.width

    def read(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Codes (0 for none) and standardised numbers of a batch of `_expanded_inputs`."""
        k = len(self.blocks)
        codes = pdf.iloc[:, :k].to_numpy(dtype=np.int64)
        columns = [pdf.iloc[:, k:k + self.n_numeric].to_numpy(dtype=float)]
        columns += [np.stack(pdf.iloc[:, j].to_numpy()) for j in range(k + self.n_numeric, pdf.shape[1])]
        return codes, (np.concatenate(columns, axis=1) - self.mean) / self.std

    def log_weights(self, params: dict, codes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """`_log_weights` of the full vectors, by one look-up per category."""
        m, a, b = params["m"], params["a"], params["b"]
        ratio = a[:, None] / b
        part = {"m": m[:, self.numbers], "beta": params["beta"], "a": a, "b": b[:, self.numbers], "log_pi": params["log_pi"]}
        out = _log_weights(part, x)
        for j, slots in enumerate(self.blocks):
            low, high = ratio[:, slots] * (self.zero[slots] - m[:, slots]) ** 2, ratio[:, slots] * (self.one[slots] - m[:, slots]) ** 2
            fixed = (digamma(a)[:, None] - np.log(b[:, slots]) - np.log(2 * np.pi) - 1 / params["beta"][:, None]).sum(axis=1)
            table = np.vstack([np.zeros(len(m)), (high - low).T])
            out += 0.5 * (fixed - low.sum(axis=1)) - 0.5 * table[codes[:, j]]
        return out

    def moments(self, n: np.ndarray, hits: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and sums of squares by (component, slot) from those of the active codes and of the numbers."""
        first, second = np.zeros((len(n), self.width)), np.zeros((len(n), self.width))
        first[:, self.numbers], second[:, self.numbers] = s1, s2
        at = 0
        for slots in self.blocks:
            active = hits[:, at:at + len(slots)]
            first[:, slots] = n[:, None] * self.zero[slots] + active * (self.one - self.zero)[slots]
            second[:, slots] = n[:, None] * self.zero[slots] ** 2 + active * (self.one ** 2 - self.zero ** 2)[slots]
            at += len(slots)
        return first, second


def _event_sums(df: DataFrame, lay: Layout, slots: _Slots, params: dict):
    shared = df.sparkSession.sparkContext.broadcast((params, slots))
    t, hot = len(params["n"]), sum(len(b) for b in slots.blocks)

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, s = shared.value
        n, hits, s1, s2 = np.zeros(t), np.zeros((t, hot)), np.zeros((t, len(s.numbers))), np.zeros((t, len(s.numbers)))
        ll, rows = 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            codes, x = s.read(pdf)
            w = s.log_weights(p, codes, x)
            top = w.max(axis=1, keepdims=True)
            r = np.exp(w - top)
            total = r.sum(axis=1, keepdims=True)
            ll += float((top + np.log(total)).sum())
            r /= total
            at, columns = 0, np.ascontiguousarray(r.T)
            for j, block in enumerate(s.blocks):
                for c, own in enumerate(columns):
                    hits[c, at:at + len(block)] += np.bincount(codes[:, j], own, len(block) + 1)[1:]  # code 0 is none
                at += len(block)
            n, s1, s2, rows = n + r.sum(axis=0), s1 + r.T @ x, s2 + r.T @ (x * x), rows + len(x)
        if rows:
            yield pd.DataFrame({"c": np.arange(t), "n": n, "s": list(np.hstack([hits, s1, s2]))})
            yield pd.DataFrame({"c": [-1], "n": [float(rows)], "s": [[ll]]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": group["c"].iloc[:1], "n": [group["n"].sum()], "s": [np.sum(group["s"].tolist(), axis=0)]})

    schema = "c long, n double, s array<double>"
    got = {r["c"]: r for r in df.select(*_expanded_inputs(lay)).mapInPandas(expect, schema).groupBy("c").applyInPandas(add, schema).collect()}
    shared.unpersist()
    tail = got.pop(-1)
    n, sums = np.array([got[c]["n"] for c in range(t)]), np.array([got[c]["s"] for c in range(t)])
    numbers = len(slots.numbers)
    return n, *slots.moments(n, sums[:, :hot], sums[:, hot:hot + numbers], sums[:, hot + numbers:]), tail["s"][0] / tail["n"]


#: Columns of a saved mixture over expanded events, beside what any cluster model has.
EVENT_MODEL = "cluster_id int, weight double, centroid array<double>, n double, b array<double>, beta double, a double, log_pi double"


def fit_dpgmm_events(df: DataFrame, lay: Layout, stats: DataFrame, n_max: int, alpha: float, max_iter: int | None = None, seed: int = 0,
                     id_col: str = "event_id", tol: float = 1e-3) -> tuple[DataFrame, float, int]:
    """`fit_dpgmm` on cleaned events in the standardised slots of `lay`, without building the vectors.

    The log-likelihood of an event sums over all slots, hence the wider `tol`.

    A task sums, per component, the responsibilities of every active code and
    the moments of the numbers; what an absent code adds follows from the totals.
    The table also holds what `assign_mixture` needs.
    """
    if n_max * lay.width > MAX_MODEL_CELLS:
        raise ValueError("mixture too large")
    slots = _Slots(lay, stats)
    firsts = df.orderBy(random_key(id_col, seed), id_col).limit(n_max).select(*[r.name for r, _ in lay.topics])
    seeds = firsts.withColumn("i", F.monotonically_increasing_id().cast("int"))
    start = np.array([r["centroid"] for r in event_centroids(seeds, lay, stats).collect()], dtype=float)
    params, score = _climb(start, alpha, lambda p: _event_sums(df, lay, slots, p), max_iter, tol)
    weight = params["n"] / params["n"].sum()
    rows = [(i, float(weight[i]), params["m"][i].tolist(), float(params["n"][i]), params["b"][i].tolist(), float(params["beta"][i]),
             float(params["a"][i]), float(params["log_pi"][i])) for i in range(len(start))]
    return df.sparkSession.createDataFrame(rows, EVENT_MODEL), score, int((params["n"] > 0.5).sum())


def assign_mixture(df: DataFrame, lay: Layout, stats: DataFrame, model: DataFrame) -> DataFrame:
    """The most probable component of every event under a mixture of `fit_dpgmm_events`: adds `cluster_id`."""
    rows = model_rows(model, 2 * lay.width, "cluster_id")
    params = {"m": np.array([r["centroid"] for r in rows]), "b": np.array([r["b"] for r in rows]),
              **{c: np.array([r[c] for r in rows]) for c in ("beta", "a", "log_pi")}}
    ids = np.array([r["cluster_id"] for r in rows], dtype="int32")
    shared = df.sparkSession.sparkContext.broadcast((params, _Slots(lay, stats), ids))

    @F.pandas_udf("int")
    def most(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        p, s, names = shared.value
        for pdf in batches:
            yield pd.Series(names[s.log_weights(p, *s.read(pdf)).argmax(axis=1)] if len(pdf) else np.zeros(0, "int32"))

    return df.withColumn("cluster_id", once(most)(F.struct(*_expanded_inputs(lay))))


def search_alpha(df: DataFrame, column: str, n_max: int, alphas: Sequence[float] = (0.01, 0.1, 1, 10),
                 max_iter: int | None = None, seed: int = 0, id_col: str = "vec_id") -> DataFrame:
    """`(alpha, score, components, best)`; the first alpha with the highest score is best.

    The sample is read by every iteration, so it is kept in executor memory or on disk meanwhile.
    """
    data = df.select(id_col, column).persist()
    try:
        rows = []
        for alpha in alphas:
            _, score, used = fit_dpgmm(data, column, n_max, alpha, max_iter, seed, id_col)
            rows.append((float(alpha), score, used))
    finally:
        data.unpersist()
    best = max(r[1] for r in rows)
    first = next(i for i, r in enumerate(rows) if r[1] == best)
    table = [(*r, i == first) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(table, "alpha double, score double, components int, best boolean")
