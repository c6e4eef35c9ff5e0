"""Return regression over (symbol, K, components): all cells in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")
_SCORES = [f"{m}_{s}" for m in ("r2", "baseline_r2") for s in SPLITS]


def _fit_scores(x: np.ndarray, y: np.ndarray, split: np.ndarray) -> list[float]:
    design = np.column_stack([np.ones(len(x)), x])
    train = split == "train"
    beta, *_ = np.linalg.lstsq(design[train], y[train], rcond=None)
    out = []
    for s in SPLITS:
        rows = split == s
        gap = y[rows] - design[rows] @ beta
        total = ((y[rows] - y[rows].mean()) ** 2).sum() if rows.any() else 0.0
        out.append(float(1 - (gap * gap).sum() / total) if total > 0 else float("nan"))
    return out


def _project(x: np.ndarray, train: np.ndarray, n: int) -> np.ndarray:
    """Scores of the first n principal components of the training rows."""
    centre = x[train].mean(axis=0)
    _, _, axes = np.linalg.svd(x[train] - centre, full_matrices=False)
    return (x - centre) @ axes[:n].T


def grid_search(panel: DataFrame, price_columns: Sequence[str], target: str, components: Sequence[int | None],
                vector: str = "news", keys: Sequence[str] = ("symbol", "k")) -> DataFrame:
    """Score every (symbol, K, n): price-only baseline against price + news.

    `panel` has one row per (symbol, K, day) with the price columns, the
    target, the split and the day's news vector as an array. Each cell is one
    Arrow group of at most the calendar's days. n = NULL skips the PCA, as
    does any n not below the width.
    """
    keys, price_columns = list(keys), list(price_columns)
    names = [*keys, "n", "num_days", *_SCORES]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in panel.schema.fields if f.name in keys]
    schema = ", ".join([*fields, "n int", "num_days int", *[f"{s} double" for s in _SCORES]])

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        prices = pdf[price_columns].to_numpy(dtype=float)
        news = np.array(pdf[vector].tolist(), dtype=float)
        y, split = pdf[target].to_numpy(dtype=float), pdf["split"].to_numpy()
        if 0 < n < news.shape[1]:
            news = _project(news, split == "train", n)
        scores = _fit_scores(np.column_stack([prices, news]), y, split) + _fit_scores(prices, y, split)
        return pd.DataFrame([[pdf[c].iloc[0] for c in keys] + [n, len(pdf), *scores]], columns=names)

    wanted = F.explode(F.array(*[F.lit(n or 0) for n in components])).alias("n")
    rows = panel.dropna(subset=[*price_columns, target]).select(*keys, *price_columns, target, "split", vector, wanted)
    table = rows.groupBy(*keys, "n").applyInPandas(cell, schema)
    table = table.withColumns({s: F.when(~F.isnan(s), F.col(s)) for s in _SCORES})
    return table.withColumn("n", F.when(F.col("n") > 0, F.col("n"))).withColumn(
        "improvement", F.col("r2_test") - F.col("baseline_r2_test"))
