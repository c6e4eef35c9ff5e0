"""Classifier grids on shared, cached training frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Regularisation grids, ten values 1e-2..1e3 and six values 1e-3..1e3.
C_GRID_10 = [float(10 ** (-2 + 5 * i / 9)) for i in range(10)]
C_GRID_6 = [float(10 ** (-3 + 6 * i / 5)) for i in range(6)]


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip").transform(df)


def _accuracy(model, df: DataFrame, label: str) -> float:
    hit = (F.col("prediction") == F.col(label)).cast("double")
    value = model.transform(df).agg(F.avg(hit)).first()[0]
    return float("nan") if value is None else float(value)


def compact(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """Training rows kept in memory or on disk, in partitions of a useful size.

    Iterative fits start one task per partition and pass, so many nearly empty
    partitions cost more than the arithmetic. Large frames keep their split.
    """
    kept = df.persist()
    wanted = max(1, -(-kept.count() // rows_per_partition))
    if wanted >= kept.rdd.getNumPartitions():
        return kept
    small = kept.coalesce(wanted).persist()
    small.count()
    kept.unpersist()
    return small


def _grid(data: DataFrame, cells: Sequence[tuple], fit: Callable, label: str, parallelism: int):
    """Fit every cell on the 'train' rows and score all splits; cells run side by side."""
    parts = {s: compact(data.filter(F.col("split") == s)) for s in ("train", "valid", "test")}

    def run(cell):
        model = fit(parts["train"], cell)
        return cell, [_accuracy(model, parts[s], label) for s in ("train", "valid", "test")], model

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(run, cells))
    for part in parts.values():
        part.unpersist()
    return results


def _best(results) -> int:
    """First cell with the highest validation accuracy."""
    scores = [r[1][1] for r in results]
    return int(np.nanargmax(scores))


def logistic_grid(df: DataFrame, penalties: Sequence[str] = ("l1", "l2"), cs: Sequence[float] = tuple(C_GRID_10),
                  features: str = "features", label: str = "label", max_iter: int = 50, parallelism: int = 4):
    """Logistic regression per (penalty, C): score table and the model best on validation.

    `C` weighs the summed loss, hence regParam = 1 / (C n).
    """
    data = compact(df.select(features, label, "split"))
    n = data.filter(F.col("split") == "train").count()

    def fit(train, cell):
        penalty, c = cell
        return LogisticRegression(
            featuresCol=features, labelCol=label, regParam=1.0 / (c * n), maxIter=max_iter,
            elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
        ).fit(train)

    results = _grid(data, [(p, float(c)) for p in penalties for c in cs], fit, label, parallelism)
    data.unpersist()
    at = _best(results)
    rows = [(p, c, *s, i == at) for i, ((p, c), s, _) in enumerate(results)]
    schema = "penalty string, c double, train_acc double, valid_acc double, test_acc double, best boolean"
    return df.sparkSession.createDataFrame(rows, schema), results[at][2]


def probability(scored: DataFrame, out: str = "prob") -> DataFrame:
    """P(class 1) as a double column."""
    return scored.withColumn(out, F.element_at(vector_to_array("probability"), 2))


def kernel_features(df: DataFrame, kernel: str, features: str = "features", out: str = "kernel_features",
                    size: int = 100, gamma: float | None = None, seed: int = 0) -> DataFrame:
    """Explicit features whose linear SVM approximates a kernel SVM.

    'linear' and 'poly' (degree 2) are exact maps; 'rbf' uses random Fourier
    features and 'sigmoid' tanh similarities to `size` landmark rows.
    """
    if kernel == "linear":
        return df.withColumn(out, F.col(features))
    if kernel == "poly":
        return PolynomialExpansion(degree=2, inputCol=features, outputCol=out).transform(df)
    width = df.select(features).first()[0].size
    gamma = gamma or 1.0 / width
    rng = np.random.default_rng(seed)
    if kernel == "rbf":
        w, b = rng.normal(0, np.sqrt(2 * gamma), (width, size)), rng.uniform(0, 2 * np.pi, size)

        def project(x):
            return np.sqrt(2 / size) * np.cos(x @ w + b)
    elif kernel == "sigmoid":
        own = df.filter(F.col("split") == "train") if "split" in df.columns else df
        marks = own.select(features).orderBy(F.xxhash64(vector_to_array(features)), vector_to_array(features)).limit(size)
        landmarks = np.array([r[0].toArray() for r in marks.collect()])
        gram = np.tanh(gamma * landmarks @ landmarks.T)
        u, s, _ = np.linalg.svd(gram)
        keep = s > 1e-8 * s[0]
        root = u[:, keep] / np.sqrt(s[keep])

        def project(x):
            return np.tanh(gamma * x @ landmarks.T) @ root
    else:
        raise ValueError(f"unknown kernel {kernel}")

    @F.pandas_udf("array<double>")
    def expand(x: pd.Series) -> pd.Series:
        return pd.Series(list(project(np.array(x.tolist(), dtype=float))))

    return df.withColumn(out, array_to_vector(expand(vector_to_array(features))))


def svm_grid(df: DataFrame, kernels: Sequence[str] = ("linear", "poly", "rbf", "sigmoid"),
             cs: Sequence[float] = tuple(C_GRID_6), features: str = "features", label: str = "label",
             max_iter: int = 30, parallelism: int = 4):
    """SVM per (kernel, C): score table and the best (kernel, model)."""
    results = []
    base = compact(df.select(features, label, "split"))
    for kernel in kernels:
        data = compact(kernel_features(base, kernel, features).select("kernel_features", label, "split"))
        n = data.filter(F.col("split") == "train").count()

        def fit(train, cell, n=n):
            return LinearSVC(featuresCol="kernel_features", labelCol=label, regParam=1.0 / (cell[1] * n),
                             maxIter=max_iter, standardization=False).fit(train)

        results += _grid(data, [(kernel, float(c)) for c in cs], fit, label, parallelism)
        data.unpersist()
    base.unpersist()
    at = _best(results)
    rows = [(k, c, *s, i == at) for i, ((k, c), s, _) in enumerate(results)]
    schema = "kernel string, c double, train_acc double, valid_acc double, test_acc double, best boolean"
    return df.sparkSession.createDataFrame(rows, schema), (results[at][0][0], results[at][2])


def holdout_svm(df: DataFrame, times: int = 100, c: float = 100.0, frac: float = 0.7, features: str = "features",
                label: str = "label", id_col: str = "id", seed: int = 0, parallelism: int = 4) -> DataFrame:
    """Accuracy of a linear SVM over repeated random splits: `(draw, accuracy, n_test)`."""
    from newsquant.operators.sample import repeated_holdout

    data = compact(repeated_holdout(df.select(id_col, features, label), frac, times, seed, id_col))
    n = int(data.filter(F.col("draw") == 0).count() * frac)

    def run(draw):
        rows = compact(data.filter(F.col("draw") == draw))
        model = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * n), standardization=False, maxIter=30).fit(
            rows.filter(F.col("split") == "train"))
        hit = (F.col("prediction") == F.col(label)).cast("double")
        score = model.transform(rows.filter(F.col("split") == "test")).agg(F.avg(hit), F.count("*")).first()
        rows.unpersist()
        return (draw, *score)

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, range(times)))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "draw int, accuracy double, n_test long")


def state_share_logistic(df: DataFrame, columns: Sequence[str], label: str = "label"):
    """Logistic regression on regime state and cluster shares per day: model and score per split."""
    data = compact(assemble(df.dropna(subset=[*columns, label]), columns).select("features", label, "split"))
    model = LogisticRegression(labelCol=label, maxIter=50).fit(data.filter(F.col("split") == "train"))
    hit = (F.col("prediction") == F.col(label)).cast("double")
    scores = model.transform(data).groupBy("split").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))
    return model, scores
