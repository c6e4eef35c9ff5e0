"""Linear models from sums of products.

The Gram matrix of a regression is a plain aggregate: rows are reduced where
they lie, in any number, and each group ends as one small array. Only the
p x p solve runs in numpy, on that array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsquant.operators.classify import compact

MAX_GRAM_FEATURES = 60


def _products(features: Sequence[str], label: str) -> list[Column]:
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    return [terms[i] * terms[j] for i in range(len(terms)) for j in range(i, len(terms))]


_MODEL = "coef array<double>, std_err array<double>, sse double, sst double, n long"


def _solve(packed: pd.Series) -> pd.DataFrame:
    """Coefficients and errors from each packed upper triangle of [1, x, y]'[1, x, y]."""
    out = []
    for values in packed:
        m = int(round((np.sqrt(8 * len(values) + 1) - 1) / 2))
        g = np.zeros((m, m))
        g[np.triu_indices(m)] = values
        g = g + np.triu(g, 1).T
        xtx, xty, yty, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
        scale = 1 / np.sqrt(np.maximum(np.diag(xtx), 1e-300))
        inverse = np.linalg.pinv(xtx * np.outer(scale, scale), rcond=1e-12, hermitian=True) * np.outer(scale, scale)
        beta = inverse @ xty
        sse = max(yty - beta @ xty, 0.0)
        free = n - len(beta)
        se = np.sqrt(np.maximum(np.diag(inverse), 0) * sse / free) if free > 0 else np.full(len(beta), np.nan)
        out.append((beta.tolist(), se.tolist(), sse, yty - xty[0] ** 2 / n, int(n)))
    return pd.DataFrame(out, columns=["coef", "std_err", "sse", "sst", "n"])


def fit_ols(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares per group: `(by..., coef, std_err, sse, sst, n)`, intercept first.

    Rows with a NULL are left out. A singular system gets the minimum-norm
    solution. For more than MAX_GRAM_FEATURES columns use `fit_linear`.
    """
    if len(features) > MAX_GRAM_FEATURES:
        raise ValueError(f"{len(features)} features; use fit_linear beyond {MAX_GRAM_FEATURES}")
    rows = df.dropna(subset=[*features, label])
    packed = F.array(*[F.sum(p) for p in _products(features, label)]).alias("_gram")
    fits = rows.groupBy(*by).agg(packed).filter(F.element_at("_gram", 1).isNotNull())
    solve = F.pandas_udf(_solve, _MODEL)
    return fits.select(*by, solve("_gram").alias("m")).select(*by, "m.*")


def predict_ols(df: DataFrame, model: DataFrame, features: Sequence[str], by: Sequence[str] = (),
                out: str = "pred") -> DataFrame:
    """Apply a fitted table; one model row per group."""
    if by:
        joined = df.join(model.select(*by, F.col("coef").alias("_coef")), list(by))
    else:
        joined = df.withColumn("_coef", model.select("coef").scalar())
    value = F.element_at("_coef", 1)
    for i, f in enumerate(features):
        value = value + F.element_at("_coef", i + 2) * F.col(f)
    return joined.withColumn(out, value).drop("_coef")


def coefficient_table(model: DataFrame, terms: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per term: `(by..., term, coef, std_err, t_stat)`."""
    names = F.array(*[F.lit(t) for t in ["intercept", *terms]])
    rows = model.select(*by, F.explode(F.arrays_zip(names.alias("term"), "coef", "std_err")).alias("r"))
    return rows.select(*by, "r.term", "r.coef", "r.std_err", F.try_divide("r.coef", "r.std_err").alias("t_stat"))


def fit_linear(df: DataFrame, features: str = "features", label: str = "label", reg: float = 0.0, l1: float = 0.0):
    """ML linear regression on a vector column for wide problems; `l1` 1 is the lasso."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=l1).fit(df)


def gaussian_glm(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Gaussian GLM with identity link: `(term, coef, std_err, t_value, p_value)`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = df.dropna(subset=[*features, label])
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    model = GeneralizedLinearRegression(family="gaussian", featuresCol="_x", labelCol=label).fit(vectors)
    s = model.summary
    # The summary lists the intercept last.
    table = list(zip(
        [*features, "intercept"], [*map(float, model.coefficients), float(model.intercept)],
        s.coefficientStandardErrors, s.tValues, s.pValues,
    ))
    return df.sparkSession.createDataFrame(table, "term string, coef double, std_err double, t_value double, p_value double")


def vif(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix; `drop` marks large ones."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    p = len(columns)
    rows = df.dropna(subset=list(columns))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_all").transform(rows).select("_all")
    r = Correlation.corr(vectors, "_all").first()[0].toArray()  # one pass, p x p numbers
    values = np.diag(np.linalg.inv(r + 1e-12 * np.eye(p)))  # stays finite for exact collinearity
    table = [(c, float(v), bool(threshold is not None and v > threshold)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(table, "column string, vif double, drop boolean")


def fit_pca(train: DataFrame, n: int | None = None, variance: float | None = None, features: str = "features",
            out: str = "pca"):
    """PCA on centred training vectors: a pipeline (centring, projection).

    `variance` keeps the fewest components that explain that share.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer

    centre = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(train)
    centred = centre.transform(train)
    width = train.select(features).first()[0].size
    k = min(n or width, width)
    if variance is None:
        return PipelineModel([centre, PCA(k=k, inputCol="_centred", outputCol=out).fit(centred)])
    model = PCA(k=k, inputCol="_centred", outputCol="_components").fit(centred)
    share = np.cumsum(model.explainedVariance.toArray())
    k = min(int(np.searchsorted(share, variance - 1e-12) + 1), k)
    return PipelineModel([centre, model, VectorSlicer(inputCol="_components", outputCol=out, indices=list(range(k)))])


def lasso_cv(df: DataFrame, lambdas: Sequence[float], folds: int = 3, features: str = "features",
             label: str = "label", order: str = "day") -> tuple[DataFrame, object]:
    """Lasso with lambda chosen by time-ordered folds: `(lambda, mae, mse, nonzero)` table and the best model.

    Fold i trains on the first i blocks of the calendar and is scored on the
    next one. Blocks are cut at quantiles of the day, not by ranking rows.
    """
    cuts = df.agg(F.percentile_approx(F.unix_date(order), [i / (folds + 1) for i in range(1, folds + 1)])).first()[0]
    block = sum([(F.unix_date(order) > c).cast("int") for c in cuts], F.lit(0))
    data = compact(df.withColumn("_block", block))
    rows = []
    for lam in lambdas:
        errors = []
        for i in range(1, folds + 1):
            model = fit_linear(data.filter(F.col("_block") < i), features, label, lam, 1.0)
            gap = F.col("prediction") - F.col(label)
            scored = model.transform(data.filter(F.col("_block") == i))
            errors.append(scored.agg(F.avg(F.abs(gap)), F.avg(gap * gap)).first())
        mae, mse = (float(np.mean([e[j] for e in errors if e[j] is not None])) for j in (0, 1))
        rows.append((float(lam), mae, mse))
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    final, table = None, []
    for lam, mae, mse in rows:
        model = fit_linear(data, features, label, lam, 1.0)
        table.append((lam, mae, mse, int(model.coefficients.numNonzeros()), lam == best))
        final = model if lam == best else final
    data.unpersist()
    return df.sparkSession.createDataFrame(table, "lambda double, mae double, mse double, nonzero int, best boolean"), final
