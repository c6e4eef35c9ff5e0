"""Queries of moving-window forecasts: ARMA with refit and lasso."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.operators import arma, autoreg, grid, lasso, metrics, series
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.news import CLEAN_SQL
from newsquant.plans.catalog.registry import query
from newsquant.sources import tables

W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"
RETURNS_SQL = f"""
lr AS (SELECT symbol, day, LN(price) - LN(LAG(price) OVER w) AS y FROM prices {W}),
r AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos FROM lr WHERE y IS NOT NULL {W})"""
WINDOW = 250
SHORT = 60
PS, QS = [0, 1, 2], [0, 1, 2]


def _returns(spark, sf_dir):
    return series.log_ret(tables.prices(spark, sf_dir))


def _news_returns(spark, sf_dir):
    """Returns beside the news volume and tone of the trading day before."""
    daily = tables.news(spark, sf_dir, "pub_day", "avg_tone").groupBy(F.col("pub_day").alias("day")).agg(
        F.log1p(F.count("*")).alias("volume"), F.avg("avg_tone").alias("tone"))
    rows = _returns(spark, sf_dir).join(daily, "day", "left").fillna(0.0, ["volume", "tone"])
    rows = series.lag_matrix(rows, "volume", [1], prefix="volume")
    return series.lag_matrix(rows, "tone", [1], prefix="tone")


@query("ar2_in_sample", "prices", RETURNS_SQL + f""",
l AS (SELECT symbol, day, y, LAG(y) OVER w AS a, LAG(y, 2) OVER w AS b FROM r {W}),
c AS (SELECT symbol, COUNT(*) AS n, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab,
  COVAR_POP(y, a) AS ya, COVAR_POP(y, b) AS yb, VAR_POP(y) AS yy FROM l WHERE b IS NOT NULL GROUP BY 1),
m AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q FROM c),
f AS (SELECT symbol, y, my + p * (a - ma) + q * (b - mb) AS mean, 1.96 * SQRT(n * (yy - p * ya - q * yb) / (n - 3)) AS half FROM l JOIN m USING (symbol)
  WHERE b IS NOT NULL)""", """
SELECT symbol, COUNT(*) AS n, ROUND(AVG(ABS(y - mean)), 6) AS mae, ROUND(AVG(half), 6) AS half,
  ROUND(AVG(CAST(y BETWEEN mean - half AND mean + half AS INT)), 6) AS coverage FROM f GROUP BY 1""")
def ar2_in_sample(spark, sf_dir):
    """AR(2) over the whole series, with its interval."""
    out = autoreg.fit_ar(series.lag_matrix(_returns(spark, sf_dir), "log_ret", [1, 2]), ["lag1", "lag2"], "log_ret")
    return out.groupBy("symbol").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("actual") - F.col("mean"))), 6).alias("mae"),
        F.round(F.avg((F.col("hi") - F.col("lo")) / 2), 6).alias("half"),
        F.round(F.avg(F.col("actual").between(F.col("lo"), F.col("hi")).cast("double")), 6).alias("coverage"))


_PARTS = ("train", "valid", "test")


@query("grid_baseline", "news prices", CLEAN_SQL + f""",
l AS (SELECT symbol, day, price, CAST(TRUNC(1000000.0::DOUBLE * LN(price)) AS BIGINT) AS level, ROW_NUMBER() OVER w AS rn FROM prices {W}),
d AS (SELECT *, level - LAG(level) OVER w AS y FROM l {W}),
o AS (SELECT symbol, day, price, y, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY symbol) AS n FROM d WHERE rn >= 30 {W}),
s AS (SELECT *, CASE WHEN pos < FLOOR(n * 0.6) THEN 'train' WHEN pos < FLOOR(n * 0.8) THEN 'valid' ELSE 'test' END AS split
  FROM o JOIN (SELECT DISTINCT pub_day AS day FROM cleaned) q USING (day)),
m AS (SELECT symbol, REGR_SLOPE(y, price) AS b, REGR_INTERCEPT(y, price) AS a FROM s WHERE split = 'train' GROUP BY 1)""", f"""
SELECT symbol, {pl.NEWS_K} AS k, CAST(COUNT(*) AS INT) AS num_days, {', '.join(
    f"ROUND(1 - SUM((y - a - b * price) ** 2) FILTER (split = '{p}') / (VAR_POP(y) FILTER (split = '{p}') * COUNT(*) FILTER (split = '{p}')), 6) "
    f"AS baseline_r2_{p}" for p in _PARTS)} FROM s JOIN m USING (symbol) GROUP BY 1""")
def grid_baseline(spark, sf_dir):
    """The price-only side of the grid search, with the price as its one column."""
    table = grid.grid_search(pl.model_panel(spark, sf_dir), ["price"], "scaled_log_ret", [3])
    return table.select("symbol", "k", "num_days", *[F.round(f"baseline_r2_{p}", 6).alias(f"baseline_r2_{p}") for p in _PARTS])


@query("arma_refit")
def arma_refit(spark, sf_dir):
    """ARMA forecast of every day after the first window, order chosen on that window."""
    return arma.arma_forecast(_returns(spark, sf_dir), PS, QS, WINDOW)


@query("armax_refit")
def armax_refit(spark, sf_dir):
    """The same with yesterday's news."""
    return arma.arma_forecast(_news_returns(spark, sf_dir), PS, QS, WINDOW, exog=["volume1", "tone1"])


@query("arma_scores")
def arma_scores(spark, sf_dir):
    """Error, sign accuracy and interval coverage per series."""
    out = arma.arma_forecast(_returns(spark, sf_dir), PS, QS, WINDOW)
    scores = metrics.regression_metrics(out, "actual", "mean", ["symbol"])
    return scores.join(metrics.interval_coverage(out, "actual", "lo", "hi", ["symbol"]), "symbol")


@query("arma_ar1_refit", "prices", RETURNS_SQL + f""",
p AS (SELECT symbol, day, y, pos, LAG(y) OVER w AS x FROM r {W}),
s AS (SELECT symbol, day, y, x, pos, REGR_SLOPE(y, x) OVER f AS b, REGR_INTERCEPT(y, x) OVER f AS a,
  REGR_SYY(y, x) OVER f AS syy, REGR_SXY(y, x) OVER f AS sxy, REGR_SXX(y, x) OVER f AS sxx FROM p
  WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {SHORT - 1} PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, a + b * x AS mean, 1.96 * SQRT((syy - sxy * sxy / sxx) / {SHORT - 3}) AS half FROM s WHERE pos >= {SHORT})""", """
SELECT symbol, day, 1 AS p, 0 AS q, ROUND(mean, 6) AS mean, ROUND(mean - half, 6) AS lo, ROUND(mean + half, 6) AS hi,
  ROUND(y, 6) AS actual FROM m""")
def arma_ar1_refit(spark, sf_dir):
    """The general refit at order (1, 0), where it must equal windowed regression."""
    out = arma.arma_forecast(_returns(spark, sf_dir), [1], [0], SHORT)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "lo", "hi", "actual")})


THETAS = [-0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75]


@query("ma1_profile", "prices", RETURNS_SQL + f""",
d AS (SELECT symbol, pos, y - AVG(y) OVER (PARTITION BY symbol) AS d FROM r),
t AS (SELECT UNNEST({THETAS}::DOUBLE[]) AS theta),
e AS (SELECT a.symbol, a.pos, theta, SUM(POWER(-theta, a.pos - b.pos) * b.d) AS e
  FROM d a JOIN d b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos - 150 AND a.pos, t GROUP BY ALL),
s AS (SELECT symbol, theta, SUM(e * e) AS sse, COUNT(*) AS n FROM e GROUP BY ALL)""", """
SELECT symbol, theta, ROUND(sse, 6) AS sse, n, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY sse, theta) = 1 AS best FROM s""")
def ma1_profile(spark, sf_dir):
    """Innovations of a moving average with given coefficients; the SQL sums their expansion, which has died out after 150 terms."""
    return arma.ma_profile(_returns(spark, sf_dir), THETAS).withColumn("sse", F.round("sse", 6))


@query("arma_aic_window", "prices", RETURNS_SQL + f""",
p AS (SELECT symbol, y, LAG(y) OVER w AS x, pos, MAX(pos) OVER (PARTITION BY symbol) AS last FROM r {W}),
f AS (SELECT symbol, VAR_POP(y) * COUNT(*) AS sse0, REGR_SYY(y, x) - REGR_SXY(y, x) ** 2 / REGR_SXX(y, x) AS sse1, COUNT(*) AS n
  FROM p WHERE pos BETWEEN 1 AND {SHORT - 1} AND last >= {SHORT - 1} GROUP BY 1),
a AS (SELECT symbol, 0 AS p, n * LN(sse0 / n) + 4 AS aic FROM f UNION ALL SELECT symbol, 1, n * LN(sse1 / n) + 6 FROM f)""", """
SELECT symbol, p, 0 AS q, ROUND(aic, 6) AS aic, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY aic, p) = 1 AS best FROM a""")
def arma_aic_window(spark, sf_dir):
    return arma.arma_aic(_returns(spark, sf_dir), [0, 1], [0], SHORT).withColumn("aic", F.round("aic", 6))


#: Sparsities in standard deviations of the return; the first keeps least.
LAMBDAS = [0.2, 0.1, 0.05]


def _news_panel(spark, sf_dir):
    """Returns, their lags and the news vector of the trading day before, one column each."""
    width = (pl.NEWS_K + 1) * 8 + 1
    news = pl.news_vectors(spark, sf_dir).select("day", *[F.get("news", F.lit(i)).alias(f"n{i}") for i in range(width)])
    rows = _returns(spark, sf_dir).join(news, "day", "left").fillna(0.0, [f"n{i}" for i in range(width)])
    rows = rows.withColumns({f"news{i}": F.lag(f"n{i}").over(series.by_day()) for i in range(width)})
    rows = series.lag_matrix(rows, "log_ret", [1, 2, 14, 20, 21])
    return rows, [f"lag{n}" for n in (1, 2, 14, 20, 21)] + [f"news{i}" for i in range(width)]


@query("lasso_moving")
def lasso_moving(spark, sf_dir):
    """Forecasts at three sparsities per day from lags and yesterday's news, and the one that folds in time prefer."""
    rows, columns = _news_panel(spark, sf_dir)
    return lasso.lasso_forecast(rows, columns, "log_ret", WINDOW, LAMBDAS, folds=3)


@query("lasso_scores")
def lasso_scores(spark, sf_dir):
    """Error and sign accuracy per series and sparsity, and of the sparsity chosen in each window (penalty null)."""
    out = lasso_moving(spark, sf_dir)
    rows = out.select("symbol", F.explode(F.when(F.col("best"), F.array("penalty", F.lit(None))).otherwise(F.array("penalty"))).alias("penalty"), "pred", "actual")
    return metrics.regression_metrics(rows, "actual", "pred", ["symbol", "penalty"])


@query("lasso_orthonormal", "prices", RETURNS_SQL + f""",
x AS (SELECT symbol, day, pos, y, CASE WHEN pos % 4 < 2 THEN 1.0 ELSE -1.0 END AS a, CASE WHEN pos % 2 = 0 THEN 1.0 ELSE -1.0 END AS b,
  CASE WHEN pos % 4 IN (0, 3) THEN 1.0 ELSE -1.0 END AS c FROM r),
s AS (SELECT *, AVG(y) OVER f AS m, STDDEV_POP(y) OVER f AS sd, AVG(y * a) OVER f AS ya, AVG(y * b) OVER f AS yb, AVG(y * c) OVER f AS yc
  FROM x WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {SHORT} PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, UNNEST({LAMBDAS}::DOUBLE[]) AS penalty FROM s WHERE pos >= {SHORT}),
t AS (SELECT *, SIGN(ya) * GREATEST(ABS(ya / sd) - penalty, 0) AS ta, SIGN(yb) * GREATEST(ABS(yb / sd) - penalty, 0) AS tb,
  SIGN(yc) * GREATEST(ABS(yc / sd) - penalty, 0) AS tc FROM l)""", """
SELECT symbol, day, penalty, ROUND(m + sd * (ta * a + tb * b + tc * c), 6) AS pred,
  CAST(CAST(ta <> 0 AS INT) + CAST(tb <> 0 AS INT) + CAST(tc <> 0 AS INT) AS INT) AS nonzero FROM t""")
def lasso_orthonormal(spark, sf_dir):
    """Three orthogonal columns, where the lasso is the soft threshold of their correlations."""
    place = F.row_number().over(series.by_day()) - 1
    rows = _returns(spark, sf_dir).filter(F.col("log_ret").isNotNull()).withColumn("pos", place)

    def sign(condition):
        return F.when(condition, 1.0).otherwise(-1.0)

    rows = rows.withColumns({"a": sign(F.col("pos") % 4 < 2), "b": sign(F.col("pos") % 2 == 0), "c": sign((F.col("pos") % 4).isin(0, 3))})
    out = lasso.lasso_forecast(rows, ["a", "b", "c"], "log_ret", SHORT, LAMBDAS)
    return out.select("symbol", "day", "penalty", F.round("pred", 6).alias("pred"), "nonzero")


@query("lasso_one_column", "prices", RETURNS_SQL + f""",
p AS (SELECT symbol, day, y, pos, LAG(y) OVER w AS x FROM r {W}),
s AS (SELECT *, AVG(y) OVER f AS my, AVG(x) OVER f AS mx, STDDEV_POP(y) OVER f AS sy, STDDEV_POP(x) OVER f AS sx, CORR(y, x) OVER f AS c
  FROM p WHERE x IS NOT NULL WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {SHORT} PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, UNNEST({LAMBDAS}::DOUBLE[]) AS penalty FROM s WHERE pos > {SHORT})""", """
SELECT symbol, penalty, COUNT(*) AS n, ROUND(AVG(ABS(y - my - sy / sx * SIGN(c) * GREATEST(ABS(c) - penalty, 0) * (x - mx))), 6) AS mae
FROM l GROUP BY 1, 2""")
def lasso_one_column(spark, sf_dir):
    rows = series.lag_matrix(_returns(spark, sf_dir), "log_ret", [1])
    out = lasso.lasso_forecast(rows, ["lag1"], "log_ret", SHORT, LAMBDAS)
    return metrics.regression_metrics(out, "actual", "pred", ["symbol", "penalty"]).select("symbol", "penalty", "n", F.round("mae", 6).alias("mae"))
