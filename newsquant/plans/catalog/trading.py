"""Queries on back-tests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.functions.events import sign_label
from newsquant.operators import dataset, metrics, series, trading
from newsquant.plans.catalog.registry import query
from newsquant.sources import tables

CAPITAL = 15.0
VARIANCE = 0.02

JOINED_SQL = """
smooth AS (SELECT symbol, day, CASE WHEN ROW_NUMBER() OVER w >= 30 THEN AVG(price) OVER (w ROWS 29 PRECEDING) END AS price
           FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day)),
bets AS (SELECT f.symbol, f.day, s.price, EXP(f.mean) - 1 AS e FROM forecasts f LEFT JOIN smooth s USING (symbol, day)
         WHERE s.price IS NOT NULL)"""


def path_sql(rates: str) -> str:
    return JOINED_SQL + f""",
f AS (SELECT b.*, CAST(r AS DOUBLE) AS r, SIGN(e) * GREATEST(ABS(e) - r, 0) / {VARIANCE} AS f FROM bets b CROSS JOIN {rates}),
g AS (SELECT *, ROW_NUMBER() OVER w AS step, (1 - f) * CASE WHEN f > 1 THEN 1 + r ELSE 1 END + f * LEAD(price) OVER w / price AS k
      FROM f WINDOW w AS (PARTITION BY symbol, r ORDER BY day)),
path AS (SELECT symbol, r, day, CAST(step AS INT) AS step, f AS fraction, {CAPITAL} * COALESCE(PRODUCT(k) OVER (PARTITION BY symbol, r
      ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS wealth FROM g
  UNION ALL SELECT symbol, r, day, 0, 0, {CAPITAL} FROM g WHERE step = 1)"""


def bets(spark, sf_dir):
    """Forecasts beside the full 30-row price means they trade."""
    prices = tables.prices(spark, sf_dir)
    smooth = series.rolling_mean(prices, [30]).select("symbol", "day", F.col("ma30").alias("price"))
    joined = dataset.join_price(tables.forecasts(prices), smooth).filter(F.col("price").isNotNull())
    full = joined.withColumns({"hi": F.col("mean") + F.col("half"), "lo": F.col("mean") - F.col("half")})
    return trading.price_moments(full).withColumn("variance", F.lit(VARIANCE))


@query("kelly_path", "prices forecasts", path_sql("(VALUES (0.0)) v(r)"), """
SELECT symbol, r, day, step, ROUND(fraction, 6) AS fraction, ROUND(wealth, 6) AS wealth FROM path""")
def kelly_path(spark, sf_dir):
    path = trading.kelly(bets(spark, sf_dir), CAPITAL)
    return path.select("symbol", "r", "day", "step", F.round("fraction", 6).alias("fraction"), F.round("wealth", 6).alias("wealth"))


@query("kelly_fold", "prices forecasts", path_sql("(VALUES (0.005)) v(r)"), """
SELECT symbol, r, day, step, ROUND(fraction, 6) AS fraction, ROUND(wealth, 6) AS wealth FROM path""")
def kelly_fold(spark, sf_dir):
    path = trading.kelly(bets(spark, sf_dir), CAPITAL, 0.005, "fold")
    return path.select("symbol", "r", "day", "step", F.round("fraction", 6).alias("fraction"), F.round("wealth", 6).alias("wealth"))


_METRICS = """
SELECT symbol, r, ROUND(MAX_BY(wealth, step) / 15 - 1, 6) AS total_return, ROUND(STDDEV_SAMP(wealth / 15 - 1), 6) AS std,
  ROUND(MAX(ABS(fraction)), 6) AS max_leverage FROM path GROUP BY 1, 2"""


def _round3(df):
    return df.withColumns({c: F.round(c, 6) for c in ("total_return", "std", "max_leverage")})


@query("kelly_metrics", "prices forecasts", path_sql("(VALUES (0.0)) v(r)"), _METRICS)
def kelly_metrics(spark, sf_dir):
    return _round3(trading.kelly_metrics(trading.kelly(bets(spark, sf_dir), CAPITAL), CAPITAL))


@query("kelly_sweep", "prices forecasts", path_sql("(SELECT i / 1000.0::DOUBLE AS r FROM range(0, 101) t(i)) v"), _METRICS)
def kelly_sweep(spark, sf_dir):
    return _round3(trading.kelly_sweep(bets(spark, sf_dir), [i / 1000 for i in range(101)], CAPITAL))


@query("forecast_moments", "prices forecasts", "", """
SELECT symbol, day, ROUND(EXP(mean) - 1, 6) AS expected,
  ROUND((EXP(v) - 1) * EXP(2 * mean + v), 8) AS variance
FROM (SELECT *, POWER(half * 2 / 4, 2) AS v FROM forecasts) q""")
def forecast_moments(spark, sf_dir):
    f = tables.forecasts(tables.prices(spark, sf_dir))
    f = f.withColumns({"hi": F.col("mean") + F.col("half"), "lo": F.col("mean") - F.col("half")})
    return trading.price_moments(f).select(
        "symbol", "day", F.round("expected", 6).alias("expected"), F.round("variance", 8).alias("variance"))


_BINARY = """
SELECT {by}n, tp, fp, fn, tn, ROUND((tp + tn) / CAST(n AS DOUBLE), 8) AS accuracy, ROUND(pr, 8) AS precision, ROUND(re, 8) AS recall,
  ROUND(COALESCE(2 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 8) AS f1, ROUND((tp + tn) / CAST(n AS DOUBLE), 8) AS recall_w,
  ROUND(re * pr + (1 - re) * (tp + fn) / CAST(n AS DOUBLE), 8) AS ap
FROM (SELECT *, COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS pr, COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS re FROM (
  SELECT {by}COUNT(*) AS n, COUNT(*) FILTER (y = 1 AND p = 1) AS tp, COUNT(*) FILTER (y = 0 AND p = 1) AS fp,
    COUNT(*) FILTER (y = 1 AND p = 0) AS fn, COUNT(*) FILTER (y = 0 AND p = 0) AS tn FROM scored {group}) a) b"""

SCORES_SQL = """
base AS (SELECT quality AS y, toxic, n_chars / CAST((SELECT MAX(n_chars) FROM documents) AS DOUBLE) AS prob
         FROM labels JOIN documents USING (doc_id))"""


def _scores(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    top = docs.agg(F.max("n_chars").cast("double").alias("m")).scalar()
    return tables.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y"), "toxic", (F.col("n_chars") / top).alias("prob"))


def _round_scores(df):
    return df.withColumns({c: F.round(c, 8) for c in ("accuracy", "precision", "recall", "f1", "recall_w", "ap")})


@query("binary_metrics", "", SCORES_SQL + ", scored AS (SELECT y, toxic AS p FROM base)", _BINARY.format(by="", group=""))
def binary_metrics(spark, sf_dir):
    return _round_scores(metrics.classification_metrics(_scores(spark, sf_dir), "y", "toxic"))


_CUTS = "(VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) v(cutoff)"


@query("cutoff_metrics", "", SCORES_SQL + f", scored AS (SELECT y, cutoff, CAST(prob > cutoff AS INT) AS p FROM base CROSS JOIN {_CUTS})",
       _BINARY.format(by="cutoff, ", group="GROUP BY 1"))
def cutoff_metrics(spark, sf_dir):
    return _round_scores(metrics.cutoff_metrics(_scores(spark, sf_dir), "y", "prob"))


@query("cutoff_metrics_inverted", "", SCORES_SQL
       + f", scored AS (SELECT y, cutoff, CAST(1 - prob > cutoff AS INT) AS p FROM base CROSS JOIN {_CUTS})",
       _BINARY.format(by="cutoff, ", group="GROUP BY 1"))
def cutoff_metrics_inverted(spark, sf_dir):
    return _round_scores(metrics.cutoff_metrics(_scores(spark, sf_dir), "y", "prob", invert=True))


_ACTUAL = """
actuals AS (SELECT symbol, day, LN(price) - LN(LAG(price) OVER w) AS y FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day)),
pairs AS (SELECT f.symbol, f.mean AS p, f.half, a.y FROM forecasts f JOIN actuals a USING (symbol, day) WHERE a.y IS NOT NULL)"""


def _forecast_pairs(spark, sf_dir):
    prices = tables.prices(spark, sf_dir)
    return dataset.join_price(tables.forecasts(prices), series.log_ret(prices), "inner").filter(F.col("log_ret").isNotNull())


@query("regression_metrics", "prices forecasts", _ACTUAL, """
SELECT symbol, COUNT(*) AS n, ROUND(AVG(ABS(y - p)), 6) AS mae, ROUND(AVG(CAST((y > 0) = (p > 0) AS INT)), 6) AS sign_accuracy,
  ROUND(1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*)), 6) AS r2 FROM pairs GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    out = metrics.regression_metrics(_forecast_pairs(spark, sf_dir), "log_ret", "mean", ["symbol"])
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "sign_accuracy", "r2")})


@query("interval_coverage", "prices forecasts", _ACTUAL, """
SELECT symbol, ROUND(AVG(CAST(y BETWEEN p - half AND p + half AS INT)), 6) AS coverage FROM pairs GROUP BY 1""")
def interval_coverage(spark, sf_dir):
    pairs = _forecast_pairs(spark, sf_dir).withColumns({"lo": F.col("mean") - F.col("half"), "hi": F.col("mean") + F.col("half")})
    return metrics.interval_coverage(pairs, "log_ret", "lo", "hi", ["symbol"]).withColumn("coverage", F.round("coverage", 6))


RUNS_SQL = """
runs AS (SELECT o_orderkey % 15 AS k, (o_orderkey * 31 % 1000) / 1000.0::DOUBLE AS train_error,
  (o_orderkey * 17 % 997) / 997.0::DOUBLE AS test_error FROM orders)"""


def runs(spark, sf_dir):
    o = F.col("o_orderkey")
    return tables.table(spark, sf_dir, "orders").select(
        (o % 15).alias("k"), ((o * 31 % 1000) / F.lit(1000.0)).alias("train_error"),
        ((o * 17 % 997) / F.lit(997.0)).alias("test_error"))


@query("error_by_k", "", RUNS_SQL, """
SELECT k, ROUND(AVG(train_error), 6) AS train_mean, ROUND(STDDEV_POP(train_error), 6) AS train_std, ROUND(AVG(test_error), 6) AS test_mean,
  ROUND(STDDEV_POP(test_error), 6) AS test_std, ROUND(MIN(test_error), 6) AS best, COUNT(*) AS n FROM runs GROUP BY 1""")
def error_by_k(spark, sf_dir):
    out = metrics.error_by_k(runs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("k", "n")})


@query("improvement_rank", "", RUNS_SQL + """,
full_model AS (SELECT k, MAX(1 - test_error) AS test_r2 FROM runs GROUP BY 1),
base_model AS (SELECT k, AVG(1 - train_error) AS b FROM runs GROUP BY 1)""", """
SELECT k, ROUND(test_r2, 6) AS test_r2, ROUND(b, 6) AS baseline_test_r2, ROUND(test_r2 - b, 6) AS improvement
FROM full_model JOIN base_model USING (k) ORDER BY improvement DESC, k""")
def improvement_rank(spark, sf_dir):
    r = runs(spark, sf_dir)
    full = r.groupBy("k").agg(F.max(1 - F.col("test_error")).alias("test_r2"))
    base = r.groupBy("k").agg(F.avg(1 - F.col("train_error")).alias("test_r2"))
    out = metrics.improvement(full, base, ["k"])
    out = out.withColumns({c: F.round(c, 6) for c in ("test_r2", "baseline_test_r2", "improvement")})
    return metrics.rank_results(out, "improvement", ["k"])


@query("best_params", "", RUNS_SQL.replace("FROM orders", ", o_orderkey AS grid FROM orders"), """
SELECT k, grid, ROUND(1 - test_error, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY test_error, grid) AS rn FROM runs) q
WHERE rn = 1""")
def best_params(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 15).alias("k"), F.col("o_orderkey").alias("grid"),
        (-((F.col("o_orderkey") * 17 % 997) / F.lit(997.0))).alias("neg"))
    best = metrics.best_params(o, "neg", "grid", ["k"])
    return best.select("k", "grid", F.round(1 + F.col("neg"), 6).alias("score"))


@query("sign_labels", "prices forecasts", "", """
SELECT symbol, CAST(mean > 0 AS INT) AS label, COUNT(*) AS n FROM forecasts GROUP BY 1, 2""")
def sign_labels(spark, sf_dir):
    f = tables.forecasts(tables.prices(spark, sf_dir))
    return f.groupBy("symbol", sign_label("mean").alias("label")).agg(F.count("*").alias("n"))
