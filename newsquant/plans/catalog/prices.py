"""Queries on price series and their join with news."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.operators import dataset, series
from newsquant.plans.catalog.registry import query
from newsquant.sources import tables

W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("rolling_means", "prices", "", f"""
SELECT symbol, day, CASE WHEN n >= 5 THEN ROUND(ma5, 6) END AS ma5, CASE WHEN n >= 10 THEN ROUND(ma10, 6) END AS ma10,
  CASE WHEN n >= 30 THEN ROUND(ma30, 6) END AS ma30 FROM (SELECT symbol, day, ROW_NUMBER() OVER w AS n,
  AVG(price) OVER (w ROWS 4 PRECEDING) AS ma5, AVG(price) OVER (w ROWS 9 PRECEDING) AS ma10,
  AVG(price) OVER (w ROWS 29 PRECEDING) AS ma30 FROM prices {W}) q""")
def rolling_means(spark, sf_dir):
    out = series.rolling_mean(tables.prices(spark, sf_dir)).drop("price")
    return rounded(out, 6, "ma5", "ma10", "ma30")


@query("price_moves", "prices", "", f"""
SELECT symbol, day, ROUND(price - LAG(price) OVER w, 6) AS diff, COALESCE(CAST(price > LAG(price) OVER w AS INT), 0) AS up,
  CAST(LEAD(price) OVER w > price AS INT) AS next_up,
  CAST(TRUNC(1e6 * LN(price)) AS BIGINT) - LAG(CAST(TRUNC(1e6 * LN(price)) AS BIGINT)) OVER w AS scaled_log_ret,
  ROUND(price / LAG(price) OVER w - 1, 6) AS ret, ROUND(LN(price) - LN(LAG(price) OVER w), 6) AS log_ret
FROM prices {W}""")
def price_moves(spark, sf_dir):
    df = series.diff(tables.prices(spark, sf_dir))
    df = series.up_label(series.up_label(df, 0), 1, out="next_up")
    df = series.log_ret(series.simple_ret(series.scaled_log_return(df)))
    return rounded(df, 6, "diff", "ret", "log_ret").drop("price")


@query("ema_returns", "prices", """
numbered AS (SELECT symbol, day, price, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day) AS i FROM prices),
walk AS (SELECT symbol, i, x FROM (SELECT symbol, 14 AS i, AVG(price) AS x FROM numbered WHERE i <= 14 GROUP BY 1 HAVING COUNT(*) = 14) s),
rec AS (WITH RECURSIVE r(symbol, i, x) AS (SELECT symbol, i, x FROM walk
  UNION ALL SELECT n.symbol, n.i, n.price * (2.0::DOUBLE / 15) + r.x * (13.0::DOUBLE / 15) FROM r JOIN numbered n ON n.symbol = r.symbol AND n.i = r.i + 1)
  SELECT * FROM r),
filled AS (SELECT n.symbol, n.day, n.i, CASE WHEN n.i <= 14 THEN f.x ELSE r.x END AS ema FROM numbered n
  LEFT JOIN rec r ON r.symbol = n.symbol AND r.i = n.i LEFT JOIN rec f ON f.symbol = n.symbol AND f.i = 15)""", """
SELECT symbol, day, ROUND(ema, 3) AS ema, ROUND(CASE WHEN i = 1 THEN 0 ELSE LN(ema) - LN(LAG(ema) OVER w) END, 6) AS ret_ema
FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY day)""")
def ema_returns(spark, sf_dir):
    out = series.ema(tables.prices(spark, sf_dir)).drop("price")
    return out.withColumns({"ema": F.round("ema", 3), "ret_ema": F.round("ret_ema", 6)})


@query("lag_matrix", "prices", "", "SELECT symbol, day, price, " + ", ".join(
    f"LAG(price, {n}) OVER w AS lag{n}" for n in (1, 2, 14, 20, 21)) + f" FROM prices {W}")
def lag_matrix(spark, sf_dir):
    return series.lag_matrix(tables.prices(spark, sf_dir), "price")


_ACF = """
c AS (SELECT symbol, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day) AS i, price - AVG(price) OVER (PARTITION BY symbol) AS d FROM prices),
sums AS (SELECT a.symbol, CAST(l AS INT) AS lag, SUM(a.d * b.d) AS s FROM c a CROSS JOIN range(0, 21) t(l)
  JOIN c b ON b.symbol = a.symbol AND b.i = a.i - l GROUP BY 1, 2),
rho AS (SELECT s.symbol, s.lag, s.s / z.s AS acf, n FROM sums s JOIN sums z ON z.symbol = s.symbol AND z.lag = 0
  JOIN (SELECT symbol, COUNT(*) AS n FROM prices GROUP BY 1) k ON k.symbol = s.symbol)"""


@query("acf", "prices", _ACF, "SELECT symbol, lag, ROUND(acf, 6) AS acf, ROUND(1.96 / SQRT(n), 6) AS band FROM rho")
def acf(spark, sf_dir):
    return rounded(series.acf(tables.prices(spark, sf_dir), 20), 6, "acf", "band")


@query("pacf", "prices", _ACF + """,
arr AS (SELECT symbol, list(acf ORDER BY lag) AS r FROM rho GROUP BY 1)""", """
SELECT symbol, CAST(k AS INT) AS lag, ROUND(p, 6) AS pacf FROM (
  WITH RECURSIVE d AS (
    SELECT symbol, 1 AS k, [r[2]] AS phi, r[2] AS p FROM arr
    UNION ALL
    SELECT symbol, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - q * phi[k + 1 - j]), q), q FROM (
      SELECT d.symbol, d.k, d.phi, (a.r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * a.r[k + 2 - j])))
        / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * a.r[j + 1]))) AS q
      FROM d JOIN arr a ON a.symbol = d.symbol WHERE k < 20) s)
  SELECT symbol, k, p FROM d) t""")
def pacf(spark, sf_dir):
    return rounded(series.pacf(tables.prices(spark, sf_dir), 20), 6, "pacf")


_RUNS = """
ups AS (SELECT symbol, day, COALESCE(CAST(price > LAG(price) OVER w AS INT), 0) AS up FROM prices
        WINDOW w AS (PARTITION BY symbol ORDER BY day)),
marks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day)
            - ROW_NUMBER() OVER (PARTITION BY symbol, up ORDER BY day) AS g FROM ups)"""


@query("state_runs", "prices", _RUNS, """
SELECT symbol, up AS state, MIN(day) AS start, MAX(day) AS "end", COUNT(*) AS n FROM marks GROUP BY symbol, up, g""")
def state_runs(spark, sf_dir):
    return series.state_runs(series.up_label(tables.prices(spark, sf_dir), 0), "up")


@query("volatility", "prices", f"""
r AS (SELECT symbol, price / LAG(price) OVER w - 1 AS ret FROM prices {W})""", """
SELECT symbol, ROUND(STDDEV_SAMP(ret), 6) AS volatility FROM r GROUP BY 1""")
def volatility(spark, sf_dir):
    out = series.volatility(series.simple_ret(tables.prices(spark, sf_dir)), "ret")
    return rounded(out, 6, "volatility")


@query("outer_returns", "news prices", f"""
r AS (SELECT symbol, day, price / LAG(price) OVER w - 1 AS ret FROM prices {W}),
daily AS (SELECT pub_day AS day, COUNT(*) AS n_events, ROUND(AVG(goldstein), 8) AS mean_goldstein FROM news GROUP BY 1)""", """
SELECT r.symbol, r.day, ROUND(r.ret, 6) AS ret, CASE WHEN r.ret > 0.005 THEN 1 WHEN r.ret < -0.005 THEN -1 END AS class,
  d.n_events, d.mean_goldstein FROM r FULL JOIN daily d ON d.day = r.day WHERE r.ret IS NOT NULL""")
def outer_returns(spark, sf_dir):
    returns = series.simple_ret(tables.prices(spark, sf_dir)).drop("price")
    daily = tables.news(spark, sf_dir, "pub_day", "goldstein").groupBy(F.col("pub_day").alias("day")).agg(
        F.count("*").alias("n_events"), F.round(F.avg("goldstein"), 8).alias("mean_goldstein"))
    return dataset.merge_returns(returns, daily).withColumn("ret", F.round("ret", 6))


@query("news_days_only", "news prices", "", """
SELECT symbol, COUNT(*) AS n FROM prices WHERE day IN (SELECT pub_day FROM news) GROUP BY 1""")
def news_days_only(spark, sf_dir):
    days = tables.news(spark, sf_dir, "pub_day").select(F.col("pub_day").alias("day"))
    return dataset.restrict_days(tables.prices(spark, sf_dir), days).groupBy("symbol").agg(F.count("*").alias("n"))


@query("walk_forward", "prices", f"""
l AS (SELECT symbol, day, price AS y, LAG(price) OVER w AS x FROM prices {W}),
k AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos FROM l WHERE x IS NOT NULL {W}),
s AS (SELECT symbol, day, y, x, pos, REGR_SLOPE(y, x) OVER f AS b, REGR_INTERCEPT(y, x) OVER f AS a FROM k
  WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""", """
SELECT symbol, day, ROUND(a + b * x, 2) AS pred, y AS actual FROM s WHERE pos >= 60""")
def walk_forward(spark, sf_dir):
    lagged = series.lag_matrix(tables.prices(spark, sf_dir), "price", [1])
    return rounded(dataset.walk_forward_ols(lagged, "lag1", "price", 60), 2, "pred")
