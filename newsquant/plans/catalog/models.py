"""Queries that fit models. Closed forms have SQL; iterative fits are checked by tests."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from newsquant.operators import autoreg, classify, clusters, dataset, encode, grid, impact, linear, mixture, nearest
from newsquant.operators import regimes, series, summary
from newsquant.operators import text as words
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.explore import COUNTRIES, IMPACT_SQL, TYPES1, TYPES2, _cells_sql, _impact_input, impact_wide
from newsquant.plans.catalog.news import CLEAN_SQL
from newsquant.plans.catalog.registry import query
from newsquant.plans.catalog.text import MIN_COUNT, THRESHOLD, all_tokens
from newsquant.session import cut_lineage
from newsquant.sources import tables

W = "WINDOW w AS (PARTITION BY symbol ORDER BY day)"


@query("ols_r2", "prices", f"""
l AS (SELECT symbol, day, price AS y, LAG(price) OVER w AS x, ROW_NUMBER() OVER w - 1 AS pos,
  COUNT(*) OVER (PARTITION BY symbol) AS n FROM prices {W}),
s AS (SELECT *, CASE WHEN pos < FLOOR(n * 0.6) THEN 'train' WHEN pos < FLOOR(n * 0.8) THEN 'valid' ELSE 'test' END AS split FROM l),
m AS (SELECT symbol, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM s WHERE split = 'train' AND x IS NOT NULL GROUP BY 1)""", """
SELECT symbol, split, ROUND(1 - SUM((y - a - b * x) ** 2) / (VAR_POP(y) * COUNT(*)), 6) AS r2, COUNT(*) AS n
FROM s JOIN m USING (symbol) WHERE x IS NOT NULL GROUP BY 1, 2""")
def ols_r2(spark, sf_dir):
    from newsquant.operators import metrics

    lagged = series.lag_matrix(dataset.split_ratio(tables.prices(spark, sf_dir)), "price", [1])
    lagged = lagged.filter(F.col("lag1").isNotNull())
    model = linear.fit_ols(lagged.filter(F.col("split") == "train"), ["lag1"], "price", ["symbol"])
    scored = linear.predict_ols(lagged, model, ["lag1"], ["symbol"])
    out = metrics.regression_metrics(scored, "price", "pred", ["symbol", "split"])
    return out.select("symbol", "split", F.round("r2", 6).alias("r2"), "n")


@query("adf_stat", "prices", f"""
l AS (SELECT symbol, LAG(price) OVER w AS x, price - LAG(price) OVER w AS y FROM prices {W}),
m AS (SELECT symbol, REGR_SLOPE(y, x) AS b, SQRT((REGR_SYY(y, x) - REGR_SXY(y, x) ** 2 / REGR_SXX(y, x)) / (REGR_COUNT(y, x) - 2)
  / REGR_SXX(y, x)) AS se FROM l GROUP BY 1)""", """
SELECT symbol, ROUND(b / se, 4) AS t_stat, b / se < -2.86 AS stationary FROM m""")
def adf_stat(spark, sf_dir):
    return autoreg.adf(tables.prices(spark, sf_dir)).withColumn("t_stat", F.round("t_stat", 4))


@query("vif", "news", CLEAN_SQL + """,
r AS (SELECT CORR(num_mentions, num_articles) AS ab, CORR(num_mentions, goldstein) AS ac, CORR(num_articles, goldstein) AS bc FROM cleaned),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)""", """
SELECT 'num_mentions' AS "column", ROUND((1 - bc * bc) / det, 6) AS vif, (1 - bc * bc) / det > 5 AS drop FROM d
UNION ALL SELECT 'num_articles', ROUND((1 - ac * ac) / det, 6), (1 - ac * ac) / det > 5 FROM d
UNION ALL SELECT 'goldstein', ROUND((1 - ab * ab) / det, 6), (1 - ab * ab) / det > 5 FROM d""")
def vif(spark, sf_dir):
    out = linear.vif(pl.cleaned_news(spark, sf_dir), ["num_mentions", "num_articles", "goldstein"], 5.0)
    return out.withColumn("vif", F.round("vif", 6))


@query("glm_coef", "news prices", IMPACT_SQL + f""",
cells AS ({_cells_sql(3)}),
daily AS (SELECT sqldate AS day, SUM(impact) AS impact FROM cells GROUP BY 1),
r AS (SELECT symbol, day, price / LAG(price) OVER w - 1 AS ret FROM prices {W}),
p AS (SELECT ret AS y, impact AS x FROM r JOIN daily USING (day) WHERE ret IS NOT NULL),
m AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_SXX(y, x) AS sxx, REGR_COUNT(y, x) AS n, REGR_AVGX(y, x) AS ax,
  (REGR_SYY(y, x) - REGR_SXY(y, x) ** 2 / REGR_SXX(y, x)) / (REGR_COUNT(y, x) - 2) AS s2 FROM p)""", """
SELECT 'impact' AS term, ROUND(b, 6) AS coef, ROUND(SQRT(s2 / sxx), 6) AS std_err FROM m
UNION ALL SELECT 'intercept', ROUND(a, 6), ROUND(SQRT(s2 * (1.0 / n + ax * ax / sxx)), 6) FROM m""")
def glm_coef(spark, sf_dir):
    cells = impact.impact_cells(_impact_input(spark, sf_dir), COUNTRIES, "h3", TYPES1, TYPES2)
    daily = cut_lineage(cells.groupBy(F.col("sqldate").alias("day")).agg(F.sum("impact").alias("impact")))  # a row per day, which the fit reads several times
    rows = series.simple_ret(tables.prices(spark, sf_dir)).join(daily, "day")
    out = linear.gaussian_glm(rows, ["impact"], "ret")
    return out.select("term", F.round("coef", 6).alias("coef"), F.round("std_err", 6).alias("std_err"))


@query("ar1_walk_forward", "prices", f"""
l AS (SELECT symbol, day, LN(price) - LN(LAG(price) OVER w) AS y, LN(LAG(price) OVER w) - LN(LAG(price, 2) OVER w) AS x FROM prices {W}),
k AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos FROM l WHERE x IS NOT NULL {W}),
s AS (SELECT symbol, day, y, x, pos, REGR_SLOPE(y, x) OVER f AS b, REGR_INTERCEPT(y, x) OVER f AS a FROM k
  WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""", """
SELECT symbol, COUNT(*) AS n, ROUND(AVG(ABS(y - a - b * x)), 6) AS mae FROM s WHERE pos >= 60 GROUP BY 1""")
def ar1_walk_forward(spark, sf_dir):
    from newsquant.operators import metrics

    returns = series.lag_matrix(series.log_ret(tables.prices(spark, sf_dir)), "log_ret", [1])
    walked = dataset.walk_forward_ols(returns, "lag1", "log_ret", 60)
    return metrics.regression_metrics(walked, "actual", "pred", ["symbol"]).select("symbol", "n", F.round("mae", 6).alias("mae"))


AR_LAGS = [1, 2, 14, 20, 21]


@query("ar_forecast")
def ar_forecast(spark, sf_dir):
    """Subset AR of the log return, moving window of 250 days, with intervals."""
    returns = series.lag_matrix(series.log_ret(tables.prices(spark, sf_dir)), "log_ret", AR_LAGS)
    return autoreg.fit_ar(returns, [f"lag{n}" for n in AR_LAGS], "log_ret", window=250)


@query("arx_forecast")
def arx_forecast(spark, sf_dir):
    """AR(1) with yesterday's news volume and tone."""
    daily = tables.news(spark, sf_dir, "pub_day", "avg_tone").groupBy(F.col("pub_day").alias("day")).agg(
        F.count("*").cast("double").alias("volume"), F.avg("avg_tone").alias("tone"))
    df = series.log_ret(tables.prices(spark, sf_dir)).join(daily, "day")
    df = series.lag_matrix(df, "log_ret", [1])
    df = series.lag_matrix(series.lag_matrix(df, "volume", [1], prefix="volume"), "tone", [1], prefix="tone")
    return autoreg.fit_ar(df, ["lag1", "volume1", "tone1"], "log_ret", window=250)


@query("arma_order")
def arma_order(spark, sf_dir):
    return autoreg.arma_order(series.log_ret(tables.prices(spark, sf_dir)), [0, 1, 2, 3], [0, 1, 2], "log_ret")


def _regimes(spark, sf_dir):
    frame = series.ema(series.log_ret(tables.prices(spark, sf_dir)))
    return regimes.hmm_states(frame, restarts=3, max_iter=100)


@query("hmm_states")
def hmm_states(spark, sf_dir):
    return _regimes(spark, sf_dir)


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    """K-means on scaled sparse events; centroids in standardised slots with their sizes."""
    cleaned = cut_lineage(pl.cleaned_news(spark, sf_dir))
    stats = nearest.freeze(encode.slot_stats(cleaned, pl.NEWS_LAYOUT))
    rows = sorted(stats.collect(), key=lambda r: r["slot"])
    std, shift = [r["std"] for r in rows], [r["mean"] / r["std"] for r in rows]
    vectors = encode.sparse_vectors(cleaned, pl.NEWS_LAYOUT, std=std)
    model = clusters.fit_kmeans(vectors.select("features"), pl.NEWS_K)
    table = clusters.centroid_table(spark, model, shift, encode.slot_order(pl.NEWS_LAYOUT))
    assigned = nearest.assign_expanded(cleaned, pl.NEWS_LAYOUT, stats, table)
    return clusters.intravariance(assigned).join(table, "cluster_id")


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").select(array_to_vector("embedding").alias("features"))
    return clusters.kmeans_sweep(e, [5, 10, 20])[1]


@query("whitened_kmeans")
def whitened_kmeans(spark, sf_dir):
    """Whitening and K=8 clusters on a three-column view of the events."""
    columns = ["goldstein", "avg_tone", "num_mentions"]
    df = encode.whiten(tables.news(spark, sf_dir, "event_id", *columns).withColumn(
        "num_mentions", F.col("num_mentions").cast("double")), columns)
    model = clusters.fit_kmeans(classify.assemble(df, columns).select("features"), 8, max_iter=20)
    return clusters.centroid_table(spark, model)


def _standard_embeddings(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").withColumn("v", array_to_vector("embedding"))
    from pyspark.ml.feature import StandardScaler

    scaled = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="z").fit(e).transform(e)
    return cut_lineage(scaled.select("vec_id", "label", vector_to_array("z").alias("z")))  # every round reads it


@query("dpgmm_fit")
def dpgmm_fit(spark, sf_dir):
    table, _, _ = mixture.fit_dpgmm(_standard_embeddings(spark, sf_dir), "z", 20, 1.0)
    return table


@query("dpgmm_events")
def dpgmm_events(spark, sf_dir):
    """Mixture of at most 12 components on the expanded events, and how many events fall to each."""
    cleaned = cut_lineage(pl.cleaned_news(spark, sf_dir))
    stats = nearest.freeze(encode.slot_stats(cleaned, pl.NEWS_LAYOUT))
    table, _, _ = mixture.fit_dpgmm_events(cleaned, pl.NEWS_LAYOUT, stats, 12, 1.0)
    own = mixture.assign_mixture(cleaned, pl.NEWS_LAYOUT, stats, table).groupBy("cluster_id").agg(F.count("*").alias("events"))
    return table.join(own, "cluster_id", "left").select("cluster_id", "weight", "centroid", "n", "events")


@query("alpha_search")
def alpha_search(spark, sf_dir):
    return mixture.search_alpha(_standard_embeddings(spark, sf_dir), "z", 20)


@query("pca_variance")
def pca_variance(spark, sf_dir):
    """Fewest components that explain 95 % of the embeddings, and their share."""
    e = tables.table(spark, sf_dir, "embeddings").select(array_to_vector("embedding").alias("features"))
    _, model, chosen = linear.fit_pca(e, variance=0.95).stages
    share = model.explainedVariance.toArray()[:len(chosen.getIndices())]
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(share)], "component int, share double")


@query("grid_search")
def grid_search(spark, sf_dir):
    """Baseline and full R2 for every (symbol, K, components)."""
    panel = pl.model_panel(spark, sf_dir, (4, 8))
    return grid.grid_search(panel, pl.PRICE_COLUMNS, "scaled_log_ret", [3, 10, None])


def classifier_panel(spark, sf_dir):
    """Ratios of the price to its means and the day's news vector, labelled by the next move."""
    panel = pl.model_panel(spark, sf_dir)
    ratios = F.array(*[F.col(m) / F.col("price") for m in ("ma5", "ma10", "ma30")], F.coalesce("log_ret", F.lit(0.0)))
    vector = array_to_vector(F.concat(ratios, F.slice("news", 1, F.size("news") - 1)))
    return panel.filter(F.col("label").isNotNull()).select("symbol", "day", "label", "split", vector.alias("features"))


@query("logistic_grid")
def logistic_grid(spark, sf_dir):
    return classify.logistic_grid(classifier_panel(spark, sf_dir), cs=classify.C_GRID_10)[0]


@query("svm_grid")
def svm_grid(spark, sf_dir):
    panel = classifier_panel(spark, sf_dir)
    pca = linear.fit_pca(panel.filter(F.col("split") == "train"), variance=0.99)
    small = pca.transform(panel).select("label", "split", F.col("pca").alias("features"))
    return classify.svm_grid(small, cs=classify.C_GRID_6)[0]


def _impact_panel(spark, sf_dir):
    """Banded returns beside the day's impact per (country, type, sign)."""
    names, wide = impact_wide(spark, sf_dir)
    wide = cut_lineage(wide)  # a row per day, read several times by the fits
    renamed = wide.select(F.col("sqldate").alias("day"), *[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(names)])
    merged = dataset.merge_returns(series.simple_ret(tables.prices(spark, sf_dir)), renamed).filter(F.col("class").isNotNull())
    merged = merged.fillna(0.0, [f"x{i}" for i in range(len(names))])
    return merged, [f"x{i}" for i in range(len(names))]


@query("holdout_svm")
def holdout_svm(spark, sf_dir):
    merged, columns = _impact_panel(spark, sf_dir)
    data = classify.assemble(merged, columns).select(
        F.concat("symbol", F.col("day").cast("string")).alias("id"), "features", (F.col("class") > 0).cast("int").alias("label"))
    return classify.holdout_svm(data, times=100)


@query("lasso_cv")
def lasso_cv(spark, sf_dir):
    merged, columns = _impact_panel(spark, sf_dir)
    data = classify.assemble(merged, columns).select("day", "features", F.col("ret").alias("label"))
    return linear.lasso_cv(data, [10.0 ** e for e in range(-5, 1)], folds=3)[0]


@query("word2vec")
def word2vec(spark, sf_dir):
    """Unit word vectors of the documents' phrase-merged tokens; every word has one."""
    merged, _ = words.phrases(all_tokens(spark, sf_dir), MIN_COUNT, THRESHOLD)
    _, vectors = words.fit_word2vec(merged, dim=100, min_count=1)
    return vectors.select("word", vector_to_array("vector").alias("vector"))


@query("share_logistic")
def share_logistic(spark, sf_dir):
    """Accuracy of regime state and cluster shares as predictors of the next move."""
    states = _regimes(spark, sf_dir).select("symbol", "day", "state")
    daily = summary.day_summary(pl.assigned_news(spark, sf_dir), pl.NEWS_K)
    shares = summary.wide_summary(daily, list(range(pl.NEWS_K))).withColumnRenamed("pub_day", "day")
    bound = dataset.bind_states(shares, states)
    moves = dataset.split_ratio(series.up_label(tables.prices(spark, sf_dir), 1, out="label")).drop("price")
    columns = ["state", *[f"share_{i}" for i in range(pl.NEWS_K)]]
    return classify.state_share_logistic(bound.join(moves, ["symbol", "day"]), columns)[1]
