"""From raw event files to scored forecasts: land, sample, train, summarise, evaluate.

    python -m newsquant.plans.stages prepare RAW OUT [--symbol XAG] [--lo DAY] [--hi DAY]
    python -m newsquant.plans.stages train CLEANED MODELS --ks 30,100 --per-day 150
    python -m newsquant.plans.stages summarise CLEANED MODELS OUT
    python -m newsquant.plans.stages stream RAW CLEANED MODELS OUT [--delay-days 2]
    python -m newsquant.plans.stages evaluate SUMMARIES PRICES OUT --components 3,10,none --window 250

Stages meet in Parquet partitioned by publication day, so each can be rerun
alone and reads only the columns and days it needs.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from newsquant.operators import arma, clean, clusters, dataset, encode, grid, lasso, metrics, mixture, nearest, sample, series, summary
from newsquant.session import build_session, cut_lineage
from newsquant.sources.events import day_range, read_events, write_stage
from newsquant.sources.prices import pivot_fields, read_prices
from newsquant.sources.results import write_results
from newsquant.streaming.day_summary import stream_events, summarise_stream


def prepare(spark: SparkSession, raw: str, out: str, symbol: str = "EVERYTHING", lo: str | None = None,
            hi: str | None = None, event_codes: str | None = None, country_codes: str | None = None) -> None:
    """Clean the events of a day range and land them by day.

    Dictionaries are text files with one code per line; without a file the
    codes come from the data of the first range (both actors' countries) and
    are saved beside `out`, so that later ranges use the same numbers.
    """
    typed = clean.normalise_events(read_events(spark, raw, lo, hi))

    def codes(path: str | None, name: str, columns: Sequence[str]) -> DataFrame:
        if path is not None:
            return clean.vocab(spark.read.text(path).select(F.trim("value").alias(name)), name)
        saved = f"{out.rstrip('/')}.codes/{name}"
        try:
            return spark.read.parquet(saved)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        values = typed.select(F.explode(F.array(*columns)).alias(name))
        clean.vocab(values, name).coalesce(1).write.parquet(saved)
        return spark.read.parquet(saved)

    countries = codes(country_codes, "country", ["actor1_country", "actor2_country"])
    df = clean.clean_events(typed, codes(event_codes, "event_code", ["event_code"]), countries, symbol=symbol)
    write_stage(df, out)


def cleaner(spark: SparkSession, cleaned: str, symbol: str = "EVERYTHING") -> Callable[[DataFrame], DataFrame]:
    """The cleaning of `prepare` with the dictionaries it saved, for batches of a stream."""
    folder = f"{cleaned.rstrip('/')}.codes"

    def clean_batch(raw: DataFrame) -> DataFrame:
        codes, countries = (raw.sparkSession.read.parquet(f"{folder}/{name}") for name in ("event_code", "country"))
        return clean.clean_events(clean.normalise_events(raw), codes, countries, symbol=symbol)

    return clean_batch


def train(spark: SparkSession, cleaned: str, models: str, ks: Sequence[int], per_day: int = 150, seed: int = 0,
          max_iter: int = 20) -> DataFrame:
    """Fit one model per K on the same equal-allocation sample; `(k, score)`.

    The sample's statistics and all centroids are saved as two small tables.
    """
    events = sample.sample_per_day(spark.read.parquet(cleaned), per_day, seed)
    lay = encode.layout()
    stats = nearest.freeze(encode.slot_stats(events, lay))
    rows = sorted(stats.collect(), key=lambda r: r["slot"])
    vectors = encode.sparse_vectors(events, lay, std=[r["std"] for r in rows])
    fitted, scores = clusters.kmeans_sweep(vectors, ks, seed, max_iter)
    shift, order = [r["mean"] / r["std"] for r in rows], encode.slot_order(lay)
    stats.write.mode("overwrite").parquet(f"{models}/stats")
    for k, model in fitted.items():
        table = clusters.centroid_table(spark, model, shift, order)
        table.write.mode("overwrite").parquet(f"{models}/centroids/k={k}")
    return scores


def train_mixture(spark: SparkSession, cleaned: str, models: str, n_max: int, alpha: float, per_day: int = 150, seed: int = 0) -> float:
    """Fit a Dirichlet-process mixture of at most `n_max` components on the same kind of sample; its mean log-likelihood.

    Saved beside the sample's statistics; `summarise_mixture` applies it.
    """
    events = cut_lineage(sample.sample_per_day(spark.read.parquet(cleaned), per_day, seed))
    lay = encode.layout()
    stats = nearest.freeze(encode.slot_stats(events, lay))
    model, score, _ = mixture.fit_dpgmm_events(events, lay, stats, n_max, alpha, seed=seed)
    stats.write.mode("overwrite").parquet(f"{models}/stats")
    model.write.mode("overwrite").parquet(f"{models}/mixture")
    return score


def summarise_mixture(spark: SparkSession, cleaned: str, models: str, out: str, lo: str | None = None, hi: str | None = None) -> None:
    """Assign every event to its most probable component and write the day summaries, K being the mixture's limit."""
    stats, model = (nearest.freeze(spark.read.parquet(f"{models}/{name}")) for name in ("stats", "mixture"))
    events = day_range(spark.read.parquet(cleaned), lo, hi)
    assigned = mixture.assign_mixture(events, encode.layout(), stats, model).withColumn("k", F.lit(model.count()))
    write_stage(summary.day_summary(assigned, "k"), out, ("k", "pub_day"))


def summarise(spark: SparkSession, cleaned: str, models: str, out: str, lo: str | None = None, hi: str | None = None) -> None:
    """Assign every event to all saved models in one pass and write the day summaries by K."""
    stats = nearest.freeze(spark.read.parquet(f"{models}/stats"))
    centroids = spark.read.parquet(f"{models}/centroids")
    ks = sorted(r["k"] for r in centroids.select("k").distinct().collect())
    saved = {k: (stats, centroids.filter(F.col("k") == k).select("cluster_id", "centroid")) for k in ks}
    events = day_range(spark.read.parquet(cleaned), lo, hi)
    assigned = nearest.assign_models(events, encode.layout(), saved)
    write_stage(summary.day_summary(assigned, "k"), out, ("k", "pub_day"))


#: Fields that may hold a series' price, the first one a row has counts.
PRICE_FIELDS = ["price", "adjusted", "close", "mid_price", "value"]
MEANS = (5, 10, 30)


def price_panel(spark: SparkSession, prices: str, ratios: Sequence[float] = (60.0, 20.0, 20.0)) -> DataFrame:
    """Price features of all files of a glob: rolling means, returns, next-move label, chronological split.

    Days before the longest mean is full are left out, and so are prices that are not positive.
    """
    wide = pivot_fields(read_prices(spark, prices), PRICE_FIELDS)
    rows = wide.select("symbol", "day", F.coalesce(*PRICE_FIELDS).alias("price")).filter(F.col("price") > 0)
    rows = series.up_label(series.scaled_log_return(series.log_ret(series.rolling_mean(rows, MEANS))), 1, out="label")
    return dataset.split_ratio(rows.filter(F.col(f"ma{max(MEANS)}").isNotNull()), ratios)


def evaluate(spark: SparkSession, summaries: str, prices: str, out: str, components: Sequence[int | None] = (3, 10, None),
             window: int = 250, ps: Sequence[int] = (0, 1, 2), qs: Sequence[int] = (0, 1, 2),
             penalties: Sequence[float] = (0.2, 0.1, 0.05), lasso_clusters: int = 0) -> DataFrame:
    """Join day summaries with prices, fit and rank the models, and write what they give under `out`.

    `grid`: R2 of price-only and price + news regressions per (symbol, K,
    components), a text sorted by validation R2. `balance`: label counts per
    split. `forecasts`: one-step forecasts of ARMA and, for every K, of a lasso
    on yesterday's news, day by day. `scores`: their error, sign accuracy and,
    for ARMA, interval coverage, best first within a series. The lasso reads the
    shares of the `lasso_clusters` lowest cluster numbers and the total, all
    of them for 0. Returns the scores.
    """
    panel = cut_lineage(price_panel(spark, prices))
    daily = spark.read.parquet(summaries)
    vectors = summary.flatten_summary(daily, "k").select("k", F.col("pub_day").alias("day"), F.col("vector").alias("news"))
    both = dataset.join_features(vectors, panel)
    table = grid.grid_search(both, ["price", *[f"ma{n}" for n in MEANS]], "scaled_log_ret", components)
    write_results(table, f"{out}/grid", "r2_valid")
    dataset.class_balance(panel.filter(F.col("label").isNotNull()), "label", ["symbol", "split"]).write.mode("overwrite").parquet(f"{out}/balance")

    walked = arma.arma_forecast(panel, ps, qs, window).select(
        "symbol", F.concat(F.lit("arma"), F.col("p").cast("string"), F.col("q").cast("string")).alias("model"), "day", "mean", "lo", "hi", "actual")
    for k in sorted(r["k"] for r in daily.select("k").distinct().collect()):
        ids = [*range(min(k, lasso_clusters) if lasso_clusters else k), summary.TOTAL]
        shares = summary.wide_summary(daily.filter(F.col("k") == k), ids).withColumnRenamed("pub_day", "day")
        columns = [c for c in shares.columns if c != "day"]
        rows = panel.select("symbol", "day", "log_ret").join(shares, "day", "left").fillna(0.0, columns)
        lagged = rows.select("symbol", "day", "log_ret", F.lag("log_ret").over(series.by_day()).alias("lag1"),
                             *[F.lag(c).over(series.by_day()).alias(c) for c in columns])
        sparse = lasso.lasso_forecast(lagged, ["lag1", *columns], "log_ret", window, penalties)
        name = F.concat_ws("-", F.lit(f"lasso-k{k}"), F.col("penalty").cast("string"))
        none = F.lit(None).cast("double")
        walked = walked.unionByName(sparse.select("symbol", name.alias("model"), "day", F.col("pred").alias("mean"), none.alias("lo"), none.alias("hi"), "actual"))
    walked.write.mode("overwrite").partitionBy("model").parquet(f"{out}/forecasts")
    walked = spark.read.parquet(f"{out}/forecasts")
    scores = metrics.regression_metrics(walked, "actual", "mean", ["symbol", "model"]).join(
        metrics.interval_coverage(walked.filter("lo is not null"), "actual", "lo", "hi", ["symbol", "model"]), ["symbol", "model"], "left")
    ranked = metrics.rank_results(scores, "sign_accuracy", ["mae", "symbol", "model"])
    ranked.coalesce(1).write.mode("overwrite").parquet(f"{out}/scores")
    return spark.read.parquet(f"{out}/scores")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    stages = parser.add_subparsers(dest="stage", required=True)
    p = stages.add_parser("prepare")
    p.add_argument("raw")
    p.add_argument("out")
    p.add_argument("--symbol", default="EVERYTHING")
    p.add_argument("--event-codes")
    p.add_argument("--country-codes")
    t = stages.add_parser("train")
    t.add_argument("cleaned")
    t.add_argument("models")
    t.add_argument("--ks", default="30,100,300")
    t.add_argument("--per-day", type=int, default=150)
    t.add_argument("--mixture", type=int, default=0, help="fit a mixture of at most so many components instead")
    t.add_argument("--alpha", type=float, default=1.0)
    s = stages.add_parser("summarise")
    s.add_argument("cleaned")
    s.add_argument("models")
    s.add_argument("out")
    w = stages.add_parser("stream")
    for name in ("raw", "cleaned", "models", "out"):
        w.add_argument(name)
    w.add_argument("--delay-days", type=int, default=2)
    e = stages.add_parser("evaluate")
    e.add_argument("summaries")
    e.add_argument("prices")
    e.add_argument("out")
    e.add_argument("--components", default="3,10,none")
    e.add_argument("--window", type=int, default=250)
    e.add_argument("--penalties", default="0.2,0.1,0.05")
    e.add_argument("--lasso-clusters", type=int, default=0)
    s.add_argument("--mixture", action="store_true")
    for q in (p, s):
        q.add_argument("--lo")
        q.add_argument("--hi")
    a = parser.parse_args(argv)
    spark = build_session()
    if a.stage == "prepare":
        prepare(spark, a.raw, a.out, a.symbol, a.lo, a.hi, a.event_codes, a.country_codes)
    elif a.stage == "train" and a.mixture:
        print(train_mixture(spark, a.cleaned, a.models, a.mixture, a.alpha, a.per_day))
    elif a.stage == "train":
        train(spark, a.cleaned, a.models, [int(k) for k in a.ks.split(",")], a.per_day).show()
    elif a.stage == "stream":
        writer = summarise_stream(stream_events(spark, a.raw), a.models, a.out, encode.layout(), cleaner(spark, a.cleaned), delay_days=a.delay_days)
        writer.option("checkpointLocation", f"{a.out}/mark").start().awaitTermination()
    elif a.stage == "evaluate":
        components = [None if n == "none" else int(n) for n in a.components.split(",")]
        evaluate(spark, a.summaries, a.prices, a.out, components, a.window, penalties=[float(v) for v in a.penalties.split(",")],
                 lasso_clusters=a.lasso_clusters).show()
    else:
        (summarise_mixture if a.mixture else summarise)(spark, a.cleaned, a.models, a.out, a.lo, a.hi)


if __name__ == "__main__":
    main()
