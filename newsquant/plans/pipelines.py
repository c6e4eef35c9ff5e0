"""Whole pipelines: cleaned news, cluster model, day summaries, joined features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.functions import events as fn
from newsquant.operators import clean, dataset, encode, nearest, series, summary
from newsquant.session import cut_lineage
from newsquant.sources import tables
from newsquant.sources.keyed import uniform_keys

# One-hot widths of the table-backed news view.
NEWS_SIZES = {"code1": 20, "code_full": 25, "country1": 25, "country2": 25}
NEWS_LAYOUT = encode.layout(NEWS_SIZES)
NEWS_K = 8

_CLEAN_INPUT = [
    "event_id", "order_no", "sqldate", "pub_day", "quad_class", "goldstein", "num_mentions", "num_sources",
    "num_articles", "avg_tone", "event_root_code", "event_code", "actor1_country", "actor2_country",
    "actor1_geo_type", "actor2_geo_type", "action_geo_type", "action_lat", "action_long",
]


def news_vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event-code and country dictionaries, read from the small dimension tables."""
    codes = clean.vocab(tables.table(spark, sf_dir, "part"), "p_brand")
    countries = tables.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country")
    )
    return codes, clean.vocab(countries, "country")


def cleaned_news(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    codes, countries = news_vocabularies(spark, sf_dir)
    raw = tables.news(spark, sf_dir, *_CLEAN_INPUT, *extra)
    return clean.clean_events(raw, codes, countries, keep=("event_id", "order_no", "sqldate", "pub_day", *extra))


def news_model(cleaned: DataFrame, k: int = NEWS_K) -> tuple[DataFrame, DataFrame]:
    """Slot statistics and k seed centroids spread over the key range, both as small local tables."""
    stats = nearest.freeze(encode.slot_stats(cleaned, NEWS_LAYOUT))
    topics = [r.name for r, _ in NEWS_LAYOUT.topics]
    seeds = uniform_keys(cleaned, k, "order_no", "event_id", topics)
    return stats, nearest.event_centroids(seeds, NEWS_LAYOUT, stats)


def assigned_news(spark: SparkSession, sf_dir: str, k: int = NEWS_K, *extra: str) -> DataFrame:
    """Cleaned events with their cluster. They are landed once: statistics, seeds and assignment read them."""
    cleaned = cut_lineage(cleaned_news(spark, sf_dir, *extra))
    stats, centroids = news_model(cleaned, k)
    return nearest.assign_expanded(cleaned, NEWS_LAYOUT, stats, centroids)


def mini_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact events for medoid clustering; the domain comes from the event's page.

    Domains are worked out once per page, before the join: many events share a page.
    """
    raw = tables.news(
        spark, sf_dir, "event_id", "order_no", "sqldate", "event_code", "quad_class", "goldstein", "actor1_name",
        "actor2_name", "is_root", "num_mentions", "num_sources", "num_articles", "avg_tone", "actor1_geo_type",
        "actor2_geo_type", "page_id",
    )
    pages = tables.spread(tables.table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    pages = pages.select("page_id", fn.url_domain("url").alias("domain"))
    full = raw.join(pages, "page_id", "left").withColumns({
        "actor1_geo": F.col("actor1_geo_type").cast("string"), "actor2_geo": F.col("actor2_geo_type").cast("string"),
    })
    return clean.mini_event(full, keep=("order_no",))


def news_vectors(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = (NEWS_K,)) -> DataFrame:
    """Day vectors `(k, day, news)` for several K from one pass over the events."""
    cleaned = cut_lineage(cleaned_news(spark, sf_dir))
    stats = nearest.freeze(encode.slot_stats(cleaned, NEWS_LAYOUT))
    topics = [r.name for r, _ in NEWS_LAYOUT.topics]
    models = {}
    for k in ks:
        seeds = uniform_keys(cleaned, k, "order_no", "event_id", topics)
        models[k] = (stats, nearest.event_centroids(seeds, NEWS_LAYOUT, stats))
    daily = summary.day_summary(nearest.assign_models(cleaned, NEWS_LAYOUT, models), "k")
    return summary.flatten_summary(daily, "k").select("k", F.col("pub_day").alias("day"), F.col("vector").alias("news"))


PRICE_COLUMNS = ["price", "ma5", "ma10", "ma30"]


def model_panel(spark: SparkSession, sf_dir: str, ks: tuple[int, ...] = (NEWS_K,), horizon: int = 1) -> DataFrame:
    """Rows (symbol, k, day): price features, returns, label, split and the day's news vector.

    Landed: fits read the panel many times, and its rows are days, while making it reads all events.
    """
    df = series.rolling_mean(tables.prices(spark, sf_dir))
    df = series.up_label(series.scaled_log_return(series.log_ret(df)), horizon, out="label")
    df = dataset.split_ratio(df.filter(F.col("ma30").isNotNull()))
    return cut_lineage(dataset.join_features(news_vectors(spark, sf_dir, ks), df))


def price_features(prices: DataFrame, horizon: int = 1) -> DataFrame:
    return series.up_label(series.rolling_mean(prices), horizon, out="label")


def joined_features(spark: SparkSession, sf_dir: str, k: int = NEWS_K) -> DataFrame:
    """Per trading day and symbol: price means, next-move label and the day's cluster mix."""
    daily = summary.day_summary(assigned_news(spark, sf_dir, k), k)
    ids = [*range(k), summary.TOTAL]
    wide = summary.wide_summary(daily, ids, measures=("share", "num_mentions")).withColumnRenamed("pub_day", "day")
    features = price_features(tables.prices(spark, sf_dir)).filter(F.col("ma30").isNotNull())
    return dataset.join_features(wide, features)
