"""K-means training and inspection of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsquant.operators.explore import top_k
from newsquant.schema import K_SWEEP


def fit_kmeans(vectors: DataFrame, k: int, seed: int = 1, max_iter: int = 20, features: str = "features") -> KMeansModel:
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features, predictionCol="cluster_id").fit(vectors)


def kmeans_sweep(vectors: DataFrame, ks: Sequence[int] = tuple(K_SWEEP), seed: int = 1, max_iter: int = 20,
                 features: str = "features") -> tuple[dict[int, KMeansModel], DataFrame]:
    """One model per K on the same cached training sample, and their scores `(k, score)`."""
    sample = vectors.select(features).persist()
    try:
        models = {k: fit_kmeans(sample, k, seed, max_iter, features) for k in ks}
    finally:
        sample.unpersist()
    rows = [(k, -float(m.summary.trainingCost)) for k, m in models.items()]
    return models, vectors.sparkSession.createDataFrame(rows, "k int, score double")


def centroid_table(spark, model: KMeansModel, shift: Sequence[float] | None = None,
                   order: Sequence[int] | None = None) -> DataFrame:
    """`(cluster_id, centroid)` of a model; optionally reordered and shifted to standardised slots.

    A centre learnt on `x / std` becomes one on `(x - mean) / std` by subtracting `mean / std`.
    """
    rows = []
    for i, c in enumerate(model.clusterCenters()):
        v = [float(x) for x in c]
        if order is not None:
            placed = [0.0] * len(v)
            for at, slot in enumerate(order):
                placed[slot] = v[at]
            v = placed
        if shift is not None:
            v = [a - b for a, b in zip(v, shift)]
        rows.append((i, v))
    return spark.createDataFrame(rows, "cluster_id int, centroid array<double>")


def lloyd_step(assigned: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector per cluster in long form `(cluster_id, dim, mean)`."""
    cells = assigned.select("cluster_id", F.posexplode(vector).alias("dim", "v"))
    return cells.groupBy("cluster_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def pack_centroids(means: DataFrame) -> DataFrame:
    """Long means back to `(cluster_id, centroid)`; one row per cluster and dimension comes in."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean")))
    return means.groupBy("cluster_id").agg(F.transform(ordered, lambda p: p["mean"]).alias("centroid"))


def kmeans_score(assigned: DataFrame) -> DataFrame:
    """Minus the sum of squared distances."""
    return assigned.agg((-F.sum(F.col("dist") * F.col("dist"))).alias("score"))


def intravariance(assigned: DataFrame) -> DataFrame:
    """Total distance and size per cluster, and over all (`cluster_id` NULL)."""
    return assigned.rollup("cluster_id").agg(F.sum("dist").alias("total"), F.count("*").alias("size"))


def cluster_contents(assigned: DataFrame, column: str, limit: int | None = None, tie: str = "event_id") -> DataFrame:
    """Members of each cluster, one row each.

    The list stays in rows because a cluster may hold a third of all events;
    `limit` gives the first few per cluster, cut before the shuffle.
    """
    rows = assigned.select("cluster_id", column, tie)
    return rows if limit is None else top_k(rows.withColumn("_o", F.lit(0)), "_o", limit, tie, ["cluster_id"]).drop("_o")


def keyword_spread(assigned: DataFrame, keyword: str, column: str = "url") -> DataFrame:
    """Clusters that contain the keyword, with the number of hits."""
    from newsquant.functions.events import contains_keyword

    return assigned.filter(contains_keyword(column, keyword)).groupBy("cluster_id").agg(F.count("*").alias("hits"))


def purity(assigned: DataFrame, label: str = "label") -> DataFrame:
    """Share of rows that carry their cluster's most frequent label."""
    cells = assigned.groupBy("cluster_id", label).agg(F.count("*").alias("n"))
    best = cells.groupBy("cluster_id").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"), F.sum("n").alias("n"))
