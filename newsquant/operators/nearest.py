"""Nearest centroid or medoid of every row, without a cross join.

The model (K rows) is bounded and checked, travels to the executors once, and
each Arrow batch is compared with all K centres by array arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsquant.functions.distance import MINI_CATEGORY, MINI_NUMERIC
from newsquant.functions.lookup import code_of
from newsquant.operators.encode import Layout

# A model larger than this (doubles) is refused: 64 M cells are 512 MB per executor.
MAX_MODEL_CELLS = 64_000_000
_BLOCK_CELLS = 4_000_000
_RESULT = "cluster_id int, dist double"


def model_rows(df: DataFrame, width: int, order: str) -> list:
    """The model's rows on the driver, in cluster order, after a size check."""
    limit = MAX_MODEL_CELLS // max(width, 1)
    rows = df.orderBy(order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"model has more than {limit} centres of width {width}")
    return rows


def _pick(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First minimum per row; differences below 1e-9 count as ties."""
    best = np.argmin(np.round(d, 9), axis=1)
    return best, d[np.arange(len(d)), best]


def _scan(total: int, k: int) -> Iterator[slice]:
    step = max(1, _BLOCK_CELLS // max(k, 1))
    for lo in range(0, total, step):
        yield slice(lo, lo + step)


def _gather_udf(spark, model: tuple):
    """Distance = base + looked-up category terms + numeric terms + dense block, minimised over centres."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def nearest(codes: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in codes:
            label, dist = _gather(pdf, shared.value)
            yield pd.DataFrame({"cluster_id": shared.value[0][label].astype("int32"), "dist": np.sqrt(np.maximum(dist, 0))})

    return once(nearest)


def once(udf):
    """Marked as not repeatable, so Spark computes it once per row instead of copying it into filters and joins."""
    return udf.asNondeterministic()


def _gather(pdf: pd.DataFrame, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and its squared distance for coded rows."""
    ids, base, tables, centres, scale, block = model
    n_cat, n_num = len(tables), centres.shape[1]
    cat = pdf.iloc[:, :n_cat].to_numpy(dtype=np.int64)
    num = pdf.iloc[:, n_cat:n_cat + n_num].to_numpy(dtype=float)
    if block is not None:
        c, width = block
        columns = [np.stack(pdf.iloc[:, j].to_numpy()) for j in range(n_cat + n_num, pdf.shape[1])] if len(pdf) else []
        dense = np.concatenate(columns, axis=1) / width if columns else np.zeros((0, len(width)))
        own, norms = (dense * dense).sum(axis=1), (c * c).sum(axis=1)
    label = np.empty(len(pdf), dtype=np.int64)
    dist = np.empty(len(pdf))
    for part in _scan(len(pdf), len(ids)):
        d = np.repeat(base[None, :], len(cat[part]), axis=0)
        for j, t in enumerate(tables):
            d += t[cat[part, j]]
        for j in range(num.shape[1]):
            gap = num[part, j][:, None] / scale[j] - centres[:, j][None, :]
            d += gap * gap
        if block is not None:
            d += own[part][:, None] - 2 * dense[part] @ c.T + norms[None, :]
        label[part], dist[part] = _pick(d)
    return label, dist


def assign_expanded(df: DataFrame, lay: Layout, stats: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of standardised one-hot events: adds `cluster_id`, `dist`.

    `centroids` is `(cluster_id, centroid array)` in standardised slots and
    `stats` is `slot_stats`. The standardised vector is dense, so it is never
    built: |z - c|^2 is the distance of the all-zero event plus one table
    look-up per category, i.e. ten additions per centroid, not `width`.
    Dense blocks (name vectors) add one matrix product.
    """
    model = _expanded_model(lay, stats, centroids)
    udf = _gather_udf(df.sparkSession, model)
    return _with_result(df, udf(F.struct(*_expanded_inputs(lay))))


def _expanded_model(lay: Layout, stats: DataFrame, centroids: DataFrame) -> tuple:
    """(ids, base, tables, centres, scale, dense block) of a model over standardised one-hot slots."""
    stat = sorted(stats.collect(), key=lambda r: r["slot"])  # `width` rows
    mean, std = np.array([r["mean"] for r in stat]), np.array([r["std"] for r in stat])
    rows = model_rows(centroids, lay.width, "cluster_id")
    c = np.array([r["centroid"] for r in rows], dtype=float)
    ids = np.array([r["cluster_id"] for r in rows])
    zero, one = -mean / std, (1 - mean) / std
    cat_slots = np.concatenate([np.arange(at, at + r.size) for r, at in lay.categories])
    base = ((zero[cat_slots] - c[:, cat_slots]) ** 2).sum(axis=1)
    tables = []
    for r, at in lay.categories:
        s = np.arange(at, at + r.size)
        change = (one[s] - c[:, s]) ** 2 - (zero[s] - c[:, s]) ** 2
        tables.append(np.vstack([np.zeros(len(c)), change.T]))  # row 0 = missing
    slots = [at for _, at in lay.numerics]
    centres = c[:, slots] + (mean / std)[slots]
    wide = [s for r, at in lay.vectors for s in range(at, at + r.size)]
    block = (c[:, wide] + (mean / std)[wide], std[wide]) if wide else None
    return ids, base, tables, centres, std[slots], block


def _expanded_inputs(lay: Layout) -> list[Column]:
    """Codes and numbers of an event; a code past its width is an error, as it would silently count as missing."""

    def code(r) -> Column:
        c = F.col(r.name)
        beyond = F.raise_error(F.concat(F.lit(f"{r.name}: code past {r.size}: "), c.cast("string"))).cast("int")
        return F.when(c.between(1, r.size), c).when(c > r.size, beyond).otherwise(0).cast("int").alias(r.name)

    return [code(r) for r, _ in lay.categories] + [
        F.coalesce(F.col(r.name).cast("double"), F.lit(0.0)).alias(r.name) for r, _ in lay.numerics] + [
        F.col(r.name).cast("array<double>").alias(r.name) for r, _ in lay.vectors]


def _mixed_model(rows: list, numeric: list[str], category: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[tuple]]:
    """(ids, numeric centres, values by category, centres that have each value) of the medoids; K entries a category."""
    ids = np.array([r["cluster_id"] for r in rows])
    centres = np.array([[float(r[c]) for c in numeric] for r in rows]).reshape(len(rows), len(numeric))
    values, holders = [], []
    for c in category:
        at: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            if r[c] is not None:
                at.setdefault(str(r[c]), []).append(k)
        values.append(list(at))
        ends = np.cumsum([0, 0, *map(len, at.values())])  # code 0, a value no medoid has, holds nothing
        holders.append((ends, np.array([k for v in at.values() for k in v], dtype=np.int64)))
    return ids, centres, values, holders


def _mixed(codes: np.ndarray, numbers: np.ndarray, centres: np.ndarray, holders: list[tuple]) -> np.ndarray:
    """Mixed distances of coded rows to all medoids: the categories less those that agree, and the numeric gaps."""
    d = np.full((len(codes), len(centres)), float(len(holders)))
    for j in range(numbers.shape[1]):
        d += np.abs(numbers[:, j][:, None] - centres[:, j][None, :])
    for j, (ends, order) in enumerate(holders):
        first, n = ends[codes[:, j]], ends[codes[:, j] + 1] - ends[codes[:, j]]
        row = np.repeat(np.arange(len(codes)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        d[row, order[place]] -= 1.0
    return d


#: Values that are compared one after another; more are looked up by checksum.
FEW_VALUES = 16


def _code(column: Column, known: list[str]) -> Column:
    if len(known) > FEW_VALUES:
        return code_of(known)(column)
    out = F.lit(0)
    for i in range(len(known), 0, -1):
        out = F.when(column == known[i - 1], i).otherwise(out)
    return out


def assign_mixed(df: DataFrame, medoids: DataFrame, numeric=tuple(MINI_NUMERIC), category=tuple(MINI_CATEGORY),
                 id_col: str = "event_id") -> DataFrame:
    """Nearest medoid under the mixed distance: adds `cluster_id`, `dist`.

    `medoids` is `(cluster_id, numeric..., category...)`. Category values that
    some medoid has are coded inside the scan; each code leads to the medoids
    that have it, so the model holds one entry per medoid and column.
    """
    rows = model_rows(medoids, len(numeric) + len(category), "cluster_id")
    ids, centres, values, holders = _mixed_model(rows, list(numeric), list(category))
    shared = df.sparkSession.sparkContext.broadcast((ids, centres, holders))
    inputs = [_code(F.col(c).cast("string"), known).cast("int").alias(c) for c, known in zip(category, values)]
    inputs += [F.col(c).cast("double").alias(c) for c in numeric]

    @F.pandas_udf(_RESULT)
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, centres, holders = shared.value
        for pdf in batches:
            codes, numbers = pdf.iloc[:, :len(holders)].to_numpy(dtype=np.int64), pdf.iloc[:, len(holders):].to_numpy(dtype=float)
            label, dist = np.empty(len(pdf), dtype=np.int64), np.empty(len(pdf))
            for part in _scan(len(pdf), len(ids)):
                label[part], dist[part] = _pick(_mixed(codes[part], numbers[part], centres, holders))
            yield pd.DataFrame({"cluster_id": ids[label].astype("int32"), "dist": dist})

    return _with_result(df, once(nearest)(F.struct(*inputs)))


def assign_dense(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Nearest centroid of an array column by Euclidean distance: adds `cluster_id`, `dist`."""
    width = len(centroids.select("centroid").first()["centroid"])
    rows = model_rows(centroids, width, "cluster_id")
    shared = df.sparkSession.sparkContext.broadcast(
        (np.array([r["cluster_id"] for r in rows]), np.array([r["centroid"] for r in rows], dtype=float))
    )

    @F.pandas_udf(_RESULT)
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, c = shared.value
        norms = (c * c).sum(axis=1)
        for vectors in batches:
            x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), c.shape[1])
            label, dist = np.empty(len(x), dtype=np.int64), np.empty(len(x))
            for part in _scan(len(x), len(ids)):
                p = x[part]
                d = (p * p).sum(axis=1)[:, None] - 2 * p @ c.T + norms[None, :]
                label[part], _ = _pick(d)
                dist[part] = np.sqrt(((p - c[label[part]]) ** 2).sum(axis=1))
            yield pd.DataFrame({"cluster_id": ids[label].astype("int32"), "dist": dist})

    return _with_result(df, once(nearest)(F.col(vector)))


def _with_result(df: DataFrame, result: Column) -> DataFrame:
    return df.withColumn("_near", result).select(*df.columns, "_near.cluster_id", "_near.dist")


def assign_models(df: DataFrame, lay: Layout, models: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Assign several models in one pass over the events: one row per (event, k) with `k`, `cluster_id`.

    One function takes the event to Python once and returns its cluster under every model.
    """
    ks = list(models)
    shared = df.sparkSession.sparkContext.broadcast([_expanded_model(lay, *models[k]) for k in ks])

    @F.pandas_udf("array<int>")
    def all_nearest(codes: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in codes:
            found = [m[0][_gather(pdf, m)[0]].astype("int32") for m in shared.value]
            yield pd.Series(list(np.stack(found, axis=1)))

    out = df.withColumn("_near", once(all_nearest)(F.struct(*_expanded_inputs(lay))))
    numbered = out.select(*df.columns, F.posexplode("_near").alias("_i", "cluster_id"))
    k = F.get(F.array(*map(F.lit, ks)), F.col("_i"))
    return numbered.select(*df.columns, k.alias("k"), "cluster_id")


def freeze(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A small model table computed once and kept as local data; larger ones are refused."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        raise ValueError(f"model table has more than {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


def event_centroids(seeds: DataFrame, lay: Layout, stats: DataFrame) -> DataFrame:
    """Standardised vectors of seed events as centroids `(cluster_id, centroid)`.

    `seeds` holds K events with their topic columns and a number `i`; like
    `stats` it is model-sized, so the K x width table is built on the driver.
    """
    stat = sorted(stats.collect(), key=lambda r: r["slot"])
    mean, std = np.array([r["mean"] for r in stat]), np.array([r["std"] for r in stat])
    out = []
    topics = [r.name for r, _ in lay.topics]
    for row in model_rows(seeds.select("i", *topics), lay.width, "i"):
        x = np.zeros(lay.width)
        for r, at in lay.topics:
            v = row[r.name]
            if r.kind == "numeric":
                x[at] = v or 0.0
            elif r.kind == "vector":
                x[at:at + r.size] = v
            elif v is not None and 1 <= v <= r.size:
                x[at + v - 1] = 1.0
        out.append((row["i"], ((x - mean) / std).tolist()))
    return seeds.sparkSession.createDataFrame(out, "cluster_id int, centroid array<double>")
