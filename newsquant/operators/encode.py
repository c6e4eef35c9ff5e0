"""One-hot expansion, column statistics and standardisation of cleaned events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions.events import one_hot_index
from newsquant.schema import EVENT_ROLES, Role


@dataclass(frozen=True)
class Layout:
    """Slot positions of the expanded vector: topics first, importance last."""

    roles: tuple[Role, ...]

    @property
    def topics(self) -> list[tuple[Role, int]]:
        out, at = [], 0
        for r in self.roles:
            if r.kind == "categorical":
                out.append((r, at))
                at += r.size
            elif r.kind == "numeric":
                out.append((r, at))
                at += 1
            elif r.kind == "vector":
                out.append((r, at))
                at += r.size
        return out

    @property
    def width(self) -> int:
        return sum(1 if r.kind == "numeric" else r.size for r, _ in self.topics)

    @property
    def importance(self) -> list[str]:
        return [r.name for r in self.roles if r.kind == "importance"]

    @property
    def categories(self) -> list[tuple[Role, int]]:
        return [(r, at) for r, at in self.topics if r.kind == "categorical"]

    @property
    def numerics(self) -> list[tuple[Role, int]]:
        return [(r, at) for r, at in self.topics if r.kind == "numeric"]

    @property
    def vectors(self) -> list[tuple[Role, int]]:
        return [(r, at) for r, at in self.topics if r.kind == "vector"]


def layout(sizes: dict[str, int] | None = None, roles: Sequence[Role] = EVENT_ROLES, names: int = 0) -> Layout:
    """Layout of `roles`, with other one-hot widths if `sizes` names them.

    Text columns have no slots; with `names` each becomes a dense block of that
    many slots, for an array column of the same name (see `text.name_vectors`).
    """
    sizes = sizes or {}
    out = [replace(r, size=sizes.get(r.name, r.size)) for r in roles]
    if names:
        out = [replace(r, kind="vector", size=names) if r.kind == "string" else r for r in out]
    return Layout(tuple(out))


def slot_pairs(lay: Layout, missing: str = "zero") -> list[Column]:
    """`(slot, value)` of every topic column of a row; slot NULL where the cell is zero."""
    pairs = []
    for r, at in lay.topics:
        if r.kind == "vector":
            cells = [(at + i, F.get(F.col(r.name), F.lit(i)).cast("double")) for i in range(r.size)]
            pairs += [F.struct(F.when(v != 0, F.lit(i)).cast("int").alias("slot"), v.alias("value")) for i, v in cells]
            continue
        if r.kind == "categorical":
            slot = (F.lit(at) + one_hot_index(F.col(r.name), r.size, missing)).cast("int")
            value = F.lit(1.0)
        else:
            slot = F.when(F.col(r.name) != 0, F.lit(at)).cast("int")
            value = F.col(r.name).cast("double")
        pairs.append(F.struct(slot.alias("slot"), value.alias("value")))
    return pairs


def expand(df: DataFrame, lay: Layout, id_col: str = "event_id", missing: str = "zero") -> DataFrame:
    """Long sparse vector `(id, slot, value)`, about ten rows per event.

    Importance columns follow the topic slots.
    """
    pairs = slot_pairs(lay, missing)
    for i, c in enumerate(lay.importance):
        slot = F.when(F.col(c) != 0, F.lit(lay.width + i)).cast("int")
        pairs.append(F.struct(slot.alias("slot"), F.col(c).cast("double").alias("value")))
    cells = df.select(id_col, F.explode(F.array(*pairs)).alias("p")).select(id_col, "p.slot", "p.value")
    return cells.filter(F.col("slot").isNotNull())


def slot_stats(df: DataFrame, lay: Layout) -> DataFrame:
    """Mean and population std of every topic slot, `(slot, mean, std)`; std 0 becomes 1.

    Zeros are never materialised: sums over the non-zero cells and the row
    count are enough, and partial sums combine map-side over `width` keys.
    Dense blocks are summed as vectors, not cell by cell.
    """
    if lay.vectors:
        parts = [r for r in lay.roles if r.kind != "vector"]
        return _renumbered(slot_stats(df, Layout(tuple(parts))), Layout(tuple(parts)), lay).unionByName(_dense_stats(df, lay))
    row = F.struct(F.lit(-1).alias("slot"), F.lit(1.0).alias("value"))  # slot -1 counts the rows
    cells = df.select(F.explode(F.array(row, *slot_pairs(lay))).alias("p")).select("p.slot", "p.value")
    seen = cells.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    every = df.sparkSession.range(-1, lay.width).select(F.col("id").cast("int").alias("slot"))
    full = every.join(seen, "slot", "left").fillna(0.0, ["s1", "s2"])
    n = F.max(F.when(F.col("slot") == -1, F.col("s1"))).over(Window.partitionBy())  # `width` + 1 rows
    full = full.withColumn("n", n).filter(F.col("slot") >= 0)
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    return full.select("slot", mean.alias("mean"), F.when(var > 1e-24, F.sqrt(var)).otherwise(1.0).alias("std"))


def _renumbered(stats: DataFrame, part: Layout, lay: Layout) -> DataFrame:
    """Slots of a layout without its dense blocks, numbered as in the whole one."""
    at = {r.name: a for r, a in lay.topics}
    shift = F.lit(0)
    for r, a in part.topics:
        shift = F.when(F.col("slot") >= a, at[r.name] - a).otherwise(shift)
    return stats.withColumn("slot", (F.col("slot") + shift).cast("int"))


def _dense_stats(df: DataFrame, lay: Layout) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    whole = array_to_vector(F.concat(*[F.col(r.name).cast("array<double>") for r, _ in lay.vectors]))
    sums = df.select(whole.alias("_v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s"))
    cells = sums.select("s.count", F.posexplode(F.arrays_zip(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))).alias("i", "c"))
    slots = F.array(*[F.lit(at + i) for r, at in lay.vectors for i in range(r.size)])
    var = F.col("c.variance") * (F.col("count") - 1) / F.col("count")  # of the population
    return cells.select(F.get(slots, F.col("i")).alias("slot"), F.col("c.mean").alias("mean"),
                        F.when(var > 1e-24, F.sqrt(var)).otherwise(1.0).alias("std"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(column, mean, std)` of dense numeric columns; population std, 0 becomes 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"),
                 F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std"))
        for c in columns
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.mean", "r.std")


def standardise(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(x - mean) / std` in place; the statistics may come from another sample.

    `stats` is reduced to one map and read as a scalar subquery: no join.
    """
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std")))).alias("m"))
    m = packed.scalar()
    return df.withColumns({c: (F.col(c) - m[c]["mean"]) / m[c]["std"] for c in columns})


def whiten(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the population std without centring."""
    stats = column_stats(df, columns).withColumn("mean", F.lit(0.0))
    return standardise(df, stats, columns)


def sparse_vectors(df: DataFrame, lay: Layout, out: str = "features", std: Sequence[float] | None = None) -> DataFrame:
    """ML vector column of the topic slots, sparse and divided by `std`.

    Distances do not change under centring, so training on the scaled vectors
    finds the same clusters as on fully standardised ones and keeps sparsity.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    def word(r, slot: int):
        c = F.col(r.name)
        beyond = F.raise_error(F.concat(F.lit(f"{r.name}: code past {r.size}: "), c.cast("string"))).cast("string")
        return F.when(c.between(1, r.size), (F.lit(slot) + c - 1).cast("string")).when(c > r.size, beyond)

    words = [word(r, slot) for r, slot in lay.categories]
    order = slot_order(lay)
    n_hot = sum(r.size for r, _ in lay.categories)
    hot = CountVectorizerModel.from_vocabulary([str(s) for s in order[:n_hot]], inputCol="_tokens", outputCol="_hot")
    tokens = df.withColumn("_tokens", F.array_compact(F.array(*words)))
    dense = {f"_vector_{r.name}": array_to_vector(F.col(r.name).cast("array<double>")) for r, _ in lay.vectors}
    tokens = tokens.withColumns(dense) if dense else tokens
    packed = VectorAssembler(inputCols=["_hot", *[r.name for r, _ in lay.numerics], *dense], outputCol="_raw")
    scale = [1.0 / std[s] for s in order] if std is not None else [1.0] * len(order)
    scaler = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_raw", outputCol=out)
    return scaler.transform(packed.transform(hot.transform(tokens))).drop("_tokens", "_hot", "_raw", *dense)


def slot_order(lay: Layout) -> list[int]:
    """Slot behind each position of `sparse_vectors` (categories first, then numbers, then dense blocks)."""
    order = [s for r, at in lay.categories for s in range(at, at + r.size)]
    return order + [at for _, at in lay.numerics] + [s for r, at in lay.vectors for s in range(at, at + r.size)]
