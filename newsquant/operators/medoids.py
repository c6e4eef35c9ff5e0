"""K-medoids under the mixed distance, without comparing members pairwise.

The sum of distances from one row to its cluster separates by column. For a
number it follows from counts and sums below and above the value; for a
category it is the cluster size minus the frequency of the value. Both come
from counts per (cluster, column, value), which are small beside the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from newsquant.functions.distance import MINI_CATEGORY, MINI_NUMERIC
from newsquant.operators.nearest import assign_mixed, freeze, once
from newsquant.operators.ranking import value_prefix
from newsquant.session import cut_lineage, discard, free_shuffles, ship_package
from newsquant.sources.keyed import uniform_keys


def _cell(column: str, number: bool) -> Column:
    """`(column, key, v)` of a row: a number as `v`, a category as `key` behind a sign that tells it from null."""
    c = F.col(column)
    key = F.lit(None).cast("string") if number else F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c))
    v = c.cast("double") if number else F.lit(None).cast("double")
    return F.struct(F.lit(column).alias("column"), key.alias("key"), v.alias("v"))


def _cells(assigned: DataFrame, numeric: Sequence[str], category: Sequence[str]) -> DataFrame:
    """One row per event and column: `(cluster_id, column, key, v)`."""
    cells = [_cell(c, True) for c in numeric] + [_cell(c, False) for c in category]
    return assigned.select("cluster_id", F.explode(F.array(*cells)).alias("c")).select("cluster_id", "c.*")


def value_costs(assigned: DataFrame, numeric: Sequence[str] = tuple(MINI_NUMERIC),
                category: Sequence[str] = tuple(MINI_CATEGORY)) -> DataFrame:
    """Share of the cost that each value of each column carries: `(cluster_id, column, key, v, cost)`."""
    counts = _cells(assigned, numeric, category).groupBy("cluster_id", "column", "key", "v").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)  # read several times below; the events are scanned once
    numbers = counts.filter(F.col("column").isin(*numeric)).withColumn("s", F.col("v") * F.col("n"))
    ranked = value_prefix(numbers, ["cluster_id", "column"], "v", ["n", "s"])
    below = F.col("v") * F.col("n_upto") - F.col("s_upto")
    above = F.col("s_all") - F.col("s_upto") - F.col("v") * (F.col("n_all") - F.col("n_upto"))
    words = counts.filter(F.col("column").isin(*category))
    size = words.groupBy("cluster_id", "column").agg(F.sum("n").alias("size"))
    mismatches = F.col("size") - F.when(F.col("key") == "", 0).otherwise(F.col("n"))
    out = ranked.select("cluster_id", "column", "key", "v", (below + above).alias("cost")).unionByName(
        words.join(size, ["cluster_id", "column"]).select("cluster_id", "column", "key", "v", mismatches.cast("double").alias("cost"))
    )
    out._reads = (counts, *ranked._reads)
    return out


#: Values of a cost table that travel to the tasks; columns with more are joined.
MAX_CELLS = 2_000_000


def _looked_up(assigned: DataFrame, costs: DataFrame, columns: dict[str, Column]) -> Column | None:
    """Sum of the costs of some columns by look-up in the scan, if no two cells of a column share a hash.

    Every cell of an event is in the table, as the table counts these events,
    so a hash that is unique in the table cannot stand for another cell.
    """
    rows = costs.filter(F.col("column").isin(*columns)).select(
        F.array_position(F.array(*map(F.lit, columns)), F.col("column")).alias("at"), F.xxhash64("cluster_id", "key", "v").alias("h"), "cost").toArrow()
    at, hashes, values = (rows[c].to_numpy() for c in ("at", "h", "cost"))
    tables = []  # a table per column, so that most of them are small
    for i in range(1, len(columns) + 1):
        own = np.flatnonzero(at == i)
        own = own[np.argsort(hashes[own])]
        if (hashes[own][1:] == hashes[own][:-1]).any():
            return None
        tables.append((hashes[own], values[own]))
    shared = assigned.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("double")
    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            out = np.zeros(len(pdf))
            for j, (known, cost) in enumerate(shared.value):
                if len(pdf):
                    out += cost[np.searchsorted(known, pdf.iloc[:, j].to_numpy())]
            yield pd.Series(out)

    hashed = {c: F.xxhash64("cluster_id", cell["key"], cell["v"]) for c, cell in columns.items()}
    return once(total)(F.struct(*[h.alias(c) for c, h in hashed.items()]))


def medoid_costs(assigned: DataFrame, numeric: Sequence[str] = tuple(MINI_NUMERIC),
                 category: Sequence[str] = tuple(MINI_CATEGORY), id_col: str = "event_id") -> DataFrame:
    """`(id, cluster_id, cost)`: each row's sum of distances to its own cluster (itself included).

    Costs of columns with few values are looked up where the rows lie. Only
    columns whose table is too large to travel are joined, one after another, so
    an event stays one row and its parts need no grouping by id.
    """
    parts = value_costs(assigned, numeric, category)
    costs = cut_lineage(parts)
    discard(*parts._reads)
    sizes = {r["column"]: r["n"] for r in costs.groupBy("column").agg(F.count("*").alias("n")).collect()}
    small, left = [], MAX_CELLS
    for c in sorted([*numeric, *category], key=lambda c: sizes.get(c, 0)):
        left -= sizes.get(c, 0)
        if left >= 0:
            small.append(c)
    cells = {c: _cell(c, c in numeric) for c in small}
    near = _looked_up(assigned, costs, cells) if small else F.lit(0.0)
    if near is None:
        small, near = [], F.lit(0.0)
    large = [c for c in [*numeric, *category] if c not in small]
    total = assigned.select(F.col(id_col), "cluster_id", *[_cell(c, c in numeric)["v" if c in numeric else "key"].alias(f"_cell_{c}") for c in large],
                            near.alias("_cost"))
    for c in large:
        side = costs.filter(F.col("column") == c).select(
            "cluster_id", F.col("v" if c in numeric else "key").alias(f"_cell_{c}"), F.col("cost").alias("_more"))
        total = total.join(side, ["cluster_id", f"_cell_{c}"], "left").withColumn("_cost", F.col("_cost") + F.col("_more")).drop(f"_cell_{c}", "_more")
    return total.select(id_col, "cluster_id", F.col("_cost").alias("cost"))


#: Values of a column that have a code of their own, cells of a joint code of several columns, rows whose costs are compared exactly, codes counted at once.
MAX_CODES, MAX_JOINT, MAX_RIVALS, AT_ONCE = 1 << 16, 1 << 16, 100_000, 1 << 19
#: Codes of categories: null, a value without a code, then the values of the table.
NULL, RARE, KNOWN = 0, 1, 2


class Coded:
    """Events as a few joint codes of their columns, landed once and read by every round.

    Columns with few values share a joint code. A category with more than
    `MAX_CODES` values has codes for its most frequent ones and keeps its text
    for the others, none of which is more frequent than any of those.
    """

    def __init__(self, events: DataFrame, numeric: Sequence[str], category: Sequence[str], id_col: str, values: dict[str, np.ndarray],
                 rare: dict[str, int], cluster: bool):
        self.numeric, self.category, self.id_col = list(numeric), list(category), id_col
        self.values, self.rare = values, rare  # values by column; how frequent a value without a code is at most
        self.size = {c: len(values[c]) + (0 if c in self.numeric else KNOWN) for c in (*numeric, *category)}
        self.groups: list[list[str]] = []
        cells = MAX_JOINT + 1
        for c in sorted(self.size, key=self.size.get):
            if cells * self.size[c] > MAX_JOINT:
                self.groups.append([])
                cells = 1
            self.groups[-1].append(c)
            cells *= self.size[c]
        self.cells = [int(np.prod([self.size[c] for c in g])) for g in self.groups]
        own = [id_col, *(["cluster_id"] if cluster else []), *rare]
        kept = events.select(*own, *[F.col(c).cast("double").alias(f"_n_{c}") for c in numeric], *[F.col(c).alias(f"_c_{c}") for c in category])
        codes = [f"_g{i}" for i in range(len(self.groups))]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*own).schema), *(f"{g} int" for g in codes)])
        shared = ship_package(events.sparkSession).sparkContext.broadcast((values, self.groups, self.size, set(numeric)))
        self.table = cut_lineage(kept.mapInArrow(_coder(shared, len(own), codes), schema))

    @classmethod
    def of(cls, events: DataFrame, numeric: Sequence[str], category: Sequence[str], id_col: str, cluster: bool = False) -> Coded | None:
        """The coded events, or None where a number is null or not a number, or has more than `MAX_CODES` values."""
        numbers = [F.col(c).cast("double") for c in numeric]
        odd = [F.count_if(n.isNull() | F.isnan(n)).alias(f"odd_{c}") for n, c in zip(numbers, numeric)]
        found = events.agg(*odd, *[F.approx_count_distinct(c).alias(c) for c in (*numeric, *category)]).first()
        if any(found[f"odd_{c}"] or found[c] > MAX_CODES for c in numeric):
            return None
        values, rare = {}, {}
        few = [c for c in (*numeric, *category) if found[c] <= MAX_CODES // 2]
        sets = events.agg(*[F.collect_set(F.col(c).cast("double") if c in numeric else F.col(c)).alias(c) for c in few if found[c] <= 4096]).first()
        for c in (*numeric, *category):
            kind = np.float64 if c in numeric else object
            if c in sets:
                values[c] = np.array(sorted(set(sets[c])), kind)
                continue
            v = F.col(c).cast("double") if c in numeric else F.col(c)
            counts = events.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
            with free_shuffles(events.sparkSession):
                counts = counts.orderBy(F.desc("n"), "v").limit(MAX_CODES + 1).collect()
            if len(counts) > MAX_CODES:
                if c in numeric:
                    return None
                rare[c] = counts[-1].n
            values[c] = np.array(sorted({r.v for r in counts[:MAX_CODES]}), kind)
        return cls(events, numeric, category, id_col, values, rare, cluster)

    def marginal(self, joint: list[np.ndarray], column: str) -> np.ndarray:
        """Counts (cluster, code) of a column from those of the joint codes."""
        i = next(i for i, g in enumerate(self.groups) if column in g)
        shape = [self.size[c] for c in self.groups[i]]
        at = self.groups[i].index(column)
        return joint[i].reshape(-1, *shape).sum(axis=tuple(k + 1 for k in range(len(shape)) if k != at))

    def joined(self, tables: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Sums over the columns of each joint code of tables (cluster, code)."""
        out = []
        for g in self.groups:
            total = np.zeros((len(tables[g[0]]), 1))
            for c in g:
                total = (total[:, :, None] + tables[c][:, None, :]).reshape(len(total), -1)
            out.append(total)
        return out

    def gaps(self, rows: list) -> list[np.ndarray]:
        """Parts of the mixed distance to the medoids by joint code; texts without a code count as other values.

        For a category with a code of its own, the medoids' codes alone.
        """
        tables = {}
        for c in self.numeric:
            tables[c] = np.abs(self.values[c][None, :] - np.array([[float(r[c])] for r in rows]))
        for c in self.category:
            tables[c] = np.ones((len(rows), self.size[c]))
            for k, r in enumerate(rows):
                if r[c] is not None:
                    at = int(np.searchsorted(self.values[c], r[c])) if len(self.values[c]) else 0
                    if at < len(self.values[c]) and self.values[c][at] == r[c]:
                        tables[c][k, KNOWN + at] = 0.0
        return [t if len(g) > 1 or g[0] in self.numeric else np.where(t.min(axis=1) > 0, -1, t.argmin(axis=1)) for g, t in zip(self.groups, self.joined(tables))]

    def costs(self, joint: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Parts of the cost by joint code: with texts without a code different from all, as frequent as they can be, and met once."""
        tables, low, high = {}, {}, {}
        for c in self.numeric:
            n, v = self.marginal(joint, c), self.values[c]
            upto, s = np.cumsum(n, axis=1), np.cumsum(n * v, axis=1)
            tables[c] = v * upto - s + (s[:, -1:] - s) - v * (upto[:, -1:] - upto)
        for c in self.category:
            n = self.marginal(joint, c).astype(float)
            tables[c] = n.sum(axis=1, keepdims=True) - n
            tables[c][:, :KNOWN] += n[:, :KNOWN]
        for c, times in self.rare.items():
            low[c], high[c] = tables[c].copy(), tables[c].copy()
            low[c][:, RARE] = np.maximum(low[c][:, RARE] - times, 0)
            high[c][:, RARE] -= 1
        return self.joined(tables), self.joined(tables | low), self.joined(tables | high)

    def decoded(self, codes: list[int], rare: dict) -> dict:
        """Values by column of joint codes."""
        out = {}
        for g, code in zip(self.groups, codes, strict=True):
            for c in reversed(g):
                code, at = divmod(code, self.size[c])
                if c in self.numeric:
                    out[c] = self.values[c][at].item()
                else:
                    out[c] = None if at == NULL else rare[c] if at == RARE else self.values[c][at - KNOWN]
        return out


def _coder(shared, own: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, groups, size, numeric = shared.value
        sets = {c: pa.array(v, pa.float64() if c in numeric else pa.string()) for c, v in values.items()}
        for b in batches:
            codes = []
            for g in groups:
                joint = np.zeros(b.num_rows, np.int64)
                for c in g:
                    if c in numeric:
                        code = np.searchsorted(values[c], b.column(f"_n_{c}").to_numpy(zero_copy_only=False))
                    else:
                        text = b.column(f"_c_{c}").cast(pa.string())
                        code = pc.index_in(text, sets[c]).fill_null(RARE - KNOWN).to_numpy().astype(np.int64) + KNOWN
                        code[pc.is_null(text).to_numpy(zero_copy_only=False)] = NULL
                    joint = joint * size[c] + code
                codes.append(pa.array(joint, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:own], *codes], [*b.schema.names[:own], *names])

    return run


def _clusters(coded: Coded, medoids: list | None) -> tuple[list[Column], object]:
    """Columns that a pass reads, and a function of a batch to (cluster numbers, joint codes); without medoids the clusters are given."""
    codes = [F.col(f"_g{i}") for i in range(len(coded.groups))]
    if medoids is None:
        return [*codes, F.col("cluster_id")], None
    same = []  # a text without a code equals a medoid's
    for c in coded.rare:
        known = set(coded.values[c])
        same += [F.col(c) == F.lit(r[c]) for r in medoids if r[c] is not None and r[c] not in known]
    which = [k for c in coded.rare for known in [set(coded.values[c])] for k, r in enumerate(medoids) if r[c] is not None and r[c] not in known]
    return [*codes, *[F.coalesce(x, F.lit(False)).alias(f"_same{i}") for i, x in enumerate(same)]], (coded.gaps(medoids), which)


def _numbered(b: pa.RecordBatch, groups: int, model, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers of the clusters of a batch's rows, and their joint codes."""
    codes = [b.column(i).to_numpy() for i in range(groups)]
    if model is None:
        return np.searchsorted(ids, b.column("cluster_id").to_numpy()), codes
    gaps, which = model
    d = np.zeros((len(ids), b.num_rows))
    for table, code in zip(gaps, codes, strict=True):
        for k in range(len(ids)):
            d[k] += table[k][code] if table.ndim > 1 else code != table[k]
    for i, k in enumerate(which):
        d[k] -= b.column(f"_same{i}").to_numpy(zero_copy_only=False)
    return np.argmin(np.round(d, 9), axis=0), codes


def _parted(coded: Coded, medoids: list | None, ids: np.ndarray, model, more: Sequence[str], body, schema: str) -> DataFrame:
    """Rows of `body(batches of (rows, cluster numbers, joint codes))` over the coded events, with the columns `more` among the rows."""
    columns, nearest = _clusters(coded, medoids)
    shared = coded.table.sparkSession.sparkContext.broadcast((nearest, ids, model))
    groups = len(coded.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, ids, model = shared.value
        yield from body(((b, *_numbered(b, groups, nearest, ids)) for b in batches if b.num_rows), model)

    return coded.table.select(*columns, *more).mapInArrow(run, schema)


def _joint_counts(coded: Coded, medoids: list | None, ids: np.ndarray) -> list[np.ndarray]:
    """Events by (cluster, joint code)."""
    cells, k = coded.cells, len(ids)

    def body(parts, _) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(k * n, np.int64) for n in cells]
        held: list[list[np.ndarray]] = [[] for _ in cells]

        def add() -> None:
            for t, h in zip(total, held, strict=True):
                if h:
                    t += np.bincount(np.concatenate(h), minlength=len(t))
                    h.clear()

        rows = 0
        for _, own, codes in parts:
            for h, code, n in zip(held, codes, cells, strict=True):
                h.append(own * n + code)
            rows += len(own)
            if rows >= AT_ONCE:
                add()
                rows = 0
        add()
        for i, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at), pa.array(t[at])], ["g", "at", "n"])

    with free_shuffles(coded.table.sparkSession):
        found = _parted(coded, medoids, ids, None, (), body, "g int, at bigint, n bigint").groupBy("g", "at").agg(F.sum("n").alias("n")).toArrow()
    g, at, n = (found[c].to_numpy() for c in ("g", "at", "n"))
    out = []
    for i, c in enumerate(cells):
        t = np.zeros(k * c, np.int64)
        t[at[g == i]] = n[g == i]
        out.append(t.reshape(k, c))
    return out


def _rivals(coded: Coded, medoids: list | None, ids: np.ndarray, tables: tuple) -> DataFrame:
    """Rows that may have the least cost of their cluster: `(k, id, base, low, high, joint codes, texts without a code)`."""
    groups, own_columns = len(coded.groups), [coded.id_col, *coded.rare]
    names = ["k", *own_columns, "base", "low", "high", *(f"_g{i}" for i in range(groups))]

    def body(parts, tables) -> Iterator[pa.RecordBatch]:
        base, low, high = ([t.ravel() for t in x] for x in tables)
        cells = [t.shape[1] for t in tables[0]]
        least = np.full(len(tables[0][0]), np.inf)
        kept: list[pa.RecordBatch] = []

        def fits(k: np.ndarray, at_least: np.ndarray) -> np.ndarray:
            return at_least <= least[k] + 1e-5 + 1e-12 * np.abs(least[k])

        def pruned() -> list[pa.RecordBatch]:
            return [b.filter(pa.array(fits(b.column("k").to_numpy(), b.column("low").to_numpy()))) for b in kept]

        def summed(of: list[np.ndarray], at: list[np.ndarray]) -> np.ndarray:
            return sum(t[i] for t, i in zip(of, at, strict=True))

        for b, own, codes in parts:
            at = [own * n + code for n, code in zip(cells, codes, strict=True)]
            up = summed(high, at)
            np.minimum.at(least, own, up)
            lo = summed(low, at) if coded_rare else up
            some = np.flatnonzero(fits(own, lo))
            rows = b.take(pa.array(some))
            full = summed(base, [i[some] for i in at])
            kept.append(pa.RecordBatch.from_arrays([pa.array(own[some]), *(rows.column(c) for c in own_columns), pa.array(full), pa.array(lo[some]),
                                                    pa.array(up[some]), *(rows.column(f"_g{i}") for i in range(groups))], names))
            if sum(x.num_rows for x in kept) > MAX_RIVALS:
                kept = pruned()
                if sum(x.num_rows for x in kept) > MAX_RIVALS:
                    yield from kept
                    kept = []
        yield from pruned()

    coded_rare = bool(coded.rare)
    kinds = {f.name: f.dataType.simpleString() for f in coded.table.schema}
    schema = ", ".join(["k bigint", *(f"`{c}` {kinds[c]}" for c in own_columns), "base double, low double, high double",
                        *(f"_g{i} int" for i in range(groups))])
    return _parted(coded, medoids, ids, tables, own_columns, body, schema)


def _texts_met(coded: Coded, medoids: list | None, ids: np.ndarray, texts: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """Events by (cluster, text) of some texts of the columns with texts without a code."""
    k, columns = len(ids), list(coded.rare)

    def body(parts, texts) -> Iterator[pa.RecordBatch]:
        sets = {c: pa.array(t, pa.string()) for c, t in texts.items()}
        total = {c: np.zeros(k * len(t), np.int64) for c, t in texts.items()}
        for b, own, _ in parts:
            for c in columns:
                found = pc.index_in(b.column(c).cast(pa.string()), sets[c])
                rows = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
                np.add.at(total[c], own[rows] * len(sets[c]) + found.take(pa.array(rows)).to_numpy(), 1)
        for i, c in enumerate(columns):
            at = np.flatnonzero(total[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at), pa.array(total[c][at])], ["g", "at", "n"])

    with free_shuffles(coded.table.sparkSession):
        found = _parted(coded, medoids, ids, texts, columns, body, "g int, at bigint, n bigint").groupBy("g", "at").agg(F.sum("n").alias("n")).toArrow()
    g, at, n = (found[c].to_numpy() for c in ("g", "at", "n"))
    out = {}
    for i, c in enumerate(columns):
        out[c] = np.zeros(k * len(texts[c]), np.int64)
        out[c][at[g == i]] = n[g == i]
    return out


def _best_coded(coded: Coded, medoids: list | None, ids: np.ndarray, current: list, schema) -> DataFrame | None:
    """`medoid_step` of coded events as a local table; None where too many rows may be the best, or an id of the best repeats."""
    spark, id_col = coded.table.sparkSession, coded.id_col
    joint = _joint_counts(coded, medoids, ids)
    size = joint[0].sum(axis=1)
    rivals = _rivals(coded, medoids, ids, coded.costs(joint))
    if coded.rare:
        rivals = landed = cut_lineage(rivals)
        least = {r.k: r.high for r in rivals.groupBy("k").agg(F.min("high").alias("high")).collect()}
        keep = F.lit(False)
        for k, high in least.items():
            keep = keep | ((F.col("k") == k) & (F.col("low") <= high + 1e-5 + 1e-12 * abs(high)))
        rivals = rivals.filter(keep)
        rows = rivals.limit(MAX_RIVALS + 1).toArrow()
        discard(landed)
        if rows.num_rows > MAX_RIVALS:
            return None
        k, total = rows["k"].to_numpy(), rows["base"].to_numpy().copy()
        texts = _uncoded(coded, rows)
        met = _texts_met(coded, medoids, ids, texts)
        for c, t in texts.items():
            found = pc.index_in(rows[c].cast(pa.string()).combine_chunks(), pa.array(t, pa.string()))
            valid = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
            total[valid] -= met[c][k[valid] * len(t) + found.take(pa.array(valid)).to_numpy()]
        rivals = spark.createDataFrame(rows.set_column(rows.schema.get_field_index("base"), "base", pa.array(total)), rivals.schema)
    stay = F.lit(1)
    for c, i in current:
        stay = F.when((F.col("k") == int(np.searchsorted(ids, c))) & (F.col(id_col) == F.lit(i)), 0).otherwise(stay)
    codes = [f"_g{i}" for i in range(len(coded.groups))]
    order = F.struct(F.round("base", 6).alias("total"), stay.alias("stay"), F.col(id_col).alias("id"), *codes, *coded.rare)
    best = rivals.groupBy("k").agg(F.min(order).alias("m")).select("k", "m.*").collect()
    wanted = [r.id for r in best]
    if coded.table.filter(F.col(id_col).isin(wanted)).count() != len(set(wanted)):
        return None
    out = []
    for r in best:
        row = coded.decoded([r[c] for c in codes], {c: r[c] for c in coded.rare}) | {
            "cluster_id": int(ids[r.k]), id_col: r.id, "total": r.total, "size": int(size[r.k])}
        out.append(tuple(int(row[f.name]) if f.dataType.simpleString() in ("int", "bigint") and row[f.name] is not None else row[f.name] for f in schema))
    return spark.createDataFrame(out, schema)


def _uncoded(coded: Coded, rows: pa.Table) -> dict[str, list[str]]:
    """Texts without a code in some rows, by column."""
    return {c: [t for t in pc.unique(rows[c].cast(pa.string())).to_pylist() if t is not None and t not in known]
            for c in coded.rare for known in [set(coded.values[c])]}


def medoid_step(assigned: DataFrame, numeric: Sequence[str] = tuple(MINI_NUMERIC),
                category: Sequence[str] = tuple(MINI_CATEGORY), id_col: str = "event_id",
                medoids: DataFrame | None = None) -> DataFrame:
    """Best member per cluster `(cluster_id, columns..., total, size)`.

    The member with the smallest cost wins, ties by id. A current medoid that
    belongs to its cluster stays unless another member is strictly better.

    Costs are looked up by codes of the columns' values where the rows lie
    (`Coded`); only rows whose bounds allow them to be the best are compared
    exactly. Where that does not hold, the costs of all members are made.
    """
    current = [(r["cluster_id"], r[id_col]) for r in medoids.select("cluster_id", id_col).collect()] if medoids is not None else []
    coded = Coded.of(assigned, numeric, category, id_col, True) if assigned.schema[id_col].dataType.simpleString() in ("string", "int", "bigint") else None
    if coded is not None:
        found = None
        ids = np.array(sorted(r["cluster_id"] for r in coded.table.select("cluster_id").distinct().collect() if r["cluster_id"] is not None))
        if len(ids) and len(set(current)) == len(current) and sum(coded.cells) * len(ids) <= MAX_CELLS * 4:
            found = _best_coded(coded, None, ids, [c for c in current if c[0] in ids], _step_schema(assigned, numeric, category, id_col))
        discard(coded.table)
        if found is not None:
            return found
    return _step_by_costs(assigned, numeric, category, id_col, medoids)


def _step_schema(events: DataFrame, numeric: Sequence[str], category: Sequence[str], id_col: str) -> StructType:
    kinds = events.select(id_col, *numeric, *category).schema
    return StructType([StructField("cluster_id", IntegerType()), *kinds, StructField("total", DoubleType()), StructField("size", LongType())])


def _step_by_costs(assigned: DataFrame, numeric: Sequence[str], category: Sequence[str], id_col: str, medoids: DataFrame | None) -> DataFrame:
    """`medoid_step` from the costs of all members."""
    costed = medoid_costs(assigned, numeric, category, id_col).withColumn("total", F.round("cost", 6))
    stay = F.lit(1)
    if medoids is not None:
        current = medoids.select("cluster_id", id_col, F.lit(0).alias("_stay"))
        costed = costed.join(current, ["cluster_id", id_col], "left")
        stay = F.coalesce("_stay", F.lit(1))
    order = F.struct(F.col("total"), stay, F.col(id_col))
    best = costed.groupBy("cluster_id").agg(F.min(order).alias("m"), F.count("*").alias("size"))
    best = best.select("cluster_id", F.col("m").getField(id_col).alias(id_col), F.col("m.total").alias("total"), "size")
    best = freeze(best)  # one row per cluster, so the events are only filtered by it, not shuffled
    rows = assigned.select(id_col, *numeric, *category)
    return rows.join(best, id_col).select("cluster_id", id_col, *numeric, *category, "total", "size")


def seed_medoids(events: DataFrame, k: int, order: str, numeric: Sequence[str] = tuple(MINI_NUMERIC),
                 category: Sequence[str] = tuple(MINI_CATEGORY), id_col: str = "event_id") -> DataFrame:
    """Exactly k seeds, evenly spread over the key range."""
    seeds = uniform_keys(events, k, order, id_col, [*numeric, *category])
    return freeze(seeds.withColumnRenamed("i", "cluster_id"))


def kmedoids(events: DataFrame, k: int, order: str, max_iter: int | None = None, numeric: Sequence[str] = tuple(MINI_NUMERIC),
             category: Sequence[str] = tuple(MINI_CATEGORY), id_col: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Assign and update until no medoid changes: `(medoids, history)`.

    With `max_iter`, medoids that still change in that round are an error.
    The events and their codes are landed once. Only the K medoids pass from one round to the
    next, as a small local table, so no plan contains earlier rounds.
    """
    columns = [id_col, *numeric, *category]
    events = cut_lineage(events)
    medoids, history = seed_medoids(events, k, order, numeric, category, id_col), None
    coded = Coded.of(events, numeric, category, id_col) if events.schema[id_col].dataType.simpleString() in ("string", "int", "bigint") else None
    if coded is not None and sum(coded.cells) * k > MAX_CELLS * 4:
        discard(coded.table)
        coded = None
    for step in count():
        if step == max_iter:
            raise RuntimeError(f"medoids still change after {max_iter} rounds")
        found, rows = None, medoids.orderBy("cluster_id").collect()
        ids = np.array([r["cluster_id"] for r in rows])
        if coded is not None and len(set(ids)) == len(ids):
            found = _best_coded(coded, rows, ids, [(r["cluster_id"], r[id_col]) for r in rows], _step_schema(events, numeric, category, id_col))
        if found is None:
            assigned = cut_lineage(assign_mixed(events, medoids, numeric, category, id_col))  # read three times below
            found = freeze(_step_by_costs(assigned, numeric, category, id_col, medoids))
            discard(assigned)
        row = found.select(F.lit(step).alias("iteration"), "cluster_id", id_col, "total", "size")
        history = row if history is None else history.unionByName(row)
        before = {r["cluster_id"]: r[id_col] for r in medoids.select("cluster_id", id_col).collect()}
        after = {r["cluster_id"]: r[id_col] for r in found.select("cluster_id", id_col).collect()}
        # A cluster that lost all members keeps its medoid.
        lost = medoids.filter(~F.col("cluster_id").isin(list(after))) if len(after) < len(before) else None
        medoids = found.select("cluster_id", *columns)
        if lost is not None:
            medoids = freeze(medoids.unionByName(lost.select("cluster_id", *columns)))
        if all(before[c] == i for c, i in after.items()):
            break
    return medoids, history
