"""Product codes of vectors with integer codebooks, nearest entries found by equal-average search.

A vector's components become integers floor(1024 * x) and fall into four equal
consecutive parts. Each part position has a codebook of at most 256 entries,
started with the vectors of smallest id and moved four times to the floored
means of the parts that chose them.

Search: entries are sorted by the sum of their components. A part starts at the
entry whose sum is nearest to its own and looks outwards on both sides; by
Cauchy's inequality squared gap of sums / dimension never exceeds the squared
distance, so a side ends once that bound strictly exceeds the best distance
(equal ones are looked at, as ties go to the lower index). Parts of an Arrow
batch advance together; those that are done leave.

Spark scans the table once per round; tasks send sums and counts per entry,
which Spark adds up, so the driver sees the codebooks only. All arithmetic is
on 64-bit integers.

Defined results: vectors that are null or hold a null or non-finite component
are dropped, and so are those whose length differs from that of the kept vector
with the smallest id; a length that four does not divide is filled up with
zeros; components past `BOUND` (by which sums of squares stay exact) are held
there; null ids come last, equal ids are ordered by their vectors; rows that
repeat are coded each; fewer than 256 vectors give fewer entries; an empty table
gives no rows; a label error past the range of a long is null; other columns
than the label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read
from newsquant.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest size of an integer component: 64 squares of differences stay below 2^63.
BOUND = (1 << 27) - 1
#: Parts that advance together, so that their arrays stay in the cache.
TOGETHER = 2048


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the vectors that can be coded."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select("vec_id", "label", v.alias("v"))


def integers(v: pa.ListArray, length: int) -> np.ndarray:
    """Rows of integer components, filled up to four equal parts."""
    flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE).clip(-BOUND, BOUND).astype(np.int64)
    rows = flat.reshape(len(v), length)
    return np.pad(rows, ((0, 0), (0, -length % PARTS)))


class Codebook:
    """Entries of one part position, sorted by their sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.entries, self.sums, self.width = entries[self.order], sums[self.order], max(1, entries.shape[1])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one on ties) and the squared distance, for each row."""
        index, best = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        by_sum = np.argsort(rows.sum(axis=1), kind="stable")
        for lo in range(0, len(rows), TOGETHER):
            some = by_sum[lo:lo + TOGETHER]
            index[some], best[some] = self._outwards(rows[some])
        return index, best

    def _outwards(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, n = rows.sum(axis=1), len(self.sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        index, best = np.full(len(rows), len(self.order)), np.full(len(rows), np.iinfo(np.int64).max)
        for place, step in ((right, 1), (left, -1)):
            live = np.flatnonzero((place >= 0) & (place < n))
            self._look(rows, live, place, index, best)
            place += step
        for place, step in ((right, 1), (left, -1)):
            live = np.arange(len(rows))
            while True:
                live = live[(place[live] >= 0) & (place[live] < n)]
                gap = self.sums[place[live]] - sums[live]
                live = live[gap * gap <= best[live] * self.width]
                if not len(live):
                    break
                self._look(rows, live, place, index, best)
                place[live] += step
        return index, best

    def _look(self, rows, live, place, index, best) -> None:
        at = place[live]
        gap = rows[live] - self.entries[at]
        far = np.einsum("ij,ij->i", gap, gap)
        number = self.order[at]
        better = (far < best[live]) | ((far == best[live]) & (number < index[live]))
        won = live[better]
        best[won], index[won] = far[better], number[better]


def _searcher(books: np.ndarray, length: int):
    """A function that cuts a batch into parts and finds each part's entry: (rows, index by part, distance by part)."""
    sorted_books = [Codebook(b) for b in books]
    width = books.shape[2]

    def search(v: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        rows = integers(v, length)
        found = [b.nearest(rows[:, p * width:(p + 1) * width]) for p, b in enumerate(sorted_books)]
        return rows, [f[0] for f in found], [f[1] for f in found]

    return search


def _adder(books: np.ndarray, length: int):
    """Sends, once per task, count and component sums of the parts that chose each entry."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(books, length)
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            rows, index, _ = search(b.column(0))
            for p, i in enumerate(index):
                counts[p] += np.bincount(i, minlength=entries)
                np.add.at(sums[p], i, rows[:, p * width:(p + 1) * width])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return add


def first_books(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, position) from the vectors of smallest id, and the length of a vector."""
    order = [F.asc_nulls_last("vec_id"), "v"]
    head = vectors.orderBy(*order).select(F.size("v").alias("n")).head()
    length = 0 if head is None else head.n
    rows = vectors.filter(F.size("v") == length).orderBy(*order).limit(ENTRIES).select("v").toArrow()["v"].combine_chunks()
    whole = integers(rows, length)
    return whole.reshape(len(whole), PARTS, whole.shape[1] // PARTS).swapaxes(0, 1), length


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Codebooks after `rounds` of assigning all parts and moving the entries that were chosen."""
    ship_package(vectors.sparkSession)
    books, length = first_books(vectors)
    if not books.size:
        return books, length
    rows = vectors.filter(F.size("v") == length).select("v")
    for _ in range(rounds):
        sums = rows.mapInArrow(_adder(books, length), "part int, entry int, n bigint, sums array<bigint>")
        each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(books.shape[2])]
        moved = books.copy()
        for part, entry, n, *total in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            moved[part, entry] = [s // n for s in total]
        books = moved
    return books, length


def _coder(books: np.ndarray, length: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(books, length)
        for b in batches:
            _, index, far = search(b.column(2))
            codes = np.stack(index, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sum(far, axis=0, dtype=np.int64))],
                ["vec_id", "label", "code", "error"])

    return code


def encode(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code as one byte a part, error) of usable vectors of the right length."""
    ship_package(vectors.sparkSession)
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.filter(F.size("v") == length).mapInArrow(
        _coder(books, length), f"vec_id {kinds[0]}, label {kinds[1]}, code binary, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"))
    books, length = fit(vectors)
    coded = encode(vectors, books, length)
    per_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    both = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                       F.lit(books_digest(books)).alias("codebooks_sha256"))
