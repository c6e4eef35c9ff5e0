"""Near-duplicate groups by SimHash, compared bit-sliced.

Each text gets a 64-bit fingerprint: a bit is set if it is set in over half of
the hashes of its word shingles. Distinct fingerprints are compared inside
buckets that two fingerprints within the radius must share: of four 16-bit
blocks at most two can differ, so at least two are equal, one bucket table for
each choice of two blocks. A bucket is stored vertically, 64 fingerprints to a
word and one word per bit; a query runs down the bit planes, adds the
differences of 64 members at once in carry-save counters and abandons a word
as soon as all its members exceed the radius.

A bucket larger than `SPLIT` fingerprints is dealt out as pairs of blocks, so
no task holds more than two blocks of it. Distinct fingerprints within radius
two of one fingerprint number at most 2081, so links grow in proportion to
the fingerprints. Components are found by star contraction over links.

Defined results: null counts as empty; no words give fingerprint zero, linked
like any other; fewer words than a shingle hash as one sequence; repeated rows
share their component; a null id never names a component (a component of null
ids only is null).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import LOWER, read, text_of
from newsquant.session import cut_lineage, discard, ship_package

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints of one bucket that meet in one task at most (two blocks of half as many).
SPLIT = 8192
_CHUNK = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, print bigint")


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes, 64 x words: bit i of word w in plane b is bit b of fingerprint 64 w + i."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(sliced: np.ndarray, valid: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, word) the mask of the word's members within the radius.

    `counter` is a carry-save counter of log2 planes; once it passes the
    radius a member is out for good. Every eight planes, the words without
    any member left are dropped.
    """
    out = np.zeros(len(queries), np.uint64)
    limit = radius + 1
    width = limit.bit_length()
    at, q, w = np.arange(len(queries)), queries, words
    gone = ~valid[w]
    counter = np.zeros((width, len(q)), np.uint64)
    for b in range(64):
        carry = sliced[b][w] ^ (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        reached = reduce(np.bitwise_and, [counter[k] for k in range(width) if limit >> k & 1])
        gone |= reached
        if b % 8 == 7:
            live = gone != _ALL
            if not live.all():
                at, q, w, gone, counter = at[live], q[live], w[live], gone[live], counter[:, live]
                if not len(at):
                    break
    out[at] = ~gone
    return out


def _links(keys: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside runs of equal keys, rows sorted by key. side: 0 compares with all rows, 1 and 2 only with each other."""
    starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    sizes = np.diff(np.r_[starts, len(keys)])
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    if not len(starts):
        return
    spans = -(-sizes // 64)
    first = np.r_[0, np.cumsum(spans)[:-1]]
    run = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = starts[run] + inside
    slot = first[run] * 64 + inside
    total = int(spans.sum())
    member = np.zeros(total * 64, np.uint64)
    member[slot] = prints[row]
    sliced = planes(member)
    of_slot = np.full(total * 64, -1)
    of_slot[slot] = row
    used = np.packbits((of_slot >= 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    # every member asks the words of its run up to its own
    reach = inside // 64 + 1
    bounds = np.r_[0, np.cumsum(reach)]
    begin = 0
    while begin < len(run):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + _CHUNK, "right")) - 1)
        who = np.repeat(np.arange(begin, end), reach[begin:end])
        word = first[run[who]] + np.arange(len(who)) - np.repeat(bounds[begin:end] - bounds[begin], reach[begin:end])
        masks = near(sliced, used, prints[row[who]], word, radius)
        hit = np.flatnonzero(masks)
        bits = np.unpackbits(masks[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        u, v = row[who[hit[i]]], of_slot[word[hit[i]] * 64 + j]
        ok = (v < u) & ((side[u] == 0) | (side[u] != side[v]))
        yield prints[u[ok]], prints[v[ok]]
        begin = end


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, pair); a run is held until its last row has come."""
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            keys = np.r_[0, np.cumsum(change)]
            for a, b in _links(keys, rows[2], rows[3].view(np.uint64), radius):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from flush(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from flush(np.concatenate(held, axis=1))

    return run


def _keys(prints: Column) -> Column:
    """Bucket keys: the choice of two blocks and their bits."""
    choices = list(combinations(range(BLOCKS), 2))
    block = [F.shiftrightunsigned(prints, i * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]
    return F.array(*[
        F.lit(n << (2 * BLOCK_BITS)).bitwiseOR(F.shiftleft(block[i], BLOCK_BITS)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(choices)])


def links(prints: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """(u, v), u > v: links among distinct fingerprints `print`; a link found in several tables appears once."""
    rows = prints.select(F.explode(_keys(F.col("print"))).alias("key"), "print")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split)
    half = max(1, split // 2)
    parts = F.ceil(F.col("n") / half)
    own = F.pmod(F.xxhash64("print"), parts)
    shared = (
        rows.join(large, "key", "left")
        .withColumn("own", F.when(F.col("n").isNotNull(), own))
        .withColumn("other", F.explode_outer(F.when(F.col("n").isNotNull(), F.sequence(F.lit(0).cast("bigint"), parts - 1))))
        .select(
            "key",
            F.coalesce(F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other"), F.lit(-1).cast("bigint")).alias("pair"),
            F.when(F.col("n").isNull() | (F.col("own") == F.col("other")), 0)
            .when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint").alias("side"),
            "print"))
    met = shared.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return met.mapInArrow(_compare(radius), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, and that smallest node.

    Rounds of large-star and small-star; each round's edges are written to the
    shared folder, the driver keeps two numbers per round.
    """
    seen = None
    before: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        discard(large, *before)
        if now == seen:
            return edges
        seen, before = now, [edges]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, print, component): one row per document; component is the smallest id reachable over links."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    firsts = cut_lineage(prints.groupBy("print").agg(F.min("id").alias("first")))
    stars = components(cut_lineage(links(firsts.select("print"), radius)))
    rooted = firsts.join(stars.withColumnRenamed("u", "print"), "print", "left").select(
        "print", "first", F.coalesce("v", "print").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("print", "component")
    return prints.join(named, "print").select("id", "print", "component")


def simhash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group (id, component) stays, the one with the smallest id; columns as they came.

    Documents without id cannot be named as copies and stay. Of rows that
    repeat the smallest id, one of each text stays.
    """
    chosen = groups.filter(F.col("id") == F.col("component")).select(F.col("id").alias("__id")).distinct()
    first = docs.join(chosen, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.filter("doc_id is null"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays."""
    return first_of_groups(docs, near_groups(docs))
