"""Removal of passages that an earlier document has, by longest-previous-factor arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a
document with a smaller id; matches never cross documents and are judged on
the input. All texts together are too long for one suffix array, so suffixes
are dealt out such that equal strings meet:

1. Each window of LENGTH bytes has an anchor, its least-hashed 16 bytes, so
   equal windows have equal anchors. Windows in a row with one anchor form a
   stretch. Tasks drop stretches they already saw in an earlier document and
   pass on (anchor hash, stretch hash, id, place), bit-packed and compressed.
2. Where anchors meet, a whole stretch equal to one of an earlier document is
   removed as it is. What is left are stretches that share their anchor with
   an earlier document but differ: the borders of repeated passages.
3. Only for those the bytes are fetched, and the suffixes at their windows are
   sorted. In suffix order, the previous and the next suffix of a smaller id
   give the longest earlier match; from LENGTH on, the window is covered.
4. Covered windows are joined to the texts and cut out.

Anchors with more than `SPLIT` differing stretches are dealt out window by
window, so no task has to hold them together.

Defined results: null and empty texts have zero bytes and the digest of
nothing; texts under LENGTH bytes keep all; documents without id neither lose
bytes nor make others lose them; rows that share an id are not earlier than
each other, each is judged by its own text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsquant.llm.common import read, text_of
from newsquant.session import cut_lineage, ship_package

LENGTH, GRAM = 50, 16
#: Bytes per numpy pass, stretches a task holds before it passes them on, stretches of one anchor that may meet in one task.
PASS_BYTES, HELD, SPLIT = 1 << 20, 600_000, 20_000
_U = np.uint64
_MIX, _MIX2, _BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0x2545F4914F6CDD1D)
#: Undoes a factor of _BASE, so that a hash does not depend on where in the pass its bytes lie.
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_WIDTH = {"anchor": 4, "stretch": 6, "doc": 8, "copy": 4, "at": 4, "n": 1}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX2
    x = (x ^ (x >> _U(29))) * _MIX
    return x ^ (x >> _U(32))


def stretches(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash, stretch hash) of texts laid end to end; bounds: where each begins, and the end."""
    none = np.zeros(0, np.int64)
    windows = len(text) - LENGTH + 1
    if windows < 1:
        return none, none, none, none.view(_U), none.view(_U)
    gram = (text.astype(_U) + _U(1)) * _MIX
    size = 1
    while size < GRAM:
        gram = (gram[:-size] ^ (gram[:-size] >> _U(31))) * _MIX2 + gram[size:]
        size *= 2
    gram = _mix(gram)
    # the place in the low bits makes the leftmost of equal hashes the least
    least = (gram & ~_U(0xFFFFFF)) | np.arange(len(gram), dtype=_U)
    reach, span = 1, LENGTH - GRAM + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:reach - span], least[span - reach:])
    anchor = (least & _U(0xFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:windows]
    inside = np.arange(windows) + LENGTH <= bounds[1:][doc]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none.view(_U), none.view(_U)
    ends = np.flatnonzero(np.r_[new, True] | np.r_[~inside, True])
    n = ends[np.searchsorted(ends, first, "right")] - first
    power = np.multiply.accumulate(np.r_[_U(1), np.full(len(text) - 1, _BASE)])
    back = np.multiply.accumulate(np.r_[_U(1), np.full(len(text) - 1, _INVERSE)])
    value = _mix((text.astype(_U) + _U(17)) * _MIX) * power
    total = np.r_[_U(0), np.cumsum(value, dtype=_U)]
    last = first + n - 1 + LENGTH
    stretch = _mix((total[last] - total[first]) * back[first] + n.astype(_U))
    return doc[first], first - bounds[:-1][doc[first]], n, gram[anchor[first]], stretch


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns as byte planes, compressed; ids as differences from the least."""
    count = len(columns["doc"])
    low = int(columns["doc"].min()) if count else 0
    raw = [struct.pack("<qq", count, low)]
    for name, width in _WIDTH.items():
        if name in columns:
            values = columns[name].astype(np.int64) - low if name == "doc" else columns[name]
            raw.append(np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(blob: bytes, names: list[str]) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, low = struct.unpack_from("<qq", raw)
    at, out = 16, {}
    for name in names:
        planes = np.zeros((count, 8), np.uint8)
        planes[:, :_WIDTH[name]] = np.frombuffer(raw, np.uint8, count * _WIDTH[name], at).reshape(_WIDTH[name], count).T
        at += count * _WIDTH[name]
        out[name] = planes.view(np.int64).ravel()
    out["doc"] = out["doc"] + low
    return out


_MET = ["anchor", "stretch", "doc", "copy", "at", "n"]
_DONE = ["doc", "copy", "at", "n"]


def _runs(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _find(bits: int):
    """Texts to packed stretches by bucket: the top `bits` bits of the anchor hash. bucket, met (packed), done (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = sent = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal sent
            doc, copy, at, n, anchor, stretch = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, stretch, anchor))
            doc, copy, at, n, anchor, stretch = (x[order] for x in (doc, copy, at, n, anchor, stretch))
            starts = _runs(anchor, stretch)
            later = doc > np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
            done = _pack({"doc": doc[later], "copy": copy[later], "at": at[later], "n": n[later]})
            keep = ~later
            doc, copy, at, n, anchor, stretch = (x[keep] for x in (doc, copy, at, n, anchor, stretch))
            bucket = (anchor >> _U(64 - bits)).astype(np.int64)
            short = (anchor >> _U(32 - bits)) & _U(0xFFFFFFFF)
            cuts = np.r_[_runs(bucket), len(bucket)]
            names, blobs = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                names.append(int(bucket[lo]))
                blobs.append(_pack({"anchor": short[lo:hi], "stretch": stretch[lo:hi], "doc": doc[lo:hi], "copy": copy[lo:hi],
                                    "at": at[lo:hi], "n": n[lo:hi]}))
            names.append((sent * 7919 + len(doc)) % (1 << bits))
            sent += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([None] * len(blobs) + [done], pa.binary())],
                ["bucket", "met", "done"])

        for b in batches:
            ids, copies = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).cast(pa.binary()).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PASS_BYTES):
                    size += len(texts[hi])
                    hi += 1
                bounds = np.r_[0, np.cumsum([len(t) for t in texts[lo:hi]])]
                for at, doc, first, n, anchor, stretch in _pieces(texts[lo:hi], bounds):
                    doc = doc + lo
                    held.append((ids[doc], copies[doc].astype(np.int64), first + at, n, anchor, stretch))
                    waiting += len(doc)
                lo = hi
                if waiting > HELD:
                    yield from out()
                    waiting = 0
        if waiting:
            yield from out()

    return run


def _pieces(texts: list[bytes], bounds: np.ndarray) -> Iterator[tuple]:
    """Stretches of some texts; a very long text is done in overlapping parts, each window in one of them."""
    part = 8 * PASS_BYTES
    if bounds[-1] <= part:
        yield 0, *stretches(np.frombuffer(b"".join(texts), np.uint8), bounds)
        return
    text = np.frombuffer(texts[0], np.uint8)
    for at in range(0, len(text), part):
        some = text[at:at + part + LENGTH - 1]
        yield at, *stretches(some, np.array([0, len(some)]))


def _flow(batches: Iterator[pa.RecordBatch], key: int, least: int = 1) -> Iterator[list[pa.RecordBatch]]:
    """Batches cut and gathered so that equal keys stay together, in chunks of at least `least` rows; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        if rows >= least:
            last = held[-1].column(key)[-1].as_py()
            cut = int(np.searchsorted(keys != last, True)) if keys[-1] != last else b.num_rows
            if cut < b.num_rows:
                yield [*held, b.slice(0, cut)]
                held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows += b.num_rows
    if held:
        yield held


def _meet(bits: int, split: int):
    """Per bucket: stretches of later documents (key null) and stretches to compare by bytes (key, -1: window by window)."""

    def bucket(met: list[bytes]) -> tuple[np.ndarray, ...]:
        parts = [_unpack(m, _MET) for m in met]
        anchor, stretch, doc, copy, at, n = (np.concatenate([p[k] for p in parts]) for k in _MET)
        order = np.lexsort((doc, stretch, anchor))
        anchor, stretch, doc, copy, at, n = (x[order] for x in (anchor, stretch, doc, copy, at, n))
        starts = _runs(anchor, stretch)
        later = doc > np.repeat(doc[starts], np.diff(np.r_[starts, len(doc)]))
        first = ~later
        groups = _runs(anchor[first])
        sizes = np.diff(np.r_[groups, first.sum()])
        differ = np.zeros(0, bool)
        if len(groups):
            f = doc[first]
            differ = np.repeat(np.minimum.reduceat(f, groups) < np.maximum.reduceat(f, groups), sizes)
        wide = np.repeat(sizes > split, sizes)
        fetch = np.flatnonzero(first)[differ]
        return (doc[later], copy[later], at[later], n[later]), (doc[fetch], copy[fetch], at[fetch], n[fetch]), anchor[fetch], wide[differ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc, copy, at, n, key=None) -> pa.RecordBatch:
            keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(copy.astype(np.int32)), keys, pa.array((at << 8) | n)], ["doc", "copy", "key", "place"])

        for group in _flow(batches, 0):
            table = pa.Table.from_batches(group)
            for blob in table.column("done").drop_null().to_pylist():
                d = _unpack(blob, _DONE)
                yield rows(*(d[k] for k in _DONE))
            buckets = table.column("bucket").to_numpy()
            blobs = table.column("met").to_pylist()
            for b in np.unique(buckets):
                met = [blobs[i] for i in np.flatnonzero(buckets == b) if blobs[i] is not None]
                if met:
                    later, fetch, anchor, wide = bucket(met)
                    yield rows(*later)
                    if len(fetch[0]):
                        yield rows(*fetch, np.where(wide, -1, (int(b) << 32) | anchor))

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, copy, packed, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = unpack.decompress(packed)
            for w in wanted:
                key, at, n = w["key"], w["place"] >> 8, w["place"] & 255
                if key >= 0:
                    found = [(key, at, text[at:at + n - 1 + LENGTH])]
                else:
                    found = [(xxhash.xxh64_intdigest(x) >> 1, i, x) for i in range(at, at + n) for x in [text[i:i + LENGTH]]]
                for k, i, x in found:
                    for column, value in zip(out, (k, doc, copy, i, x), strict=True):
                        column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "doc", "copy", "at", "bytes"])


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value on the left, -1 for none."""
    found = np.arange(len(values)) - 1
    open_ = np.flatnonzero((found >= 0) & (values[np.maximum(found, 0)] >= values))
    while len(open_):
        # a rejected neighbour's own answer is the next candidate
        found[open_] = found[found[open_]]
        open_ = open_[(found[open_] >= 0) & (values[np.maximum(found[open_], 0)] >= values[open_])]
    return found


def longest_previous(suffixes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """LPF per suffix (rows of LENGTH bytes): the longest start it shares with a suffix of a smaller id."""
    count = len(suffixes)
    padded = np.zeros((count, -(-suffixes.shape[1] // 8) * 8), np.uint8)
    padded[:, :suffixes.shape[1]] = suffixes
    words = padded.view(">u8")
    order = np.lexsort(words.T[::-1])
    ranked, ids = suffixes[order], doc[order]
    left = previous_smaller(ids)
    right = count - 1 - previous_smaller(ids[::-1])[::-1]
    best = np.zeros(count, np.int64)
    for other in (left, right):
        has = np.flatnonzero((other >= 0) & (other < count))
        differ = ranked[has] != ranked[other[has]]
        best[has] = np.maximum(best[has], np.where(differ.any(1), differ.argmax(1), suffixes.shape[1]))
    out = np.empty(count, np.int64)
    out[order] = best
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows of the fetched stretches, rows sorted by key."""
    for group in _flow(batches, 0, 5000):
        table = pa.Table.from_batches(group).combine_chunks()
        doc, copy, at = (table.column(k).to_numpy() for k in ("doc", "copy", "at"))
        pieces = table.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = sizes - LENGTH + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(sizes) - sizes, n) + inner
        row = np.repeat(np.arange(len(n)), n)
        suffixes = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[start]
        hit = longest_previous(suffixes, doc[row]) >= LENGTH
        row, place = row[hit], at[row[hit]] + inner[hit]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(copy[row].astype(np.int32)), pa.array((place << 8) | 1)], ["doc", "copy", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed, places) to counts, digest and kept text."""
    unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for packed, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unpack.decompress(packed)
            spans, kept = 0, text
            if places:
                p = np.array(places, np.int64)
                lo = p >> 8
                hi = lo + (p & 255) - 1 + LENGTH
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), press.compress(kept)), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                                         ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [press.compress(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["id", "copy", "packed"])


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, text): copy tells different texts of one id apart, 0 where ids are unique."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    twice = rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if twice.isEmpty():
        return rows.select("id", F.lit(0).alias("copy"), "text")
    twice = cut_lineage(twice)
    hashed = rows.withColumn("h", F.xxhash64("text"))
    texts = hashed.join(twice, "id", "left_semi").select("id", "h").distinct()
    order = texts.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("h")))
    return hashed.join(order, ["id", "h"], "left").select("id", F.coalesce("copy", F.lit(0)).cast("int").alias("copy"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per document; kept is the remaining text, Zstandard-compressed."""
    spark = ship_package(docs.sparkSession)
    rows = numbered(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    bits = max(6, min(20, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    found = rows.filter("id is not null").select(F.col("id").cast("bigint").alias("doc"), "copy", "text")
    blobs = found.mapInArrow(_find(bits), "bucket bigint, met binary, done binary")
    met = blobs.repartition("bucket").sortWithinPartitions("bucket")
    places = cut_lineage(met.mapInArrow(_meet(bits, split), "doc bigint, copy int, key bigint, place bigint"))
    packed = rows.mapInArrow(_press, f"id {kind}, copy int, packed binary")
    wanted = places.filter("key is not null").groupBy("doc", "copy").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    some = packed.select(F.col("id").cast("bigint").alias("doc"), "copy", "packed").join(wanted, ["doc", "copy"]).dropDuplicates(["doc", "copy"])
    fetched = some.mapInArrow(_fetch, "key bigint, doc bigint, copy int, at bigint, bytes binary")
    borders = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "doc bigint, copy int, place bigint")
    covered = places.filter("key is null").select("doc", "copy", "place").unionByName(borders)
    cuts = covered.groupBy("doc", "copy").agg(F.collect_list("place").alias("places"))
    keys = [packed["id"].cast("bigint") == cuts["doc"], packed["copy"] == cuts["copy"]]
    joined = packed.join(cuts, keys, "left").select(packed["id"], "packed", "places")
    return joined.mapInArrow(_cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")
