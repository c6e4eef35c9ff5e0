"""Token-id shards with a minimal perfect hash index from document keys to offsets.

Documents are sorted by id over range partitions; each task encodes its own and
writes the ids, two or four bytes each and nothing between them, to shard files.
Keys (id, copy) are dealt out by digest to index parts of some 65 536 keys. A
part holds a minimal perfect hash: level by level, keys that meet no other in a
bit array are placed, the others go on, and a key's number is the rank of its
bit. Under that number stand a fingerprint, shard, offset and length, so a look-up
costs the same whatever the number of keys. A key that was never stored is
refused but for one in 2^32.

Only what committed tasks report counts: files of lost or repeated attempts have
names of their own that no manifest holds. The driver sees one row per file.

Texts are cut into pieces where the vocabulary's own rules cut them, so the ids
are those of the whole text, and pieces met before need not be encoded again.

Defined results: null text is empty (one end id); special strings inside texts
are the library's special ids; documents without id come first; documents of
one id follow each other in the order of their texts as copies 0, 1, ...; other
columns are ignored; an empty table has no shards and no index; a very long
text is one record, read back in pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read, shared_uri, text_of
from newsquant.llm.token_counts import byte_letters
from newsquant.session import cut_lineage, ship_package

END_ID = 2
SHARD_BYTES = 1 << 28
PART_KEYS = 1 << 16
#: Bits of a level per key that is left.
ROOM = 2
#: Pieces a worker remembers before it starts afresh, and the longest of them.
REMEMBERED, LONGEST = 400_000, 32
#: Bytes of one read of payloads that lie near each other.
SPAN = 1 << 22

_WORDS = re.compile("[^ \t-\r]+").findall
_BEYOND = re.compile("[^\0-\xff]").search
#: The letter by which the vocabulary writes each byte.
_BYTES = dict(enumerate(byte_letters()))
#: The vocabulary's pattern for lowered text of Latin-1 (fixed values: its alternatives, letters, numbers and white space).
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"
_LATIN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+").findall


@dataclass
class Layout:
    """What a reader needs: shards in order (path, first id, ids, documents), index parts by number, bytes an id."""

    folder: str
    width: int
    shards: list[tuple[str, int, int, int]]
    parts: list[str]

    def save(self) -> str:
        fs, name = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/layout.json")
        with fs.open_output_stream(name) as out:
            out.write(json.dumps(asdict(self)).encode())
        return f"{self.folder}/layout.json"

    @staticmethod
    def load(uri: str) -> Layout:
        return Layout(**json.loads(_bytes(uri)))


def _bytes(uri: str) -> bytes:
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(name, compression=None) as f:
        return f.read()


class Encoder(dict):
    """Ids of pieces of text as bytes, by the tokenizers library; those met before are remembered."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.end = np.array([end_id], self.type).tobytes()

    def __missing__(self, piece: str) -> bytes:
        """Pieces of Latin-1 are what the vocabulary's splitting gives and go to its merges, whole words through the whole tokenizer."""
        if piece[-1] == " " or _BEYOND(piece):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            plain = piece.isascii() and piece.isprintable()
            ids = [t.id for t in self.merge(piece if plain else piece.encode().decode("latin-1").translate(_BYTES))]
        coded = struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = coded
        return coded

    def encode(self, text: str) -> bytes:
        """The ids of a whole text and the end id."""
        return b"".join(map(self.__getitem__, pieces(text))) + self.end


@lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker, kept from task to task."""
    return Encoder(path, end_id)


def pieces(text: str) -> list[str]:
    """Parts of a text that the vocabulary's rules encode alone as they do in place.

    Letters of Latin-1 are in normal form, so there its pattern can be applied
    to the lowered text directly. Words with other characters, or with what may
    be a special string, are left whole; a blank after one tells it from a piece.
    """
    if "<|" not in text and not _BEYOND(text):
        return _LATIN(text.lower())
    out = []
    for word in _WORDS(text):
        if "<|" in word or _BEYOND(word):
            out.append(word + " ")
        else:
            out += _LATIN(word.lower())
    return out


class _Shard:
    def __init__(self, folder: str):
        self.path = f"{folder}/shard-{uuid.uuid4().hex}.ids"
        fs, name = pyarrow.fs.FileSystem.from_uri(self.path)
        self.out, self.bytes, self.docs = fs.open_output_stream(name), 0, 0


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, seq = encoder(path, end_id), None, -1
        task = TaskContext.get().partitionId()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for ids in map(coder.encode, part.column(1).to_pylist()):
                    if shard is None or shard.bytes >= SHARD_BYTES:
                        if shard is not None:
                            shard.out.close()
                        shard, seq = _Shard(folder), seq + 1
                    rows.append((task, seq, shard.path, shard.docs, shard.bytes // coder.width, len(ids) // coder.width))
                    shard.out.write(ids)
                    shard.bytes += len(ids)
                    shard.docs += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLACE_TYPES, strict=True))], ["doc_id", *_PLACE])
        if shard is not None:
            shard.out.close()

    return write


_PLACE = ["task", "seq", "path", "row", "offset", "n_tokens"]
_PLACE_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards; returns the landed manifest (doc_id, task, seq, path, row, offset, n_tokens) of committed files."""
    ship_package(docs.sparkSession)
    fs, name = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    rows = docs.select("doc_id", text_of("text").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(
        _writer(folder, path, end_id), f"doc_id {kind}, task int, seq int, path string, row bigint, offset bigint, n_tokens bigint"))


def shard_list(manifest: DataFrame) -> list[tuple[str, int, int, int]]:
    """(path, ids before it, ids, documents) of the shards in order; one row per file reaches the driver."""
    files = manifest.groupBy("task", "seq", "path").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("docs")).collect()
    out, start = [], 0
    for f in sorted(files, key=lambda f: (f.task, f.seq)):
        out.append((f.path, start, f.ids, f.docs))
        start += f.ids
    return out


def numbered(manifest: DataFrame, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """Manifest rows with `shard`, its number, and `copy`, counted from 0 over the documents of one id."""
    spark, rows, before = manifest.sparkSession, [], 0
    for i, (path, _, _, docs) in enumerate(shards):
        rows.append((path, i, before))
        before += docs
    files = spark.createDataFrame(rows, "path string, shard int, before bigint")
    placed = manifest.join(files, "path").select("doc_id", "shard", "offset", "n_tokens", (F.col("before") + F.col("row")).alias("nth"))
    first = placed.groupBy(F.col("doc_id").alias("id")).agg(F.min("nth").alias("first"))
    both = placed.join(first, F.col("doc_id").eqNullSafe(F.col("id")))
    return both.select("doc_id", (F.col("nth") - F.col("first")).alias("copy"), "shard", "offset", "n_tokens")


def key_digest(doc_id: Column, copy: Column) -> Column:
    """16 bytes that stand for a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), F.lit("#"), copy.cast("string"))))


def digest_of(doc_id, copy: int = 0) -> bytes:
    return hashlib.md5(f"{'' if doc_id is None else f'={doc_id}'}#{copy}".encode()).digest()


def part_of(digest: Column, parts: int) -> Column:
    return (F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def _spot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in the bit array of one level."""
    x = low + np.uint64(level + 1) * (high | np.uint64(1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: the finalizer of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class HashIndex:
    """A minimal perfect hash over 16-byte digests, with a fingerprint and a value row under each number."""

    FIELDS = [("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")]

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, table: np.ndarray):
        self.sizes, self.words, self.ranks, self.table = sizes, words, ranks, table

    @classmethod
    def build(cls, digests: list[bytes], shard, offset, length) -> HashIndex:
        high, low = _halves(digests)
        left, sizes, arrays, spots = np.arange(len(high)), [], [], np.zeros(len(high), np.int64)
        start = 0
        while len(left):
            if len(sizes) == 256:
                raise ValueError("keys that are equal cannot be indexed")
            size = 64 * -(-ROOM * len(left) // 64)
            spot = _spot(high[left], low[left], len(sizes), size)
            alone = np.bincount(spot, minlength=size)[spot] == 1
            bits = np.zeros(size, np.uint8)
            bits[spot[alone]] = 1
            spots[left[alone]] = start + spot[alone]
            arrays.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
            sizes.append(size)
            start += size
        words = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype("<u4") if len(words) else np.zeros(0, "<u4")
        index = cls(sizes, words, ranks, np.zeros(len(high), cls.FIELDS))
        number = index._rank(spots)
        for field, values in zip(index.table.dtype.names, (high & np.uint64(0xFFFFFFFF), shard, offset, length), strict=True):
            index.table[field][number] = values
        return index

    def _rank(self, spot: np.ndarray) -> np.ndarray:
        word, bit = self.words[spot >> 6], (spot & 63).astype(np.uint64)
        return self.ranks[spot >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))

    def find(self, digests: list[bytes]) -> np.ndarray:
        """The number of each key, -1 for keys that are not stored."""
        high, low = _halves(digests)
        out, left, start = np.full(len(high), -1), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            spot = start + _spot(high[left], low[left], level, size)
            hit = (self.words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(spot[hit])
            left = left[~hit]
            start += size
            if not len(left):
                break
        wrong = out >= 0
        wrong[wrong] = self.table["fingerprint"][out[wrong]] != high[wrong] & np.uint64(0xFFFFFFFF)
        out[wrong] = -1
        return out

    def dump(self) -> bytes:
        head = json.dumps({"sizes": self.sizes, "keys": len(self.table)}).encode()
        return b"".join([len(head).to_bytes(8, "little"), head, self.words.tobytes(), self.ranks.tobytes(), self.table.tobytes()])

    @classmethod
    def parse(cls, data: bytes) -> HashIndex:
        at = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:at])
        n = sum(head["sizes"]) // 64
        words, ranks = np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)
        return cls(head["sizes"], words, ranks, np.frombuffer(data, cls.FIELDS, head["keys"], at + 12 * n))


def _part_writer(folder: str):
    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        index = HashIndex.build(rows["digest"].to_pylist(), *(rows[c].to_numpy() for c in ("shard", "offset", "n_tokens")))
        path = f"{folder}/index-{uuid.uuid4().hex}.mph"
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_output_stream(name) as out:
            out.write(index.dump())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "path": [path]})

    return write


def build(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> tuple[Layout, DataFrame]:
    """Shards and index of (doc_id, text) in a new folder; its layout, and every key (doc_id, copy) that it holds."""
    spark = ship_package(docs.sparkSession)
    folder = folder or f"{shared_uri(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, path, end_id)
    shards = shard_list(manifest)
    parts = max(1, -(-sum(s[3] for s in shards) // PART_KEYS))
    keys = cut_lineage(numbered(manifest, shards).withColumn("digest", key_digest(F.col("doc_id"), F.col("copy"))))
    files = keys.select(part_of(F.col("digest"), parts).alias("part"), "digest", "shard", "offset", "n_tokens").groupBy("part").applyInArrow(
        _part_writer(folder), "part int, path string").collect()
    paths = dict(map(tuple, files))
    layout = Layout(folder, encoder(path, end_id).width, shards, [paths.get(i, "") for i in range(parts)])
    layout.save()
    return layout, keys.select("doc_id", "copy")


class Reader:
    """Keyed access to one folder for a single process: one index part and one record are read per key."""

    def __init__(self, layout: Layout):
        self.layout, self.parts = layout, {}

    def ids(self, doc_id, copy: int = 0) -> np.ndarray | None:
        digest = digest_of(doc_id, copy)
        part = int.from_bytes(digest[:4], "big") % len(self.layout.parts)
        if not self.layout.parts[part]:
            return None
        if part not in self.parts:
            self.parts[part] = HashIndex.parse(_bytes(self.layout.parts[part]))
        number = int(self.parts[part].find([digest])[0])
        if number < 0:
            return None
        row, width = self.parts[part].table[number], self.layout.width
        fs, name = pyarrow.fs.FileSystem.from_uri(self.layout.shards[int(row["shard"])][0])
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.read_at(int(row["length"]) * width, int(row["offset"]) * width), f"<u{width}")


def _finder(parts: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, index = None, None
        for b in batches:
            part = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi or not parts[part[lo]]:
                    continue
                if loaded != part[lo]:
                    loaded, index = part[lo], HashIndex.parse(_bytes(parts[part[lo]]))
                rows = b.slice(lo, hi - lo)
                number = index.find(rows.column(1).to_pylist())
                found = number >= 0
                hits = index.table[number[found]]
                rows = rows.filter(pa.array(found))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(2), rows.column(3), pa.array(hits["shard"].astype(np.int32)),
                     pa.array(hits["offset"].astype(np.int64)), pa.array(hits["length"].astype(np.int64))],
                    ["doc_id", "copy", "shard", "offset", "n_tokens"])

    return find


def look_up(layout: Layout, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, offset, n_tokens) of the stored ones of the keys (doc_id, copy), by the hash index."""
    digest = keys.select(key_digest(F.col("doc_id"), F.col("copy")).alias("digest"), "doc_id", "copy")
    rows = digest.select(part_of(F.col("digest"), len(layout.parts)).alias("part"), "digest", "doc_id", "copy")
    kinds = [keys.schema[c].dataType.simpleString() for c in ("doc_id", "copy")]
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(
        _finder(layout.parts), f"doc_id {kinds[0]}, copy {kinds[1]}, shard int, offset bigint, n_tokens bigint")


def _spans(rows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of rows (shard, offset, length), sorted, that one read takes together."""
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[lo][0] or rows[i][1] + rows[i][2] - rows[lo][1] > SPAN // 4:
            yield lo, i
            lo = i


def _payloads(layout: Layout):
    """Sends (doc_id, copy, start, n_tokens, ids_crc32) of located records; ids are widened to four bytes for the checksum."""
    width, kind = layout.width, f"<u{layout.width}"

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True))
            sums = []
            for lo, hi in _spans(rows):
                if rows[lo][0] != shard:
                    if f is not None:
                        f.close()
                    shard = rows[lo][0]
                    fs, name = pyarrow.fs.FileSystem.from_uri(layout.shards[shard][0])
                    f = fs.open_input_file(name)
                at = rows[lo][1]
                if hi == lo + 1:
                    sums.append(_long_crc(f, at * width, rows[lo][2] * width, kind))
                    continue
                ids = np.frombuffer(f.read_at((rows[hi - 1][1] + rows[hi - 1][2] - at) * width, at * width), kind).astype("<u4")
                sums += [zlib.crc32(ids[o - at:o - at + n]) for _, o, n in rows[lo:hi]]
            start = [layout.shards[s][1] + o for s, o, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(start, pa.int64()), b.column(4), pa.array(sums, pa.int64())],
                ["doc_id", "copy", "start", "n_tokens", "ids_crc32"])
        if f is not None:
            f.close()

    return checks


def _long_crc(f, at: int, size: int, kind: str) -> int:
    out = 0
    for lo in range(0, size, SPAN):
        out = zlib.crc32(np.frombuffer(f.read_at(min(SPAN, size - lo), at + lo), kind).astype("<u4"), out)
    return out


def checksums(layout: Layout, located: DataFrame) -> DataFrame:
    """Reads the payloads of what `look_up` found, in the order they lie, and returns their digests."""
    kinds = [located.schema[c].dataType.simpleString() for c in ("doc_id", "copy")]
    rows = located.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return rows.select("doc_id", "copy", "shard", "offset", "n_tokens").mapInArrow(
        _payloads(layout), f"doc_id {kinds[0]}, copy {kinds[1]}, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_rows(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    layout, keys = build(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return checksums(layout, look_up(layout, keys)).select("doc_id", "start", "n_tokens", "ids_crc32")
