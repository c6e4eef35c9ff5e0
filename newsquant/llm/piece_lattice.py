"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units that no piece crosses: blanks followed by a word, and
line ends. For each unit all substrings up to the longest piece are joined to
the piece table; the matches are the edges of the unit's lattice, which is
folded to a path.

* Unigram models: substrings are rows, edges are grouped by unit and folded
  with a higher-order aggregate. Viterbi, the path of the best score sum.
* BPE models define their result by merge order, and the best path is another
  one. So their fold keeps the present pieces and takes in every round the
  edge that joins two of them with the best score, leftmost on ties. A single
  character without piece is an edge to its byte pieces. Here the substrings
  are joined to the piece table inside the row, for a batch of units at once
  and with every match compared by its characters: as rows of their own the
  some fifty substrings of a unit cost several times as much.

Units beyond `LONG` characters are merged with a heap in Python, with the same
result.

Applying the encodings moves no text. Units of the highest counts, at most
`HOT`, are one file of bounded size that every worker reads from the shared
folder. What a scan task meets beyond them is dealt by unit, encoded once per
batch and written back under the task's number, so that the same task of the next
scan finds it. Should a task find other rows than before (an input that is no
stored table), what is missing is merged in place, with the same result.

Defined results: null and empty texts have no pieces and decode to the empty
text; the sign for blanks (U+2581) in a text is a blank and decodes to one;
rows that repeat are encoded each.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read, text_of
from newsquant.session import cut_lineage, discard, shared_folder, ship_package

BLANK_SIGN = "▁"
#: A line end, blanks with a word, or blanks alone.
UNIT = re.compile("\n| *[^ \n]+| +")
#: A rare character, to cut texts without runs of blanks by.
MARK = "\x1f"
#: Longest unit for the mask fold, units in the shared file, units a counting task holds before it hands them on.
LONG, HOT, HELD = 60, 1 << 19, 300_000
#: Factor of the substring keys, units whose lattices are in memory at once, the rank of no edge.
_STEP, _AT_ONCE, _NONE = np.uint64(0x9E3779B97F4A7C15), 2048, np.iinfo(np.int32).max
#: Piece types of the model format (fixed values).
NORMAL, BYTE = 1, 6


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, with a leading blank, are supported")
        self.bpe = model.trainer_spec.model_type == 2
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.rows = [(p.piece.replace(BLANK_SIGN, " "), i, float(p.score)) for i, p in normal]
        self.first_byte = next(i for i, p in enumerate(model.pieces) if p.type == BYTE)
        self.longest = max(len(p) for p, _, _ in self.rows)
        if any(len(p) > 1 and (" " in p.lstrip(" ") or "\n" in p) for p, _, _ in self.rows):
            raise ValueError("a piece crosses units")
        self.as_bytes = [b""] * len(model.pieces)
        for piece, i, _ in self.rows:
            self.as_bytes[i] = piece.encode()
        for b in range(256):
            self.as_bytes[self.first_byte + b] = bytes([b])

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table as a stored one: its rows stay out of the plans."""
        return cut_lineage(spark.createDataFrame(self.rows, "piece string, id int, score double").coalesce(1))


def partitions(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def units(text: str) -> list[str]:
    """The units of a text and of the blank the model puts before it."""
    if not text:
        return []
    marked = " " + text.replace(BLANK_SIGN, " ")
    if "  " in marked or MARK in marked:
        return UNIT.findall(marked)
    return list(filter(None, marked.replace(" ", f"{MARK} ").replace("\n", f"{MARK}\n{MARK}").split(MARK)))


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, a, c, score, ids): the lattice of each unit, from position a to c.

    The piece table is broadcast: it belongs to the model, some 30,000 short strings.
    """
    spark = words.sparkSession
    size = F.length("unit")
    starts = words.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("a"))
    spans = starts.select("unit", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("a")))).alias("n"))
    parts = spans.select("unit", "a", "n", F.substring("unit", F.col("a") + 1, F.col("n")).alias("piece"))
    if len(pieces.rows) > 1 << 20:
        raise ValueError("piece table too large to broadcast")
    found = parts.join(F.broadcast(pieces.frame(spark)), "piece", "left").filter("id is not null or n = 1")
    code = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)),
                           lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + pieces.first_byte)
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes)
    return found.select("unit", "a", (F.col("a") + F.col("n")).alias("c"), F.coalesce("score", F.lit(-1e12)).alias("score"), ids.alias("ids"))


class Lattice:
    """The piece table as sorted arrays by length, for the lattices of many units at once."""

    def __init__(self, rows: list[tuple[str, int, float]], first_byte: int):
        self.first_byte = first_byte
        rank = np.unique([-s for _, _, s in rows], return_inverse=True)[1].reshape(-1)
        by_length: dict[int, list[int]] = {}
        for i, (piece, _, _) in enumerate(rows):
            by_length.setdefault(len(piece), []).append(i)
        self.by_length = []
        for n, of in sorted(by_length.items()):
            codes = np.array([[ord(c) for c in rows[i][0]] for i in of], np.uint32)
            key = np.zeros(len(of), np.uint64)
            for j in range(n):
                key = key * _STEP + codes[:, j]
            order = np.argsort(key, kind="stable")
            self.by_length.append((n, key[order], codes[order], np.array([rows[i][1] for i in of], np.int32)[order],
                                   rank[of].astype(np.int32)[order]))
        self.longest = max(by_length)

    def edges(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece id and merge rank by unit, first position and length: all substrings joined to the table."""
        m, width = codes.shape
        most = min(self.longest, width)
        ids = np.full((m, width, most + 1), -1, np.int32)
        ranks = np.full((m, width, most + 1), _NONE, np.int32)
        key, n = np.zeros((m, width), np.uint64), 0
        for length, keys, spelled, piece, rank in self.by_length:
            if length > most:
                break
            while n < length:
                key = key[:, :width - n] * _STEP + codes[:, n:]
                n += 1
            near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            row, a = np.nonzero((keys[near] == key) & (np.arange(width - n + 1) <= size[:, None] - n))
            # equal keys name a run of pieces, compared by their characters
            at, open_ = near[row, a], np.ones(len(row), bool)
            while open_.any():
                r, f, t = row[open_], a[open_], at[open_]
                same = (codes[r[:, None], f[:, None] + np.arange(n)] == spelled[t]).all(1)
                ids[r[same], f[same], n], ranks[r[same], f[same], n] = piece[t[same]], rank[t[same]]
                left = np.flatnonzero(open_)[~same]
                at[left] += 1
                open_[:] = False
                left = left[at[left] < len(keys)]
                open_[left] = keys[at[left]] == key[row[left], a[left]]
        return ids, ranks

    def fold(self, ranks: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length of the piece that starts at each position, 0 for none, when no edge joins two pieces any more."""
        m, width, most = ranks.shape
        place = np.arange(width)
        length = (place < size[:, None]).astype(np.int64)
        rows = np.flatnonzero(size > 1)
        while len(rows):
            own = length[rows]
            after = place + own
            joined = own + np.take_along_axis(np.pad(own, ((0, 0), (0, 1))), after, 1)
            can = (own > 0) & (joined > own) & (joined < most)
            rank = np.where(can, ranks[rows[:, None], place, np.where(can, joined, 0)], _NONE)
            best = rank.argmin(1)  # the leftmost of equal ones
            line = np.arange(len(rows))
            met = rank[line, best] != _NONE
            rows, best, line = rows[met], best[met], line[met]
            length[rows, after[line, best]] = 0
            length[rows, best] = joined[line, best]
        return length

    def encode(self, some: list[str]) -> list[list[int]]:
        """Ids of units of at most `LONG` characters."""
        out: list[list[int]] = [[]] * len(some)
        order = sorted(range(len(some)), key=lambda i: len(some[i]))
        for lo in range(0, len(order), _AT_ONCE):
            of = order[lo:lo + _AT_ONCE]
            size = np.array([len(some[i]) for i in of])
            width = max(int(size[-1]), 1)
            codes = np.frombuffer("".join(some[i].ljust(width, "\0") for i in of).encode("utf-32-le"), np.uint32).reshape(-1, width)
            ids, ranks = self.edges(codes, size)
            length = self.fold(ranks, size)
            row, a = np.nonzero(length)
            found = ids[row, a, length[row, a]].tolist()
            ends = np.cumsum(np.bincount(row, minlength=len(of))).tolist()
            for k, i in enumerate(of):
                got = found[ends[k - 1] if k else 0:ends[k]]
                if -1 in got:  # characters without piece, one position each
                    starts = a[ends[k - 1] if k else 0:ends[k]].tolist()
                    got = [x for g, at in zip(got, starts, strict=True)
                           for x in ([g] if g >= 0 else [self.first_byte + b for b in some[i][at].encode()])]
                out[i] = got
        return out


@lru_cache(maxsize=1)
def _lattice_of(shared: _Rules) -> Lattice:
    """Built once per worker."""
    return Lattice(shared.broadcast.value, shared.first_byte)


class _Rules:
    """A broadcast piece table with a name, so that a worker builds its lattice table once."""

    def __init__(self, spark: SparkSession, pieces: Pieces):
        self.name, self.first_byte = uuid.uuid4().hex, pieces.first_byte
        self.broadcast = spark.sparkContext.broadcast(pieces.rows)

    def __hash__(self):
        return hash(self.name)

    def __eq__(self, other):
        return self.name == other.name


def merged(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds `ids`, by merge order, to rows with a `unit`; neighbouring rows of one unit share its lattice."""
    rules = _Rules(words.sparkSession, pieces)
    at = words.columns.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(at).dictionary_encode()
            ids = pa.array(_lattice_of(rules).encode(coded.dictionary.to_pylist()), pa.list_(pa.int32())).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{fields}, ids array<int>")


def viterbi(lattice: DataFrame) -> DataFrame:
    """(unit, ids) by the best sum of scores; of equal sums the path whose last piece starts first."""
    edge = F.struct("c", "a", "score", "ids")
    grouped = lattice.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    cell = "array<struct<score:double,ids:array<int>>>"
    size = F.length("unit")
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.when(i == 0, F.lit(0.0)).alias("score"), F.array().cast("array<int>").alias("ids"))).cast(cell)

    def step(best: Column, e: Column) -> Column:
        def better(old: Column) -> Column:
            score = F.get(best, e["a"])["score"] + e["score"]
            new = F.struct(score.alias("score"), F.concat(F.get(best, e["a"])["ids"], e["ids"]).alias("ids"))
            return F.when(score.isNotNull() & (old["score"].isNull() | (score > old["score"])), new).otherwise(old)

        return F.transform(best, lambda old, i: F.when(i == e["c"], better(old)).otherwise(old)).cast(cell)

    path = F.aggregate("edges", start, step, lambda best: F.get(best, size)["ids"])
    return grouped.select("unit", path.alias("ids"))


def heap_merge(unit: str, table: dict[str, tuple[int, float]], first_byte: int) -> list[int]:
    """The merge fold for units of any length, in n log n steps."""
    part: list[str | None] = list(unit)
    n = len(part)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (got := table.get(both := part[i] + part[j])) is not None:
            heapq.heappush(heap, (-got[1], i, j, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i, after[i])
        offer(before[i], i)
    out: list[int] = []
    for p in part:
        if p is not None:
            out += [table[p][0]] if p in table else [first_byte + b for b in p.encode()]
    return out


def encode_short(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) for distinct units, of a BPE model those of at most `LONG` characters.

    Units are dealt out first, so that edges need no further exchange. Their
    number of partitions is fixed: a unit becomes some fifty substrings, so
    partitions merged by the size of the units would be too large.
    """
    dealt = words.repartition(partitions(words.sparkSession), "unit")
    return merged(dealt, pieces) if pieces.bpe else viterbi(edges(dealt, pieces))


def encode_met(met: DataFrame, pieces: Pieces) -> DataFrame:
    """(part, unit, ids) for the units that tasks met; a unit may come from several."""
    dealt = met.repartition(partitions(met.sparkSession), "unit")
    if pieces.bpe:
        return merged(dealt.sortWithinPartitions("unit"), pieces)
    return dealt.join(encode_short(met.select("unit").distinct(), pieces), "unit").select("part", "unit", "ids")


def encode_units(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) for distinct units of any length."""
    if not pieces.bpe:
        return encode_short(words, pieces)
    table = words.sparkSession.sparkContext.broadcast({p: (i, s) for p, i, s in pieces.rows})
    first_byte = pieces.first_byte

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [heap_merge(u, table.value, first_byte) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["unit", "ids"])

    short = encode_short(words.filter(F.length("unit") <= LONG), pieces)
    return short.unionByName(words.filter(F.length("unit") > LONG).mapInArrow(rest, "unit string, ids array<int>"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units a task meets at least twice, with counts."""
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        often = [(u, n) for u, n in seen.items() if n > 1 and len(u) <= LONG]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["unit", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(units(text))
            if len(seen) > HELD:
                yield out()
    yield out()


def hot_units(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """The units of the highest counts, `hot` at most: all counts from the lowest that fits."""
    counts = cut_lineage(texts.mapInArrow(_count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")))
    least, total = 2, 0
    sizes = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("units"))  # at most 65,536 rows
    for n, m in sizes.orderBy(F.desc("n")).collect():
        if total + m > hot:
            least = n + 1
            break
        total += m
    return counts.filter(F.col("n") >= least).select("unit")


class _Known(dict):
    """Encodings of the hot units as 32-bit numbers; others come from the task's `rest`, what is in neither is merged here."""

    rest: dict[str, bytes]
    merge: Callable[[str], bytes]

    def __missing__(self, unit: str) -> bytes:
        found = self.rest.get(unit)
        if found is None:
            found = self.merge(unit)
            if len(self.rest) < 2 * HELD:
                self.rest[unit] = found
        return found


def _read_units(path: str, out: dict[str, bytes]) -> dict[str, bytes]:
    """Encodings by unit, as 32-bit numbers, of a folder of the shared file system; none if it is not there."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    for f in fs.get_file_info(pyarrow.fs.FileSelector(name, allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as file:
                for batch in pyarrow.parquet.ParquetFile(file).iter_batches(batch_size=8192, columns=["unit", "ids"]):
                    ids = batch.column(1)
                    values, ends = ids.flatten().to_numpy().tobytes(), np.cumsum(pc.list_value_length(ids).to_numpy()) * 4
                    for u, lo, hi in zip(batch.column(0).to_pylist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                        out[u] = values[lo:hi]
    return out


@lru_cache(maxsize=1)
def _hot_table(path: str) -> _Known:
    """The hot units, read once per worker."""
    return _read_units(path, _Known())


def _rest_table(folder: str, part: int) -> dict[str, bytes]:
    return _read_units(f"{folder}/part={part}", {})


def _rest_units(table: str, longest: int):
    """Units of at most `longest` characters that a task meets beyond the hot ones, with the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, part = _hot_table(table), TaskContext.get().partitionId()
        given: set[str] = set()
        for b in batches:
            new: set[str] = set()
            for text in b.column(0).to_pylist():
                new.update(filterfalse(hot.__contains__, units(text)))
            rest = [u for u in new if u not in given and len(u) <= longest]
            given = given if len(given) < 2 * HELD else set()
            given.update(rest)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rest), pa.int32()), pa.array(rest, pa.string())], ["part", "unit"])

    return run


def _same(texts: list[str], offsets: np.ndarray, ids: pa.Array, as_bytes: pa.Array) -> list[bool]:
    """Whether the pieces of each text decode to it: all are decoded in one pass."""
    decoded = as_bytes.take(ids)
    ends = np.frombuffer(decoded.buffers()[1], np.int64)[decoded.offset:decoded.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    spelled = memoryview(decoded.buffers()[2] or b"")
    same = []
    for text, lo, hi in zip(texts, ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True):
        same.append(bytes(spelled[lo + 1:hi]).decode(errors="replace") == text.replace(BLANK_SIGN, " "))
    return same


def _encode(table: str, rest: str, pieces):
    """Ids of the texts, and whether they decode to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rules = _hot_table(table), pieces.value
        known.rest = _rest_table(rest, TaskContext.get().partitionId())
        known.merge = lambda u: np.array(heap_merge(u, rules["table"], rules["first_byte"]), np.int32).tobytes()
        as_bytes = pa.array(rules["as_bytes"], pa.large_binary())
        for b in batches:
            texts = b.column(1).to_pylist()
            coded = [b"".join(map(known.__getitem__, units(text))) for text in texts]
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(coded), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(_same(texts, offsets, values, as_bytes), pa.bool_())],
                                             ["id", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, ids, round_trip) per document; round_trip: the ids decode to the text."""
    spark = ship_package(docs.sparkSession)
    pieces = Pieces(path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    often = cut_lineage(encode_short(hot_units(rows.select("text"), hot), pieces))
    files = often.inputFiles()
    if not files:
        raise RuntimeError("the table of hot units was not written")
    table = files[0].rsplit("/", 1)[0]
    longest = LONG if pieces.bpe else 1 << 30  # longer ones are merged where they stand
    met = rows.select("text").mapInArrow(_rest_units(table, longest), "part int, unit string")
    if not pieces.bpe:  # both sides of a join read it
        met = cut_lineage(met)
    folder = f"{shared_folder(spark)}/units-{uuid.uuid4().hex}"
    encode_met(met, pieces).repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(folder)
    discard(met)
    shared = spark.sparkContext.broadcast(
        {"table": {p: (i, s) for p, i, s in pieces.rows}, "first_byte": pieces.first_byte, "as_bytes": pieces.as_bytes})
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(table, folder, shared), f"id {kind}, ids array<int>, round_trip boolean")


def decode_ids(ids: list[int], as_bytes: list[bytes]) -> str:
    """The text of the pieces without the leading blank; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(as_bytes.__getitem__, ids))[1:].decode(errors="replace")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the pieces; null ids are none."""
    spark = ship_package(encoded.sparkSession)
    table = spark.sparkContext.broadcast(Pieces(path).as_bytes)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda i: decode_ids([] if i is None else i.tolist(), table.value))

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def model_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def piece_rows(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = model_path(path)
    coded = encode(read(spark, sf_dir, "documents"), path)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), "ids", "round_trip")
