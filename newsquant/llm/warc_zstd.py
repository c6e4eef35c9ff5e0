"""WARC archives with a Zstandard dictionary.

Every task writes its rows into archives of bounded size. An archive opens
with a skippable frame that holds a dictionary built from the archive's own
first records, then each record is a frame of its own, compressed with that
dictionary. A record whose payload another page already has becomes a revisit.

Archives go to the shared folder under a name of the attempt; the manifest,
written by Spark, lists only those of tasks that committed, so a task that
runs again leaves nothing double. Reading opens the manifest's archives, each
in one task.

Defined results: null html is an empty payload; payloads under 1000 bytes are
always responses; of equal payloads the largest page id is the response, rows
that repeat this id are all responses, and a null id is a response only where
no row of its payload has an id; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read, shared_uri, text_of
from newsquant.session import cut_lineage, ship_package

LEAST_SHARED = 1000
#: Bytes of payload per archive, bytes of first records a dictionary is built from, and the dictionary's size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 4 << 20, 64 << 10
#: Magic number of the skippable frame that carries a dictionary (fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to): refers_to is set for revisits.

    Only (id, digest) pairs are compared; the payload is moved once, to meet
    the repeated digests, and revisits leave theirs behind.
    """
    html = text_of("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).cast("bigint").alias("n_bytes"))
    shared = (
        rows.filter(F.col("n_bytes") >= LEAST_SHARED).groupBy("digest")
        .agg(F.max("page_id").alias("__last"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    joined = rows.join(cut_lineage(shared), "digest", "left")
    revisit = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    return joined.select(
        "page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "n_bytes",
        F.when(revisit, F.col("__last")).alias("refers_to"))


def record(page_id, url, html: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record; the HTTP header of a revisit states the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(html)}",
    ]
    if refers_to is not None:
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>",
                     "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + html + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; with too few records for training, the start of their bytes as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


class Archive:
    """One archive file in the making: records wait until the dictionary can be built from them."""

    def __init__(self, path: str):
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        self.path, self.out = path, fs.open_output_stream(name, compression=None)
        self.waiting: list[bytes] = []
        self.size, self.records, self.compress = 0, 0, None

    def add(self, rec: bytes) -> None:
        self.size += len(rec)
        self.records += 1
        if self.compress is None:
            self.waiting.append(rec)
            if self.size >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.compress(rec))

    def _open(self) -> None:
        data = build_dictionary(self.waiting)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        made = zstandard.ZstdCompressionDict(data) if data else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True).compress
        for rec in self.waiting:
            self.out.write(self.compress(rec))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if self.compress is None:
            self._open()
        self.out.close()
        return self.path, self.records


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for b in batches:
            done = []
            for row in zip(*(c.cast(pa.binary()).to_pylist() if n == "html" else c.to_pylist()
                             for n, c in zip(b.schema.names, b.columns, strict=True)), strict=True):
                if archive is None:
                    archive = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(*row))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], ["path", "records"])
        if archive is not None:
            path, n = archive.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "records"])

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write `pages` (as `with_types` gives them) to `folder`, a URI all executors share; returns the manifest."""
    ship_package(pages.sparkSession)
    fs, name = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    return cut_lineage(pages.mapInArrow(_writer(folder), "path string, records bigint"))


def records(stream) -> Iterator[bytes]:
    """The records of one archive, one frame after another."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    data = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    rest = b""
    while True:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if out:
                    raise EOFError("archive ends inside a record")
                return
            out.append(frame.decompress(rest))
            rest = frame.unused_data
        yield b"".join(out)


def parse(rec: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record; a wrong digest raises."""
    head, block = rec.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = block[:int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(uri: str | None):
        text = uri and uri.removeprefix("<urn:page:").removesuffix(">")
        return None if text in (None, "None") else int(text)

    return page(fields["WARC-Record-ID"]), length, digest, kind, page(fields.get("WARC-Refers-To"))


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_stream(name, compression=None) as stream:
                rows = []
                for rec in records(io.BufferedReader(stream, 1 << 20)):
                    rows.append(parse(rec))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], FIELDS)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's archives."""
    ship_package(manifest.sparkSession)
    types = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(_read, types)  # one row a file


def warc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_uri(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_types(read(spark, sf_dir, "pages")), folder))
