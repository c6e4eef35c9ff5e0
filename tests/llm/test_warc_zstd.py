import hashlib
import struct

import zstandard

from newsquant.llm import warc_zstd as wz

SF = "/root/testdata/sf0.001"
PAGES = "page_id BIGINT, url STRING, html STRING"


def brute(rows):
    last, seen = {}, {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            seen[b] = seen.get(b, 0) + 1
            if p is not None:
                last[b] = max(p, last.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        revisit = seen.get(b, 0) > 1 and b in last and p != last[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[b] if revisit else None))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, wz.warc_rows(spark, SF).collect()), key=str) == brute(rows)


def test_odd_rows(spark, sf):
    same, other = "é" * 700, "WARC/1.1\r\n\r\n" * 100
    rows = [(1, "http://a", same), (2, "http://b: c\r\nX: y", same), (9, None, same), (9, None, same), (3, "", None), (4, "u", ""),
            (5, "u", "short"), (6, "u", "short"), (None, "u", other), (None, "u", other), (7, "u", "z" * 3_000_000), (None, "u", same)]
    path = sf([], pages=spark.createDataFrame(rows, PAGES))
    assert sorted(map(tuple, wz.warc_rows(spark, path).collect()), key=str) == brute(rows)
    assert wz.warc_rows(spark, sf([], pages=spark.createDataFrame([], PAGES))).count() == 0


def test_archive_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wz, "SAMPLE_BYTES", 100_000)
    archive = wz.Archive(f"file://{tmp_path}/a.warc.zst")
    for i in range(300):
        html = f"<html><body><p>{'text %d ' % i * 40}</p></body></html>".encode()
        archive.add(wz.record(i, "http://x", html, hashlib.sha1(html).hexdigest(), len(html), None))
    path, n = archive.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and n == 300
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size:])
    assert first.startswith(b"WARC/1.1\r\n") and wz.parse(first)[0] == 0
    with (tmp_path / "a.warc.zst").open("rb") as f:
        assert [wz.parse(r)[0] for r in wz.records(f)] == list(range(300))


def test_writing_again_leaves_nothing_double(spark, tmp_path):
    pages = wz.with_types(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], PAGES))
    first = wz.write_archives(pages, f"file://{tmp_path}/w")
    second = wz.write_archives(pages, f"file://{tmp_path}/w")
    assert wz.read_archives(first).count() == wz.read_archives(second).count() == 2
