import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsquant.llm import keyed_shards as ks

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for d, t in sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_library(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(ks.shard_rows(spark, folder)) == brute(rows)


def test_odd_rows(spark, sf, odd):
    assert got(ks.shard_rows(spark, sf(odd))) == brute(odd)
    assert ks.shard_rows(spark, sf([])).collect() == []


def test_small_shards_parts_and_spans(spark, monkeypatch, tmp_path):
    rows = [(i % 40, f"text {i} " * (i % 7)) for i in range(200)] + [(None, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS copy", "2 AS shard", "3 AS path")
    for name, value in (("PART_KEYS", 16), ("SPAN", 64)):
        monkeypatch.setattr(ks, name, value)
    layout, keys = ks.build(docs, PATH, folder=f"file://{tmp_path}/ids")
    assert len(layout.parts) == 13 and keys.count() == len(rows)
    out = ks.checksums(layout, ks.look_up(layout, keys)).select("doc_id", "start", "n_tokens", "ids_crc32")
    want = brute(rows)
    assert got(out) == want
    again = ks.Layout.load(f"{layout.folder}/layout.json")
    reader, copies = ks.Reader(again), {}
    for d, _, n, crc in want:
        copy = copies[d] = copies.get(d, -1) + 1
        ids = reader.ids(d, copy)
        assert len(ids) == n and zlib.crc32(ids.astype("<u4")) == crc
    assert reader.ids(39, 5) is None and reader.ids(1000) is None
    absent = spark.createDataFrame([(1000, 0), (1, 99), (3, 0)], "doc_id BIGINT, copy BIGINT")
    assert [r.doc_id for r in ks.look_up(layout, absent).collect()] == [3]


def test_index_is_minimal_and_refuses_strangers():
    digests = [ks.digest_of(i) for i in range(20000)]
    at = np.arange(20000)
    index = ks.HashIndex.parse(ks.HashIndex.build(digests, at % 7, at * 3, at + 1).dump())
    number = index.find(digests)
    assert sorted(number) == list(range(20000))
    assert (index.table["offset"][number] == at * 3).all() and (index.table["length"][number] == at + 1).all()
    assert (index.find([ks.digest_of(-i) for i in range(1, 20000)]) == -1).all()
    assert len(index.words) * 64 < 5 * 20000
    assert len(ks.HashIndex.parse(ks.HashIndex.build([], [], [], []).dump()).find([digests[0]])) == 1
    with pytest.raises(ValueError):
        ks.HashIndex.build(digests[:1] * 2, [0, 0], [0, 0], [1, 1])


LIBRARY, ENCODER = Tokenizer.from_file(PATH), ks.Encoder(PATH, 2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x1c\x85\xa0\u0301Σς'sİ한ᄀ<|endoftext|>")), max_size=30))
def test_words_encode_as_the_whole_text(text):
    want = [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(ENCODER.encode(text), ENCODER.type).tolist() == want
