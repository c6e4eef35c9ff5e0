"""What keeps the work of phrases, panels and streams in step with their input."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsquant.operators import text
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog import streams

SF = "/root/testdata/sf0.001"


def test_pairs_of_rare_words_are_left_out_before_the_shuffle(spark, monkeypatch):
    rows = [(i, ["a", "b", f"r{i}", "a", "b"]) for i in range(6)] + [(6, []), (7, None), (8, ["b"]), (9, ["a", None, "b"])]
    tokens = spark.createDataFrame(rows, "doc_id INT, tokens ARRAY<STRING>")
    sent, make = [], text._likely_pairs

    def kept(bits):
        sent.append(bits.value)
        return make(bits)

    monkeypatch.setattr(text, "_likely_pairs", kept)
    got = [(r.a, r.b, r.n_ab, round(r.score, 6)) for r in text.phrase_scores(tokens, 5).collect()]
    assert got == [("a", "b", 12, round((12 - 5) * 9 / (13 * 14), 6))]
    words, hashes = (spark.createDataFrame(rows[:6], tokens.schema).select("tokens", F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
                     .toArrow().combine_chunks().columns)
    batch = pa.RecordBatch.from_arrays([words.combine_chunks(), hashes.combine_chunks()], ["tokens", "hashes"])
    bits = type("Bits", (), {"value": np.asarray(sent[0])})
    out = pa.Table.from_batches(make(bits)(iter([batch]))).to_pylist()
    assert out == [{"a": "a", "b": "b"}] * 12


def test_panel_is_made_once(spark):
    panel = pl.model_panel(spark, SF)
    assert "Join" not in panel._jdf.queryExecution().optimizedPlan().toString()


def test_batch_without_closed_days_is_not_held(spark, monkeypatch):
    held, kind = [], type(spark.range(1))
    persist = kind.persist

    def counted(self, *level):
        held.append(1)
        return persist(self, *level)

    monkeypatch.setattr(kind, "persist", counted)
    assert streams.stream_day_summary(spark, SF).count() > 0
    assert not held
