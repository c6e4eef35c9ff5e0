"""Name vectors in the expanded event, and phrases merged inside the row."""

import random

import numpy as np
import pytest

from newsquant.operators import clusters, encode, nearest, text

CATEGORIES = [r.name for r, _ in encode.layout().categories]


def expanded(row, lay):
    x = np.zeros(lay.width)
    for r, at in lay.topics:
        v = row[r.name]
        if r.kind == "vector":
            x[at:at + r.size] = v
        elif r.kind == "numeric":
            x[at] = v or 0.0
        elif v is not None:
            x[at + v - 1] = 1.0
    return x


@pytest.fixture(scope="module")
def events(spark):
    """Events of the full layout with two 100-wide name vectors."""
    rng = random.Random(3)
    lay = encode.layout(names=100)
    rows, kinds = [], []
    for i in range(300):
        row = [i]
        for r, _ in lay.topics:
            if r.kind == "categorical":
                row.append(None if rng.random() < 0.1 else rng.randrange(1, r.size + 1))
            elif r.kind == "numeric":
                row.append(rng.gauss(0, 3))
            else:
                row.append([0.0] * 100 if rng.random() < 0.2 else [rng.gauss(0, 0.1) for _ in range(100)])
        rows.append(row)
    kinds = {"categorical": "int", "numeric": "double", "vector": "array<double>"}
    schema = "event_id int, " + ", ".join(f"{r.name} {kinds[r.kind]}" for r, _ in lay.topics)
    return lay, spark.createDataFrame(rows, schema)


def test_assignment_equals_brute_force(events):
    lay, df = events
    assert lay.width == 938 + 200
    x = np.array([expanded(r, lay) for r in df.orderBy("event_id").collect()])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 1e-12, std, 1)
    stats = encode.slot_stats(df, lay)
    got = sorted(stats.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(lay.width))
    assert np.allclose([r["mean"] for r in got], x.mean(axis=0)) and np.allclose([r["std"] for r in got], np.where(std > 1e-12, std, 1))
    seeds = df.filter("event_id % 60 = 7").selectExpr("CAST(event_id AS INT) AS i", *[r.name for r, _ in lay.topics])
    centres = nearest.event_centroids(seeds, lay, stats)
    out = {r.event_id: r for r in nearest.assign_expanded(df, lay, stats, centres).collect()}
    ids = [7, 67, 127, 187, 247]
    far = ((z[:, None] - z[ids][None]) ** 2).sum(axis=2)
    for i in range(300):
        assert out[i].cluster_id == ids[int(far[i].argmin())] and out[i].dist == pytest.approx(np.sqrt(far[i].min()), abs=1e-6)
    both = nearest.assign_models(df, lay, {5: (stats, centres)}).collect()
    assert {r.event_id: r.cluster_id for r in both} == {i: r.cluster_id for i, r in out.items()}


def test_training_vectors_hold_the_dense_block(events):
    lay, df = events
    vectors = encode.sparse_vectors(df.orderBy("event_id"), lay)
    order = encode.slot_order(lay)
    rows = vectors.collect()
    for r in rows[:20]:
        assert np.allclose(r["features"].toArray(), expanded(r, lay)[order])
    assert clusters.fit_kmeans(vectors.select("features"), 3).getK() == 3


def test_expand_lists_dense_cells(events):
    lay, df = events
    one = df.filter("event_id = 4").selectExpr("*", *[f"1.0D AS {c}" for c in lay.importance])
    cells = {r["slot"]: r["value"] for r in encode.expand(one, lay).collect() if r["slot"] < lay.width}
    want = expanded(one.first(), lay)
    assert cells == pytest.approx({i: v for i, v in enumerate(want) if v != 0})


def slow_merge(tokens, pairs):
    out, i = [], 0
    while i < len(tokens):
        if tuple(tokens[i:i + 2]) in pairs:
            out.append("_".join(tokens[i:i + 2]))
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_merge_inside_the_row(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(i, [rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 9, 40]))]) for i in range(120)] + [(200, None), (201, ["é", "a", "b"] * 3000)]
    pairs = {(a, b) for a in "abcdeé" for b in "abcde" if rng.random() < 0.4}
    tokens = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    accepted = spark.createDataFrame(sorted(pairs) * 2, "a string, b string")
    want = {i: slow_merge(t, pairs) for i, t in docs if t}
    merged = text.merge_phrases(tokens, accepted)
    assert {r.doc_id: r.tokens for r in merged.collect()} == want
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.tokens for r in text.merge_phrases(tokens, accepted.limit(0)).collect()} == {i: t for i, t in docs if t}
    monkeypatch.setattr(text, "MAX_PAIRS", 0)
    joined = text.merge_phrases(tokens, accepted.distinct())
    assert {r.doc_id: r.tokens for r in joined.collect()} == want
