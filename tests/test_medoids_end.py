"""k-medoids ends with stable medoids or an error."""

import pytest

from newsquant.operators import medoids


def test_kmedoids_ends_stable_or_raises(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 101), "ab"[i % 2], i) for i in range(60)], "event_id long, x double, c string, seq long")
    with pytest.raises(RuntimeError):
        medoids.kmedoids(df, 4, "seq", 1, ["x"], ["c"])
    found, history = medoids.kmedoids(df, 4, "seq", numeric=["x"], category=["c"])
    rounds = {}
    for r in history.collect():
        rounds.setdefault(r.iteration, {})[r.cluster_id] = r.event_id
    assert len(rounds) > 1 and rounds[max(rounds)] == rounds[max(rounds) - 1] == {r.cluster_id: r.event_id for r in found.collect()}
