"""Medoid steps by codes of values, against the costs of all members."""

import random

import pytest

from newsquant.functions.distance import MINI_CATEGORY, MINI_NUMERIC
from newsquant.operators import medoids, nearest

SCHEMA = "event_id string, " + ", ".join(f"{c} double" for c in MINI_NUMERIC) + ", " + ", ".join(f"{c} string" for c in MINI_CATEGORY)


def rows(n, seed=4):
    rng = random.Random(seed)
    return [(f"e{i:04d}", *[rng.randrange(9) / 4 for _ in MINI_NUMERIC],
             *[rng.choice([None, "a", "", "é", f"v{rng.randrange(60)}"]) for _ in MINI_CATEGORY]) for i in range(n)]


def key(df):
    return sorted((r.cluster_id, *[r[c] for c in ("event_id", *MINI_NUMERIC, *MINI_CATEGORY)], round(r.total, 4), r.size) for r in df.collect())  # noqa: C414


@pytest.mark.parametrize("codes", [1 << 16, 20])
def test_rounds_equal_steps_by_costs(spark, monkeypatch, codes):
    """With codes for all values, and for the most frequent ones: no round makes the costs of all members."""
    monkeypatch.setattr(medoids, "MAX_CODES", codes)
    events = nearest.freeze(spark.createDataFrame(rows(300), SCHEMA))
    centres = medoids.freeze(spark.createDataFrame([(i, *r) for i, r in enumerate(rows(300)[5::60])], "cluster_id int, " + SCHEMA))
    coded = medoids.Coded.of(events, MINI_NUMERIC, MINI_CATEGORY, "event_id")
    assert bool(coded.rare) == (codes == 20)
    schema = medoids._step_schema(events, MINI_NUMERIC, MINI_CATEGORY, "event_id")
    assigned = nearest.freeze(nearest.assign_mixed(events, centres))
    want = key(medoids._step_by_costs(assigned, MINI_NUMERIC, MINI_CATEGORY, "event_id", centres))
    listed = centres.orderBy("cluster_id").collect()
    ids = medoids.np.arange(len(listed))
    assert key(medoids._best_coded(coded, listed, ids, [(r.cluster_id, r.event_id) for r in listed], schema)) == want
    monkeypatch.setattr(medoids, "_step_by_costs", None)
    assert key(medoids.medoid_step(assigned, medoids=centres)) == want


def test_odd_events_take_the_costs_of_all_members(spark):
    some = rows(20)
    null = spark.createDataFrame([*some, ("x", None, *some[0][2:])], SCHEMA)
    assert medoids.Coded.of(null, MINI_NUMERIC, MINI_CATEGORY, "event_id") is None
    twice = nearest.freeze(spark.createDataFrame([(*r, 0) for r in some + some], SCHEMA + ", cluster_id int"))
    want = key(medoids._step_by_costs(twice, MINI_NUMERIC, MINI_CATEGORY, "event_id", None))
    assert key(medoids.medoid_step(twice)) == want and len(want) == 2
