"""Medoid costs by look-up and by join, and the mixed assignment with many medoids."""

import random

import numpy as np
import pytest

from newsquant.functions.distance import MINI_CATEGORY, MINI_NUMERIC
from newsquant.operators import medoids, nearest

SCHEMA = "event_id string, " + ", ".join(f"{c} double" for c in MINI_NUMERIC) + ", " + ", ".join(f"{c} string" for c in MINI_CATEGORY)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(f"e{i:04d}", *[float(rng.randrange(9)) for _ in MINI_NUMERIC],
             *[rng.choice([None, "a", "b", "é", f"v{rng.randrange(40)}"]) for _ in MINI_CATEGORY]) for i in range(600)]


def far(x, y):
    n = len(MINI_NUMERIC)
    return sum(abs(a - b) for a, b in zip(x[1:n + 1], y[1:n + 1])) + sum(a is None or a != b for a, b in zip(x[n + 1:], y[n + 1:]))


def test_assignment_to_many_medoids(spark, rows):
    events = spark.createDataFrame(rows, SCHEMA)
    centres = rows[::3]
    table = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(centres)], "cluster_id int, " + SCHEMA.split(", ", 1)[1])
    got = {r.event_id: (r.cluster_id, r.dist) for r in nearest.assign_mixed(events, table).collect()}
    for r in rows:
        d = [far(r, c) for c in centres]
        assert got[r[0]] == (int(np.argmin(d)), min(d))


@pytest.mark.parametrize("cells", [medoids.MAX_CELLS, 120, 0])
def test_costs_by_look_up_and_join(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(medoids, "MAX_CELLS", cells)
    assigned = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], SCHEMA + ", cluster_id int")
    out = medoids.medoid_costs(assigned)
    got = {r.event_id: r.cost for r in out.collect()}
    for i, r in enumerate(rows):
        assert got[r[0]] == pytest.approx(sum(far(r, o) for o in rows[i % 3::3]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (cells < 1000)
