import hashlib
import math
import random

import numpy as np
import pytest

from newsquant.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"
TABLE = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows):
    """Plain search and Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    length = len(kept[0][1])
    kept = [(i, v + [0] * (-length % 4), lab) for i, v, lab in kept if len(v) == length]
    w = len(kept[0][1]) // 4
    cut = [[tuple(v[p * w:p * w + w]) for _, v, _ in kept] for p in range(4)]
    books = [c[:256] for c in cut]

    def near(book, x, memo):
        if x not in memo:
            memo[x] = min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
        return memo[x]

    for _ in range(4):
        for p in range(4):
            memo, groups = {}, {}
            for x in cut[p]:
                groups.setdefault(near(books[p], x, memo)[1], []).append(x)
            books[p] = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    memos = [{} for _ in range(4)]
    out, per = [], {}
    for n, (i, _, lab) in enumerate(kept):
        found = [near(books[p], cut[p][n], memos[p]) for p in range(4)]
        error = sum(f[0] for f in found)
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, lab))
        per[lab] = per.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per[lab], digest) for i, c, e, lab in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(vc.code_rows(spark, folder)) == brute(rows)


def test_odd_rows(spark, sf):
    rng = random.Random(5)
    rows = [(rng.randrange(200), [rng.choice([0.0, -0.0, 0.001, -0.0001, 1.5, -2.25]) for _ in range(8)], rng.choice([1, 2, None])) for _ in range(600)]
    rows += [(1, None, 1), (2, [None] * 8, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, None), (None, [1.0] * 8, 3),
             (None, [1.0] * 8, 3), (5, [1.0] * 3, 2), (6, [], 2), (0, [-9.0] * 8, None)]
    t = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TABLE + ", v INT, code STRING, error INT")
    assert got(vc.code_rows(spark, sf([], embeddings=t))) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None, 1)], [(7, [1.0, 2.0, 3.0, 4.0], None)], [(i, [float(i), 0.5, -i / 3], 1) for i in range(9)], [(1, [], 1), (2, [], None)]])
def test_small_tables(spark, sf, rows):
    t = spark.createDataFrame(rows, TABLE)
    assert got(vc.code_rows(spark, sf([], embeddings=t))) == brute(rows)


def test_huge_components_are_held(spark, sf):
    t = spark.createDataFrame([(i, [s * 3e38] * 4, 1) for i, s in enumerate((1, -1, 1, 0))], TABLE)
    out = {r.vec_id: r for r in vc.code_rows(spark, sf([], embeddings=t)).collect()}
    assert [out[i].error for i in range(4)] == [0] * 4 and out[0].code == out[2].code


def test_search_is_exact_on_ties():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7):
        entries = rng.integers(-3, 4, (256, width))
        rows = rng.integers(-4, 5, (5000, width))
        index, best = vc.Codebook(entries).nearest(rows)
        far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()
