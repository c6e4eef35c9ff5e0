import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsquant.llm import lpf_dedup as ld

SF = "/root/testdata/sf0.001"


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                x = b[i:i + 50]
                first[x] = min(d, first.get(x, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i:i + 50]] < d:
                    gone[i:i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]][:len(gone)]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def case(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 30), prose(rng, 14), "é" * 40 + prose(rng, 12), "-" * 120, "ab" * 50]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            lo = rng.randrange(max(1, len(s) - 50))
            parts += [s[lo:] if rng.random() < .5 else s, prose(rng, rng.randrange(0, 20))]
        rows.append((rng.randrange(-20, 500), rng.choice([" ", ""]).join(parts)))
    return rows + [(600, rows[0][1]), (601, rows[0][1]), (602, rows[0][1][7:] + "x"), (None, rows[1][1])]


@pytest.mark.parametrize("split", [20_000, 1])
def test_cases_equal_brute_force(spark, docs, odd, split):
    for rows in (odd + case(1), case(2)):
        got = ld.remove_repeats(docs(rows), split=split).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, ld.repeat_rows(spark, SF).collect()), key=str) == brute(rows)
    assert ld.repeat_rows(spark, sf([])).count() == 0


def test_small_buffers_change_nothing(monkeypatch):
    rng = random.Random(4)
    text = np.frombuffer((prose(rng, 4000) + "z" * 300 + prose(rng, 2000)).encode(), np.uint8)
    whole = ld.stretches(text, np.array([0, len(text)]))
    assert whole[2].sum() == len(text) - 49
    monkeypatch.setattr(ld, "PASS_BYTES", 500)
    seen = [x for at, _, first, n, _, _ in ld._pieces([text.tobytes()], np.array([0, len(text)])) for f, m in zip(first, n, strict=True)
            for x in range(at + f, at + f + m)]
    assert sorted(seen) == list(range(len(text) - 49))


def test_hashes_do_not_depend_on_the_place():
    rng = random.Random(6)
    own, before = prose(rng, 60).encode(), prose(rng, 90).encode()
    alone = ld.stretches(np.frombuffer(own, np.uint8), np.array([0, len(own)]))
    text = before + own + before
    within = ld.stretches(np.frombuffer(text, np.uint8), np.array([0, len(before), len(before) + len(own), len(text)]))
    of = within[0] == 1
    assert of.sum() == len(alone[0]) and all((a == b[of]).all() for a, b in zip(alone[1:], within[1:], strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40))
def test_previous_smaller(values):
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert list(ld.previous_smaller(np.array(values, np.int64))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=9, max_size=9), st.integers(0, 4)), min_size=1, max_size=25))
def test_longest_previous(rows):
    def same(x, y):
        return next((k for k in range(9) if x[k] != y[k]), 9)

    s = np.array([list(t.encode()) for t, _ in rows], np.uint8)
    want = [max((same(t, u) for u, e in rows if e < d), default=0) for t, d in rows]
    assert list(ld.longest_previous(s, np.array([d for _, d in rows]))) == want
