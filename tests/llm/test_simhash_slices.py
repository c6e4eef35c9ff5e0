import random
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from newsquant.llm import simhash_slices as sh

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{p:016x}", low.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def test_cases_equal_brute_force(spark, sf, odd):
    words = [f"w{i}" for i in range(60)]
    rng = random.Random(3)
    rows = list(odd)
    for i in range(120):
        text = words.copy()
        for _ in range(i % 4):
            text[rng.randrange(60)] = f"n{rng.randrange(99)}"
        rows.append((200 + i, " ".join(text)))
    got = sorted(map(tuple, sh.simhash_rows(spark, sf(rows)).collect()), key=str)
    assert got == brute(rows)
    assert sh.simhash_rows(spark, sf([])).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, sh.simhash_rows(spark, SF).collect()), key=str) == brute(rows)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 3), st.integers(0, 2**32))
def test_sliced_distances(prints, radius, seed):
    rng = random.Random(seed)
    prints = [p if rng.random() < 0.5 else prints[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints]
    a = np.array(prints, np.uint64)
    sliced = sh.planes(a)
    valid = np.packbits((np.arange(sliced.shape[1] * 64) < len(a)).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    q = np.repeat(a, sliced.shape[1])
    w = np.tile(np.arange(sliced.shape[1]), len(a))
    masks = sh.near(sliced, valid, q, w, radius).reshape(len(a), -1)
    for i, x in enumerate(prints):
        want = {j for j, y in enumerate(prints) if (x ^ y).bit_count() <= radius}
        assert {64 * k + b for k in range(masks.shape[1]) for b in range(64) if int(masks[i, k]) >> b & 1} == want


def test_links_with_split_buckets(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print bigint")
    want = {(max(a, b), min(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for split in (8192, 20):
        assert {tuple(r) for r in sh.links(df, split=split).collect()} == want


def test_keep_first(spark, docs, odd):
    rows = odd + [(50, "same text here now ok"), (49, "same text here now ok"), (48, "another one entirely different words")]
    out = sh.keep_first(docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in out.collect()]
    assert {49, 48, 0, 3, 4, None} <= set(ids) and not {50, 1, 2, 5} & set(ids)
    assert sh.keep_first(docs([])).count() == 0
