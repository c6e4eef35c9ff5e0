import hashlib
import heapq
import random
import re
import zlib

import pytest

from newsquant.llm import turn_repair as tr

SF = "/root/testdata/sf0.001"
TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit) by growing whole audits from the cheapest on; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        key = (i, roles[-1:])
        if key in seen:
            continue
        seen.add(key)
        moves = [("I", 3, i, r, ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            moves.append(("D", 4, i + 1, None, ()))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                moves.append(("K", extra, i + 1, role, ((role, text),)))
                moves += [("R", 3 + extra, i + 1, r, ((r, text),)) for r in ("user", "assistant")]
        for letter, c, j, role, kept in moves:
            new = roles if role is None else roles + role[:1]
            if (role is None or role[:1]) and re.fullmatch("(s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + c, audit + letter, j, new, out + kept))


def brute(rows):
    kept = {}
    for conv, turn, role, text in rows:
        group = kept.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        group += [(turn is not None, turn or 0, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return [digest(conv, sorted(group)) for conv, group in kept.items()]


def digest(conv, group):
    seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in group:
        ink = text.strip(BLANK)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault))
    numbers = [t for known, t, _, _ in group if known]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, out = cheapest(marked)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(tr.repair_rows(spark, folder)) == sorted(brute(rows), key=str)


def noise(seed, n, convs):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", None, " \n", "d? \t", "é.", "漢", "e. ", "f." * 300]
    roles = ["user", "assistant", "system", "tool", "", None, "u2"]
    return [(rng.choice(convs), rng.choice([None, rng.randrange(n)]) if rng.random() < 0.1 else rng.randrange(n),
             rng.choice(roles[:2]) if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(9)}.")
            for _ in range(n)]


def test_odd_rows(spark, sf):
    rows = [r for s in range(12) for r in noise(s, 14, [s, s, s, None])] + [(90, 0, "user", "x.")] * 3
    rows += [(91 + i, None, "user", None) for i in range(30)]  # some conversations lose every row
    t = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], TURNS + ", at INT, n INT, codes STRING, block INT, conv_ INT")
    assert got(tr.repair_rows(spark, sf([], conversations=t))) == sorted(brute(rows), key=str)
    empty = spark.createDataFrame([], TURNS)
    assert tr.repair_rows(spark, sf([], conversations=empty)).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_blocks_of_any_size_agree(spark, sf, monkeypatch, bits):
    monkeypatch.setattr(tr, "BLOCK_BITS", bits)
    rows = [r for s in range(6) for r in noise(50 + s, 30, [s])]
    t = spark.createDataFrame(rows, TURNS)
    assert got(tr.repair_rows(spark, sf([], conversations=t))) == sorted(brute(rows), key=str)


def test_long_block_and_ranks():
    rng = random.Random(3)
    codes = [rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(20000)]
    whole = tr.least_paths(codes, tr.END)
    audits, end, beyond = "", 0, tr.END
    parts = []
    for k in reversed(range(0, len(codes), 777)):
        *part, beyond = tr.least_paths(codes[k:k + 777], beyond)
        parts.append(part)
    for a, e in reversed(parts):
        audits, end = audits + a[end], e[end]
    assert (audits, end, beyond) == (whole[0][0], whole[1][0], whole[2])


def test_repaired_rows_are_the_real_output(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (1, 3, "assistant", "Yes.")]
    out = tr.repair(spark.createDataFrame(rows, TURNS)).orderBy("place").collect()
    assert [(r.edit, r.was, r.role, r.fault) for r in out] == [
        ("K", "user", "user", None), ("D", "user", None, "duplicate"), ("I", None, "assistant", None),
        ("K", "user", "user", None), ("K", "assistant", "assistant", None)]
    assert [r.text for r in out if r.role is not None] == ["Hi.", "", "More?", "Yes."]
