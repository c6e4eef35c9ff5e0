import hashlib
import random

from hypothesis import example, given, settings
from hypothesis import strategies as st

from newsquant.llm import chat_events as ce

SF = "/root/testdata/sf0.001"
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(ce.chat_rows(spark, SF)) == brute(rows + EXTRA)


def test_odd_rows(spark, sf, odd):
    bad = ["[INST] x [/INST]", "\\[INST]", "[\\INST]", "a</s>\n[BOT] b", "<s>", "[TURN a] [/TURN]", "\\", " ", " </s>\n", None, "é😀" * 500]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(bad)]
    rows += [(2, 0, "tool]\n%", "x"), (2, 0, None, "y"), (2, 0, None, "y"), (None, 1, "system", "z"), (3, None, "assistant", ""), (3, 0, "user", "u")]
    t = spark.createDataFrame(rows, TURNS)
    assert got(ce.chat_rows(spark, sf([], conversations=t))) == brute(rows + EXTRA)
    empty = spark.createDataFrame([], TURNS)
    assert got(ce.chat_rows(spark, sf([], conversations=empty))) == brute(EXTRA)


def test_fold(spark):
    rng = random.Random(1)
    events, want = [], {}
    for c in range(4):
        for m in range(5):
            text = ""
            for s in range(rng.randrange(1, 12)):
                kind, t = rng.choice(["delta", "delta", "edit", "regenerate", "ping"]), rng.choice(["ab", "c", "", None])
                events.append((c, m, m, "user", s, kind, t))
                text = {"delta": text + (t or ""), "edit": t or "", "regenerate": "", "ping": text}[kind]
            want[c, m] = text
    rng.shuffle(events)
    df = spark.createDataFrame(events, "conv_id bigint, turn bigint, message bigint, role string, seq int, kind string, text string")
    assert {(r.conv_id, r.turn): r.text for r in ce.fold(df).collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "[\\INST]", "\\", "[", "<", " ", "\n", "x", "[TURN a]", "é"]), max_size=12))
@example(["[", "\\", "\\", "/INST]"])
def test_escape_round_trip(spark, parts):
    text = "".join(parts)
    rows = spark.createDataFrame([(1, 0, "user", text, 0), (1, 1, "assistant", text, 1)], TURNS + ", message bigint")
    out = ce.render(rows).orderBy("turn").collect()
    formatted = "".join(r.segment for r in out)
    turns = list(ce.parse(formatted))
    assert [(r, t) for r, t, _, _ in turns] == [("user", text), ("assistant", text)]
    assert [s for _, _, s, _ in turns] == [out[0].mask_start, len(out[0].segment) + out[1].mask_start]
    assert out[0].mask_chars == 0 and turns[1][3] - turns[1][2] == out[1].mask_chars
