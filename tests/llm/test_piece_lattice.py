import itertools
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from newsquant.llm import piece_lattice as pl

SF = "/root/testdata/sf0.001"
PATH = pl.model_path()
STRANGE = ["a", "  a  b ", " ", "hé\n\tx", "ab\n\n  c\n", "漢字😀x", "▁a▁", "<s>x</s>", "x" * 300, "ab" * 200, "\x00\x01", "a　b", "ññññ", "  \n  ",
           "th" * 29 + "e", " " * 70, "0123456789" * 7]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return pl.Pieces(PATH)


def test_units_join_to_the_text(pieces):
    for text in STRANGE:
        assert "".join(pl.units(text)) == " " + text.replace("▁", " ")


def test_units_equal_heap_and_library(spark, library, pieces):
    words = sorted({u for t in STRANGE for u in pl.units(t)})
    got = {r.unit: list(r.ids) for r in pl.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), pieces).collect()}
    table = {p: (i, s) for p, i, s in pieces.rows}
    assert got == {w: pl.heap_merge(w, table, pieces.first_byte) for w in words}
    plain = [w for w in words if w.startswith(" ") and " " not in w[1:]]
    assert len(plain) > 5 and all(got[w] == library.encode(w[1:]) for w in plain if w != " ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinrst hTé\n漢▁", max_size=40))
def test_heap_merge_equals_library(library, pieces, text):
    table = {p: (i, s) for p, i, s in pieces.rows}
    assert [i for u in pl.units(text) for i in pl.heap_merge(u, table, pieces.first_byte)] == library.encode(text)


@pytest.mark.parametrize("hot", [0, 50, 1 << 19])
def test_texts_equal_library(spark, docs, odd, library, hot):
    rows = odd + [(100 + i, t) for i, t in enumerate(STRANGE)] + [(100, "a"), (100, "another of the same id")]
    coded = pl.decode(pl.encode(docs(rows), PATH, hot=hot), PATH).collect()
    assert len(coded) == len(rows)
    want = sorted((str(i), (t or "").replace("▁", " "), library.encode(t or "")) for i, t in rows)
    assert sorted((str(r.id), r.decoded, list(r.ids)) for r in coded) == want
    assert all(r.round_trip and r.decoded == library.decode(list(r.ids)) for r in coded)


def test_no_unit_is_merged_in_place_on_a_stored_table(spark, monkeypatch):
    """Every encoding comes from the lattice: with the fallback broken the result is the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = pl.encode(docs, PATH, hot=100).select("id", "ids").collect()
    run = pl._encode

    def broken(table, rest, pieces):
        inner = run(table, rest, pieces)

        def check(batches):
            import newsquant.llm.piece_lattice as worker

            merge = worker.heap_merge

            def fail(unit, *rules):
                assert len(unit) > worker.LONG, "merged in place"
                return merge(unit, *rules)

            worker.heap_merge = fail
            return inner(batches)

        return check

    monkeypatch.setattr(pl, "_encode", broken)
    got = pl.encode(docs, PATH, hot=100).select("id", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_other_rows_are_merged_in_place(spark, docs, library):
    rows = [(i, f"word{i} thntblere enverstach {i}") for i in range(40)]
    coded = pl.encode(docs(rows).repartition(5).orderBy("doc_id"), PATH, hot=0).collect()
    assert {r.id: list(r.ids) for r in coded} == {i: library.encode(t) for i, t in rows}


def test_query(spark, library, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pl.piece_rows(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.ids) == library.encode(texts[r.doc_id]) and r.round_trip and r.n_pieces == len(r.ids)
    assert pl.piece_rows(spark, sf([])).count() == 0


def test_viterbi_equals_brute_force(spark):
    rows = [("a", 1, -2.0), ("b", 2, -2.5), ("ab", 3, -3.0), ("ba", 4, -3.1), ("aba", 5, -6.5), ("_", 6, -1.0), ("_a", 7, -2.2), ("bb", 8, -4.0)]

    class Table:
        longest, first_byte, bpe = 3, 1000, False

    Table.rows = rows
    table = {p: (i, s) for p, i, s in rows}
    words = ["_" + "".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    frame = spark.createDataFrame([(w,) for w in words], "unit string")
    Table.frame = lambda self, s: s.createDataFrame(rows, "piece string, id int, score double")

    def best(w):
        if not w:
            return 0.0
        return max((table[w[:k]][1] + best(w[k:]) for k in (1, 2, 3) if w[:k] in table and len(w) >= k), default=float("-inf"))

    score = {i: s for _, i, s in rows}
    text = {i: p for p, i, _ in rows}
    for r in pl.encode_units(frame, Table()).collect():
        assert "".join(text[i] for i in r.ids) == r.unit
        assert abs(sum(score[i] for i in r.ids) - best(r.unit)) < 1e-9


def test_lattices_at_once_equal_heap(pieces):
    rng = random.Random(3)
    parts = [p for p, _, _ in pieces.rows if " " not in p] + ["漢", "\x00", "😀", "é"]
    some = ["".join(rng.choices(parts, k=rng.randint(1, 9)))[:pl.LONG] for _ in range(5000)] + [u for t in STRANGE for u in pl.units(t) if len(u) <= pl.LONG] + [""]
    table = {p: (i, s) for p, i, s in pieces.rows}
    got = pl.Lattice(pieces.rows, pieces.first_byte).encode(some)
    assert got == [pl.heap_merge(u, table, pieces.first_byte) for u in some]


def test_pieces_of_equal_keys_and_scores(monkeypatch):
    rows = [("a", 0, -9.0), ("b", 1, -9.0), ("ab", 2, -1.0), ("ba", 3, -1.0), ("aba", 4, -2.0), ("bab", 5, -2.0)]
    some = ["".join(x) for n in range(1, 8) for x in itertools.product("ab", repeat=n)]
    table = {p: (i, s) for p, i, s in rows}
    want = [pl.heap_merge(u, table, 100) for u in some]
    assert pl.Lattice(rows, 100).encode(some) == want
    monkeypatch.setattr(pl, "_STEP", np.uint64(1))  # "ab" and "ba" get one key
    assert pl.Lattice(rows, 100).encode(some) == want


def test_units_are_not_exploded_into_rows(spark, pieces):
    """The substrings of a unit are joined inside its row: 500 long units stay 500 rows in every step of the plan."""
    words = spark.createDataFrame([(f"{i:060d}",) for i in range(500)], "unit string")
    coded = pl.encode_short(words, pieces)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and coded.count() == 500
