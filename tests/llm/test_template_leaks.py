import random

from newsquant.llm import template_leaks as tl

SF = "/root/testdata/sf0.001"
ITEM = "item_id BIGINT, text STRING"


def verdicts(spark, sf, docs, items):
    path = sf(docs, benchmark=spark.createDataFrame(items, ITEM))
    return {r.doc_id: list(r.item_ids) for r in tl.leak_rows(spark, path).collect()}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


QUESTION = "If the farmer Smith sells 12 apples for 30 cents and then Smith buys 12 more pears how much money does he have"


def test_reparameterised(spark, sf, odd):
    other = "If the farmer Jones sells 45 apples for 99 cents and then Jones buys 45 more pears how much money does he have"
    mixed = "If the farmer Jones sells 45 apples for 99 cents and then Brown buys 46 more pears how much money does he have"
    docs = odd + [
        (100, QUESTION), (101, prose(1) + ". " + QUESTION + ". " + prose(2)), (102, f"{prose(3)}.\n{other}"), (103, prose(4) + ". " + mixed),
        (104, prose(5)), (105, "the 12 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (106, " ".join(QUESTION.split()[:11]) + " " + prose(6)),
        (107, QUESTION.replace(" ", "  ,, ")), (108, QUESTION.upper().lower()),
    ]
    got = verdicts(spark, sf, docs, [(1, QUESTION), (2, prose(9, 30)), (3, None), (4, "too short"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")])
    assert len(got) == len({d for d, _ in docs})
    assert {d for d in got if got[d]} == {100, 101, 102, 107}
    assert all(v in ([], [1]) for v in got.values())


def test_empty_tables(spark, sf, odd, docs):
    assert not any(verdicts(spark, sf, odd, []).values())
    assert verdicts(spark, sf, [], [(1, QUESTION)]) == {}
    kept = tl.keep_clean(docs(odd + [(100, QUESTION)]), spark.createDataFrame([(1, QUESTION)], ITEM))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == len(odd)


def test_query_finds_whole_items_only_where_they_are(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {d: sorted(i for i, x in items.items() if x in t) for d, t in docs.items()}
    got = {r.doc_id: list(r.item_ids) for r in tl.leak_rows(spark, SF).collect()}
    for d in docs:
        assert set(want[d]) <= set(got[d]), d
    # what is flagged beyond whole items shares 13 words in a row with them
    for d in docs:
        words = docs[d].lower().split()
        grams = {" ".join(words[i:i + 11]) for i in range(len(words))}
        for i in set(got[d]) - set(want[d]):
            w = items[i].lower().split()
            assert any(" ".join(w[k:k + 11]) in grams for k in range(len(w))), (d, i)


def test_plan_has_no_python(spark):
    plan = tl.leak_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_values_of_another_length_and_moved_words(spark, sf):
    words = QUESTION.split()
    docs = [
        (1, prose(1) + ". " + QUESTION.replace("Smith", "John Smith") + ". " + prose(2)),
        (2, prose(3) + ". " + QUESTION.replace("12", "12 000")), (3, " ".join([*words[:11], "so", *words[11:]])),
        (4, " ".join(words[:12] + words[13:])), (5, QUESTION.replace("farmer Smith", "farmer John Smith").replace("then Smith", "then Brown")),
    ]
    got = verdicts(spark, sf, docs, [(1, QUESTION)])
    assert {d for d in got if got[d]} == {1, 2, 3, 4}


def test_items_of_placeholders_and_short_items(spark, sf):
    german = ("Im alten Haus steht der Tisch neben dem Schrank und vor dem Fenster liegt die Katze auf dem Teppich mit der Maus "
              "unter dem Stuhl")
    sums = "Add 3 to 4 and 5 to 6 and 7 to 8 and 9 to 10 and 11 to 12"
    names = "the Ship from Rome to Oslo via Bern by Anna"
    items = [(1, german), (2, sums), (3, "How old is Peter now"), (4, "What is the capital of old France"), (5, names + " was late")]
    docs = [
        (1, prose(1) + ". " + german + ". " + prose(2)), (2, prose(3) + ". " + sums), (3, sums.replace("3", "33").replace("7", "99")),
        (4, "Ask: How old is Peter now? " + prose(4)), (5, "How old is Karl now"), (6, prose(5) + ". What is the capital of old Sweden? " + prose(6)),
        (7, "they took " + names + " again"),
    ]
    got = verdicts(spark, sf, docs, items)
    assert got == {1: [1], 2: [2], 3: [], 4: [3], 5: [], 6: [4], 7: []}
