from datetime import date

from pyspark.sql import functions as F

from newsquant.operators import clean
from newsquant.schema import EVENT_COLUMNS
from newsquant.sources import events, keyed, prices, results


def event_line(**values):
    return "\t".join(str(values.get(c, "")) for c in EVENT_COLUMNS)


def write_day(folder, day, lines):
    (folder / f"{day}.export.CSV").write_text("\n".join(lines) + "\n")


FULL = dict(SQLDATE="20150101", QuadClass=1, GoldsteinScale=3.5, NumMentions=2, NumSources=1, NumArticles=2, AvgTone=-1.5,
            EventCode="010", EventRootCode="---", ActionGeo_Lat=1.0, ActionGeo_Long=2.0, Actor1CountryCode="USA",
            Actor1Name="THE PRESIDENT", URL="http://x.com/a")


def test_event_files(spark, tmp_path):
    write_day(tmp_path, "20150102", [event_line(GlobalEventID=1, **FULL), event_line(GlobalEventID=2, **FULL).rsplit("\t", 1)[0]])
    write_day(tmp_path, "20150105", [event_line(GlobalEventID=3, **{**FULL, "GoldsteinScale": ""})])
    (tmp_path / "other.txt").write_text(event_line(GlobalEventID=4) + "\n")
    df = events.read_events(spark, str(tmp_path))
    rows = {r["GlobalEventID"]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["2"]["URL"] is None and rows["1"]["pub_day"] == date(2015, 1, 2)
    assert events.read_events(spark, str(tmp_path), "2015-01-03", "2015-01-31").count() == 1
    typed = clean.normalise_events(df)
    codes = clean.vocab(typed, "event_code")
    countries = clean.vocab(typed, "actor1_country")
    out = clean.clean_events(typed, codes, countries, codes.limit(0)).orderBy("event_id").collect()
    assert [r["event_id"] for r in out] == ["1", "2"]
    first = out[0]
    assert (first["days_since_published"], first["code1"], first["code_full"], first["country1"], first["country2"]) == (-1, None, 1, 1, None)
    assert first["actor1_name"] == "president" and first["type1"] == 0
    assert clean.export_zeros(clean.clean_events(typed, codes, countries)).first()["code1"] == 0
    assert clean.clean_events(typed, codes, countries, symbol="XAG").count() == 2
    assert clean.clean_events(typed, codes, countries, symbol="XAU").count() == 0
    report = clean.drop_report(typed, clean.is_complete()).first()
    assert tuple(report) == (3, 2, 1)
    kept, seen = clean.with_counts(typed, clean.is_complete())
    assert kept.count() == 2 and seen.get == {"total": 3, "kept": 2}
    events.write_stage(df, str(tmp_path / "landed"))
    back = events.read_matrix(spark, str(tmp_path / "landed"), ["GlobalEventID", "pub_day"])
    assert back.filter("pub_day = '2015-01-05'").count() == 1


def test_price_files(spark, tmp_path):
    (tmp_path / "XAG.csv").write_text('"Index" "XAG.USD"\n2013-01-01 30.5\n2013-01-02 31\n')
    (tmp_path / "BB.csv").write_text('"Index" "BB.Open" "BB.High" "BB.Low" "BB.Close" "BB.Volume" "BB.Adjusted"\n2013-01-01 1 2 0.5 1.5 100 1.4\n')
    (tmp_path / "survey.csv").write_text('"Date" "Mid Price"\n01/09/2013 0.4\n2013-01-02 0.3\n')
    paths = {"XAGUSD": str(tmp_path / "XAG.csv"), "BB": str(tmp_path / "BB.csv"), "aabear": str(tmp_path / "survey.csv")}
    table = prices.read_prices(spark, paths)
    assert table.filter("symbol = 'BB'").count() == 6
    wide = prices.pivot_fields(table.filter("symbol = 'BB'"), ["open", "close", "adjusted"]).first()
    assert (wide["open"], wide["close"], wide["adjusted"]) == (1.0, 1.5, 1.4)
    registry = {"XAGUSD": ("XAG.USD", True), "BB": ("BB.Adjusted", True), "aabear": ("Mid Price", False)}
    chosen = prices.read_prices(spark, paths, registry)
    assert {(r["symbol"], r["field"]) for r in chosen.collect()} == {(s, "price") for s in registry}
    by_name = {"XAG": registry["XAGUSD"], "BB": registry["BB"], "survey": registry["aabear"]}
    globbed = prices.read_prices(spark, str(tmp_path / "*.csv"), by_name)
    assert sorted(tuple(r)[1:] for r in globbed.collect()) == sorted(tuple(r)[1:] for r in chosen.collect())
    survey = chosen.filter("symbol = 'aabear'").orderBy("day").collect()
    assert [r["day"] for r in survey] == [date(2013, 1, 2), date(2013, 1, 9)] and not survey[0]["log_return"]


def test_forecast_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text('"","dates","m","u","l","a"\n"1",2015-02-03,0.1,0.2,0.0,0.05\n')
    row = prices.read_forecasts(spark, str(tmp_path / "f.csv"), ["mean", "hi", "lo", "actual"]).first()
    assert tuple(row) == (date(2015, 2, 3), 0.1, 0.2, 0.0, 0.05)


def test_keyed_load(spark):
    lines = spark.createDataFrame([("7\ta\tb", 1), ("7\tc", 2), ("nokey", 3), ("\tx", 4), ("10\tz", 5)], "value string, load_seq int")
    split = keyed.split_key(lines)
    assert keyed.rejected(split).count() == 2
    latest = {r["key"]: r["rest"] for r in keyed.upsert_events(split, values=["rest"]).collect()}
    assert latest == {"7": "c", "10": "z"}
    table = spark.createDataFrame([(7,), (10,), (100,)], "key int")
    assert [r[0] for r in keyed.scan_range(table, 8, 50).collect()] == [10]
    assert sorted(r[0] for r in keyed.scan_range(table, "10", "2", as_text=True).collect()) == [10, 100]


def test_uniform_keys_fill_gaps(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (90, "c"), (100, "d")], "k long, id string")
    got = {r["i"]: r["id"] for r in keyed.uniform_keys(df, 5, "k", "id").collect()}
    assert got == {0: "a", 1: "c", 2: "c", 3: "c", 4: "c"}


def test_results_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("a b", 0.1), ("c", 0.9)], "index string, valid_r2 double")
    results.write_results(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "|a b|" in text and text.index("0.9") < text.index("0.1")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.txt").write_text("start\nK: 30\ntrain error = 0.25 test error = 0.5\n")
    assert tuple(results.parse_run_logs(spark, str(tmp_path / "log")).first()) == (30, 0.25, 0.5)
    row = results.parse_run_lines(spark, str(tmp_path / "log"), (1, 1), (2, 3), (2, -1)).first()
    assert tuple(row) == (30, 0.25, 0.5)


def test_small_helpers(spark):
    df = spark.createDataFrame([("1.5", "k"), ("x", "")], "a string, key string")
    got = events.infer_numbers(df, ["a"]).select("a_num", "a_text").collect()
    assert [tuple(r) for r in got] == [(1.5, None), (None, "x")]
    typed = events.parse_typed(df, {"a": "DOUBLE"}).select("a", "bad_cells").collect()
    assert [tuple(r) for r in typed] == [(1.5, 0), (None, 1)]
    assert events.valid_rows(df, "key", ["a"], 1).count() == 1
    both = events.union_files([df, df.select("a")])
    assert both.count() == 4 and both.filter(F.col("key").isNull()).count() == 2
    names = spark.createDataFrame([("France",), ("Nowhere",)], "n string")
    table = spark.createDataFrame([("FRANCE", "FRA")], "name string, alpha3 string")
    assert {r["n"]: r["alpha3"] for r in clean.name_to_alpha3(names, "n", table).collect()} == {"France": "FRA", "Nowhere": None}
