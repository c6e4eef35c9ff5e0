"""The whole chain on tiny raw files, and the plans Spark makes for it."""

from pyspark.sql import functions as F

from newsquant.operators import sample
from newsquant.plans import stages
from newsquant.sources import tables
from tests.test_sources import FULL, event_line, write_day

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_raw_files_to_day_summaries(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for day in ("20150101", "20150102"):
        write_day(raw, day, [event_line(**{
            **FULL, "GlobalEventID": f"{day}{i}", "EventCode": f"0{1 + i % 3}", "EventRootCode": 1 + i % 3,
            "ActionGeo_Lat": i % 3 * 10.0}) for i in range(30)])
    cleaned, models, out = (str(tmp_path / n) for n in ("cleaned", "models", "out"))
    stages.prepare(spark, str(raw), cleaned, "XAG", "2015-01-01", "2015-01-02")
    assert spark.read.parquet(cleaned).count() == 60
    scores = {r["k"]: r["score"] for r in stages.train(spark, cleaned, models, [2, 3], per_day=20).collect()}
    assert scores[2] < scores[3] <= 0
    stages.summarise(spark, cleaned, models, out)
    got = spark.read.parquet(out)
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {2: 6, 3: 8}
    assert {r["n"] for r in got.select("n").distinct().collect()} == {30}
    assert stages.train_mixture(spark, cleaned, models, 4, 1.0, per_day=20) > float("-inf")
    stages.summarise_mixture(spark, cleaned, models, f"{out}-mixture")
    mixed = spark.read.parquet(f"{out}-mixture")
    assert mixed.count() == 2 * 5 and {(r.k, r.n) for r in mixed.collect()} == {(4, 30)}
    assert all(abs(r.s - 1) < 1e-9 for r in mixed.filter("cluster_id >= 0").groupBy("pub_day").agg(F.sum("share").alias("s")).collect())


def test_price_files_and_summaries_to_ranked_forecasts(spark, tmp_path):
    import datetime
    import math

    days = [datetime.date(2014, 1, 1) + datetime.timedelta(i) for i in range(150)]
    news = [(k, d, c, *[float((i * 7 + c * 3 + j) % 5) for j in range(7)], ((i * 5 + c) % 7) / 7, 30)
            for k in (2, 3) for i, d in enumerate(days) for c in (-1, *range(k))]
    from newsquant.schema import IMPORTANCE

    schema = "k int, pub_day date, cluster_id int, " + ", ".join(f"{m} double" for m in IMPORTANCE) + ", share double, n bigint"
    summaries, out = str(tmp_path / "summaries"), str(tmp_path / "out")
    spark.createDataFrame(news, schema).write.partitionBy("k", "pub_day").parquet(summaries)
    folder = tmp_path / "prices"
    folder.mkdir()
    walk = [100 * math.exp(0.02 * math.sin(i * 1.3) + 0.001 * ((i * 37) % 11)) for i in range(150)]
    (folder / "XAG.csv").write_text('"Index" "XAG.USD"\n' + "".join(f'"{d}" {v}\n' for d, v in zip(days, walk)))
    fields = " ".join(f'"BB.{f}"' for f in ("Open", "High", "Low", "Close", "Volume", "Adjusted"))
    (folder / "BB.csv").write_text(f'"Index" {fields}\n' + "".join(f'"{d}" 1 2 1 {2 * v} 9 {v + 1}\n' for d, v in zip(days, reversed(walk))))

    panel = {(r.symbol, r.day): r for r in stages.price_panel(spark, str(folder)).collect()}
    assert len(panel) == 2 * 121 and panel["BB", days[40]].price == walk[109] + 1 and panel["XAG", days[40]].price == walk[40]
    scores = stages.evaluate(spark, summaries, str(folder), out, [2, None], 60, [0, 1], [0, 1], [0.3, 0.05]).collect()
    assert {r.symbol for r in scores} == {"XAG", "BB"} and [r.sign_accuracy for r in scores] == sorted((r.sign_accuracy for r in scores), reverse=True)
    models = {r.model for r in scores if r.symbol == "XAG"}
    assert {m for m in models if m.startswith("lasso")} == {f"lasso-k{k}-{p}" for k in (2, 3) for p in (0.3, 0.05)} and len(models) == 5
    assert all((r.coverage is not None) == r.model.startswith("arma") for r in scores)
    found = spark.read.parquet(f"{out}/forecasts")
    per = {(r.symbol, r.model): r["count"] for r in found.groupBy("symbol", "model").count().collect()}
    assert set(per.values()) == {61, 60}  # one day less where a lag is needed
    grid = spark.read.option("sep", " ").option("header", True).csv(f"{out}/grid").collect()
    assert len(grid) == 2 * 2 * 2
    assert spark.read.parquet(f"{out}/balance").groupBy("symbol").sum("n").collect()[0][1] == 120


def test_scan_reads_only_needed_columns(spark):
    text = plan(tables.news(spark, SF, "pub_day", "num_mentions").filter("num_mentions > 40"))
    assert "orders.parquet" not in text and "l_extendedprice" not in text.split("== Physical Plan ==")[1]


def test_small_samples_are_cut_before_the_shuffle(spark):
    text = plan(sample.sample_per_day(tables.news(spark, SF, "event_id", "pub_day"), 5))
    assert text.split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2


def test_queries_have_no_cross_joins_on_events(spark):
    from newsquant.plans import pipelines

    text = plan(pipelines.cleaned_news(spark, SF)).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_another_day_range_keeps_days_and_codes(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for day, codes in (("20150101", ["01", "03"]), ("20150102", ["03", "01", "03"])):
        write_day(raw, day, [event_line(**{
            **FULL, "GlobalEventID": f"{day}{i}", "EventCode": c, "Actor1CountryCode": "USA", "Actor2CountryCode": "CHN"})
            for i, c in enumerate(codes)])
    cleaned = str(tmp_path / "cleaned")
    stages.prepare(spark, str(raw), cleaned, lo="2015-01-01", hi="2015-01-01")
    first = {r.event_id: (r.code_full, r.country1, r.country2) for r in spark.read.parquet(cleaned).collect()}
    stages.prepare(spark, str(raw), cleaned, lo="2015-01-02", hi="2015-01-02")
    both = {r.event_id: (r.code_full, r.country1, r.country2) for r in spark.read.parquet(cleaned).collect()}
    assert len(first) == 2 and len(both) == 5 and first.items() <= both.items()
    # a country that only the second actor has is coded too, and codes keep their numbers
    assert set(both.values()) == {(1, 2, 1), (2, 2, 1)}
    assert both["201501020"][0] == both["201501011"][0]


def test_codes_past_the_width_are_an_error(spark):
    import pytest

    from newsquant.operators import encode, nearest

    lay = encode.layout()
    row = {r.name: (r.size + 1 if r.name == "code_full" else 1) for r, _ in lay.categories} | {r.name: 0.0 for r, _ in lay.numerics}
    df = spark.createDataFrame([row])
    with pytest.raises(Exception, match="code past"):
        df.select(*nearest._expanded_inputs(lay)).collect()


def test_several_models_take_one_pass(spark):
    from newsquant.operators import encode, nearest

    lay = encode.layout()
    stats = spark.createDataFrame([(i, 0.0, 1.0) for i in range(lay.width)], "slot int, mean double, std double")
    rows = [{r.name: 1 + i for r, _ in lay.categories} | {r.name: float(i) for r, _ in lay.numerics} for i in range(4)]
    df = spark.createDataFrame(rows)
    centre = [[float((j * 7 + i) % 3) for j in range(lay.width)] for i in range(3)]
    models = {k: (stats, spark.createDataFrame([(i, centre[i]) for i in range(k)], "cluster_id int, centroid array<double>")) for k in (1, 2, 3)}
    out = nearest.assign_models(df, lay, models)
    assert plan(out).split("== Physical Plan ==")[1].count("ArrowEvalPython [") == 1
    one = {k: sorted(map(tuple, nearest.assign_expanded(df, lay, *models[k]).drop("dist").collect())) for k in models}
    got = {k: sorted(map(tuple, out.filter(F.col("k") == k).drop("k").collect())) for k in models}
    assert got == one


def test_discarded_copies_are_gone(spark):
    import os

    from newsquant.session import cut_lineage, discard, shared_folder

    copy = cut_lineage(spark.range(5))
    place = copy.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert copy.count() == 5 and os.path.isdir(place) and place.startswith(shared_folder(spark))
    discard(copy, spark.range(3))
    assert not os.path.exists(place)
