"""The streamed day summary equals the batch one, and late rows are dropped."""

from pyspark.sql import functions as F

from newsquant.operators import clean, summary
from newsquant.sources.events import read_events
from newsquant.streaming.day_summary import finish_days, stream_day_cells, stream_events
from tests.test_sources import FULL, event_line, write_day


def assign(df):
    typed = clean.add_derived(clean.drop_incomplete(clean.normalise_events(df)))
    return typed.withColumn("cluster_id", F.pmod(F.col("event_id").cast("int"), F.lit(3)))


def run(spark, assigned, out, checkpoint):
    cells = stream_day_cells(assigned)
    query = (cells.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination(120)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for day in ("20150101", "20150102", "20150103"):
        write_day(folder, day, [event_line(**{**FULL, "GlobalEventID": i, "NumMentions": i}) for i in range(1, 8)])
    # A much later day closes the windows before it.
    write_day(folder, "20150301", [event_line(**{**FULL, "GlobalEventID": 1})])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run(spark, assign(stream_events(spark, str(folder))), out, mark)
    streamed = finish_days(spark.read.parquet(out), 3)
    batch = summary.day_summary(assign(read_events(spark, str(folder), hi="2015-02-01")), 3)
    columns = sorted(batch.columns)
    key = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert key(streamed) == key(batch) and streamed.count() == 12

    # A file for a closed day arrives too late.
    write_day(folder, "20150102", [event_line(**{**FULL, "GlobalEventID": 99})])
    before = spark.read.parquet(out).count()
    run(spark, assign(stream_events(spark, str(folder))), out, mark)
    assert spark.read.parquet(out).filter("pub_day = '2015-01-02'").count() == 3
    assert spark.read.parquet(out).count() >= before


def test_model_inside_the_stream_and_late_rows(spark, tmp_path):
    from newsquant.operators import encode
    from newsquant.plans import stages
    from newsquant.streaming import day_summary as ds

    folder, cleaned, models, out = (str(tmp_path / n) for n in ("in", "cleaned", "models", "out"))
    (tmp_path / "in").mkdir()

    def lines(n, first=0):
        return [event_line(**{**FULL, "GlobalEventID": first + i, "EventCode": f"0{1 + i % 5}", "EventRootCode": 1 + i % 5,
                              "ActionGeo_Lat": i % 5 * 10.0, "NumMentions": i}) for i in range(n)]

    for day in ("20150101", "20150102", "20150110"):
        write_day(tmp_path / "in", day, lines(20))
    stages.prepare(spark, folder, cleaned)
    stages.train(spark, cleaned, models, [2, 3], per_day=20)

    def drain():
        writer = ds.summarise_stream(stream_events(spark, folder, 2), models, out, encode.layout(), stages.cleaner(spark, cleaned), delay_days=4)
        writer.option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(200)

    drain()
    stages.summarise(spark, cleaned, models, str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch")).withColumnRenamed("pub_day", "day")
    columns = sorted(batch.columns)

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect())

    assert rows(ds.streamed_summary(spark, out, None)) == rows(batch)
    assert {str(r.day) for r in ds.streamed_summary(spark, out, 4).select("day").distinct().collect()} == {"2015-01-01", "2015-01-02"}
    assert ds.late_rows(spark, out).count() == 0

    # a file for a closed day is counted and left out, one for an open day is added
    write_day(tmp_path / "in", "20150103", lines(7, 100))
    write_day(tmp_path / "in", "20150107", lines(5, 200))
    drain()
    assert [(str(r.day), r.rows) for r in ds.late_rows(spark, out).collect()] == [("2015-01-03", 7)]
    assert {str(r.day): r.n for r in ds.streamed_summary(spark, out, None).collect()} == {
        "2015-01-01": 20, "2015-01-02": 20, "2015-01-07": 5, "2015-01-10": 20}

    # a batch that runs again counts once, and a model of another K counts from its next batch on
    before = rows(ds.streamed_summary(spark, out, None))
    number = max(r.batch for r in spark.read.parquet(f"{out}/cells").select("batch").distinct().collect())
    frame = spark.read.parquet(f"{out}/cells").filter(F.col("batch") == number).drop("batch").cache()
    assert frame.count() > 0
    frame.write.mode("overwrite").parquet(f"{out}/cells/batch={number}")
    assert rows(ds.streamed_summary(spark, out, None)) == before
    stages.train(spark, cleaned, str(tmp_path / "models"), [4], per_day=20)
    write_day(tmp_path / "in", "20150111", lines(6, 300))
    drain()
    assert {r.k for r in ds.streamed_summary(spark, out, None).filter("day = '2015-01-11'").collect()} == {2, 3, 4}
