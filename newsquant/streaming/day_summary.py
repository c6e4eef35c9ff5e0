"""Day summary kept up to date while event files arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from newsquant.functions.events import parse_day
from newsquant.operators.encode import Layout
from newsquant.operators.nearest import assign_models, freeze
from newsquant.operators.summary import summarise_cells
from newsquant.schema import EVENT_SCHEMA, IMPORTANCE
from newsquant.sources.events import DAY_FILE


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New event files of a folder as a stream, with `pub_day` from the file name."""
    raw = (
        spark.readStream.schema(EVENT_SCHEMA).option("sep", "\t").option("quote", '"').option("escape", '"')
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )
    df = raw.withColumn("pub_day", parse_day(F.regexp_extract("_metadata.file_name", DAY_FILE, 1)))
    return df.filter(F.col("pub_day").isNotNull())


def stream_day_cells(assigned: DataFrame, day: str = "pub_day", delay: str = "2 days",
                     measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Sums and counts per (day, cluster) over one-day windows with a watermark.

    Rows later than `delay` behind the newest day are dropped. The state holds
    one row per open day and cluster. `finish_days` turns the finished cells
    into the batch day summary.
    """
    at = F.col(day).cast("timestamp")
    sums = [F.sum(F.col(m).cast("double")).alias(m) for m in measures]
    return (
        assigned.withColumn("_at", at).withWatermark("_at", delay)
        .groupBy(F.window("_at", "1 day"), "cluster_id").agg(*sums, F.count("*").alias("events"))
        .select(F.col("window.start").cast("date").alias(day), "cluster_id", *measures, "events")
    )


def finish_days(cells: DataFrame, k: int, day: str = "pub_day", measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Day summary from finished `(day, cluster)` cells; same rows as the batch operator."""
    return summarise_cells(cells, k, day=day, measures=measures)


def load_models(spark: SparkSession, models: str) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Slot statistics and centroids by K, as the training stage saved them."""
    stats = freeze(spark.read.parquet(f"{models}/stats"))
    centroids = freeze(spark.read.parquet(f"{models}/centroids"))
    ks = sorted(r["k"] for r in centroids.select("k").distinct().collect())
    return {k: (stats, centroids.filter(F.col("k") == k).select("cluster_id", "centroid")) for k in ks}


def _landed(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def closed_day(spark: SparkSession, out: str, delay_days: int, before: int | None = None):
    """Days before this one are closed: the newest day of the batches so far (before a batch id) less the delay; None at the start."""
    cells = _landed(spark, f"{out}/cells")
    if cells is None:
        return None
    if before is not None:
        cells = cells.filter(F.col("batch") < before)
    return cells.agg(F.date_sub(F.max("day"), delay_days)).first()[0]


def summarise_stream(events: DataFrame, models: Callable[[], dict[int, tuple[DataFrame, DataFrame]]] | str, out: str, lay: Layout,
                     clean: Callable[[DataFrame], DataFrame] = lambda df: df, day: str = "pub_day", delay_days: int = 2,
                     measures: Sequence[str] = tuple(IMPORTANCE)) -> DataStreamWriter:
    """A stream of events to sums per (K, day, cluster) under `out`, and to counts of rows that came too late.

    Every batch loads the models anew, so a model that is trained meanwhile
    counts from the next batch on. A row is late if its day was closed when the
    batch began. A batch writes one folder under its number and overwrites it
    when it runs again, so each row counts once whatever is lost; what is open
    lies in those folders, not in executors. Set checkpoint and trigger on the
    writer and start it.
    """
    spark = events.sparkSession
    load = models if callable(models) else lambda: load_models(spark, models)

    def batch(df: DataFrame, number: int) -> None:
        closed = closed_day(df.sparkSession, out, delay_days, number)
        rows = clean(df)
        if closed is not None:  # otherwise no row is late and they are read once
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        late = F.lit(False) if closed is None else F.col(day) < F.lit(closed)
        assigned = assign_models(rows.filter(~late), lay, load())
        sums = [F.sum(F.col(m).cast("double")).alias(m) for m in measures]
        cells = assigned.groupBy("k", F.col(day).alias("day"), "cluster_id").agg(*sums, F.count("*").alias("events"))
        cells.write.mode("overwrite").parquet(f"{out}/cells/batch={number}")
        missed = rows.filter(late).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows"))
        missed.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        if closed is not None:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch)


def streamed_summary(spark: SparkSession, out: str, delay_days: int | None = 2, measures: Sequence[str] = tuple(IMPORTANCE)) -> DataFrame:
    """Day summaries `(k, day, ...)` from the cells of all batches; closed days only, or all of them for None."""
    cells = spark.read.parquet(f"{out}/cells")
    if delay_days is not None:
        cells = cells.filter(F.col("day") < F.lit(closed_day(spark, out, delay_days)))
    sums = [F.sum(m).alias(m) for m in [*measures, "events"]]
    return summarise_cells(cells.groupBy("k", "day", "cluster_id").agg(*sums), "k", day="day", measures=measures)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came after their day was closed: `(batch, day, rows)`."""
    return spark.read.parquet(f"{out}/late").select("batch", "day", "rows")
