"""Raw event files: scan, publication day, landing layout, day split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.functions.events import empty_fields, parse_day
from newsquant.schema import EVENT_SCHEMA

DAY_FILE = r"(\d{8})\.export\.CSV$"


def read_events(spark: SparkSession, path, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Tab-separated event files with `pub_day` taken from the file name.

    Files with another name are rejected. A 57-field line gets a NULL URL.
    `lo`/`hi` (ISO dates) bound the publication day, both inclusive; the test
    uses only file metadata, so Spark skips the other files.
    """
    raw = (
        spark.read.schema(EVENT_SCHEMA)
        .option("sep", "\t").option("quote", '"').option("escape", '"')
        .csv(path)
    )
    df = raw.withColumn("pub_day", parse_day(F.regexp_extract("_metadata.file_name", DAY_FILE, 1)))
    return day_range(df.filter(F.col("pub_day").isNotNull()), lo, hi)


def day_range(df: DataFrame, lo: str | None = None, hi: str | None = None, day: str = "pub_day") -> DataFrame:
    """Rows whose day lies in `[lo, hi]`."""
    if lo is not None:
        df = df.filter(F.col(day) >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.filter(F.col(day) <= F.lit(hi).cast("date"))
    return df


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Row bind by column name; columns missing on one side become NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_stage(df: DataFrame, path: str, by: tuple[str, ...] = ("pub_day",), mode: str = "overwrite") -> None:
    """Parquet partitioned by day (and K for summaries); only the partitions written now are replaced.

    Each day is spread over as many tasks as its rows need: the extra
    shuffle-free write keeps the input's partitions, so a hot day never
    ends up in one task.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only `columns` of a landed stage (column pruning replaces slicing)."""
    return spark.read.parquet(path).select(*columns)


def split_by_day(df: DataFrame, min_events: int = 100, day: str = "sqldate") -> DataFrame:
    """Rows of the days that have at least `min_events` events.

    The day counts are small, so they are aggregated first and joined back;
    a day window would pull a hot day into one task.
    """
    big = df.groupBy(day).count().filter(F.col("count") >= min_events).select(day)
    return df.join(big, day, "left_semi")


def day_counts(df: DataFrame, min_events: int = 1, day: str = "pub_day") -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("n")).filter(F.col("n") >= min_events)


def infer_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per token: `<c>_num` if it reads as a number, else `<c>_text`."""
    out = df
    for c in columns:
        number = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out = out.withColumn(f"{c}_num", number).withColumn(f"{c}_text", F.when(number.isNull(), F.col(c)))
    return out


def valid_rows(df: DataFrame, key: str, columns: list[str], min_fields: int = 57) -> DataFrame:
    """Rows with enough fields present and a non-empty actor key."""
    present: Column = F.lit(len(columns)) - empty_fields(columns)
    return df.filter((F.coalesce(F.col(key), F.lit("")) != "") & (present >= min(min_fields, len(columns))))


def parse_typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns; `bad_cells` counts the cells that do not parse."""
    out, bad = df, F.lit(0)
    for c, kind in types.items():
        typed = F.expr(f"try_cast(`{c}` AS {kind})")
        bad = bad + (F.col(c).isNotNull() & typed.isNull()).cast("int")
    out = out.withColumn("bad_cells", bad)
    for c, kind in types.items():
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS {kind})"))
    return out
