"""Result sinks and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, metric: str = "valid_r2") -> None:
    """Blank-separated text sorted by `metric` descending; `|` is the quote character."""
    (
        df.orderBy(F.desc_nulls_last(metric))
        .write.mode("overwrite").option("sep", " ").option("quote", "|").option("header", True).csv(path)
    )


def parse_run_logs(spark: SparkSession, path) -> DataFrame:
    """One row per log file: K, train error and test error found by their labels."""
    logs = spark.read.text(path, wholetext=True)
    number = r"\s*[:=]?\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)"

    def field(label: str, kind: str):
        text = F.regexp_extract("value", label + number, 1)
        return F.when(text != "", text).try_cast(kind)

    return logs.select(
        field(r"(?i)\bk\b", "int").alias("k"),
        field(r"(?i)train[a-z ]*error", "double").alias("train_error"),
        field(r"(?i)test[a-z ]*error", "double").alias("test_error"),
    )


def parse_run_lines(spark: SparkSession, path, k_token: tuple[int, int], train_token: tuple[int, int],
                    test_token: tuple[int, int]) -> DataFrame:
    """Like `parse_run_logs`, by (line, token) position; negative counts from the end."""
    lines = F.split(F.trim(F.col("value")), r"\n")

    def token(at: tuple[int, int], kind: str):
        line = F.try_element_at(lines, F.lit(at[0] + 1 if at[0] >= 0 else at[0]))
        words = F.split(F.trim(line), r"\s+")
        return F.try_element_at(words, F.lit(at[1] + 1 if at[1] >= 0 else at[1])).try_cast(kind)

    return spark.read.text(path, wholetext=True).select(
        token(k_token, "int").alias("k"),
        token(train_token, "double").alias("train_error"),
        token(test_token, "double").alias("test_error"),
    )
