"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.session import shared_folder, ship_package

#: Word separators of the contracts: space and the ASCII controls from tab to carriage return.
BLANK = "[\\x20\\x09-\\x0D]+"

#: Bytes with A-Z lowered, for `bytes.translate`.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession) -> str:
    """The shared folder as Spark's file systems resolve it, in the form that `pyarrow.fs` opens in the workers."""
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    scheme, rest = uri.split(":", 1)
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def text_of(column: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words between blanks, in order."""
    return F.array_remove(F.split(text, BLANK), "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
