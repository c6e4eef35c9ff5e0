"""Price and forecast files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.functions.events import parse_mixed_date

_FIELDS = ["open", "high", "low", "close", "volume", "adjusted", "mid price", "value"]


_WIDTH = 8


def read_prices(spark: SparkSession, paths: dict[str, str] | str, registry: dict[str, tuple[str, bool]] | None = None,
                sep: str = " ") -> DataFrame:
    """Price files as one long table `(symbol, day, field, value, log_return)`.

    `paths` is a glob, whose file names without extension are the symbols, or
    maps symbols to files of different names. All files are one scan: each
    file's header row, joined back by file, decides its fields: single column,
    OHLCV (`SYM.Open` ...) or `Mid Price`. With a registry only the registered
    column of each registered symbol is kept and named `price`.
    """
    columns = [f"c{i}" for i in range(_WIDTH)]
    files = list(paths.values()) if isinstance(paths, dict) else paths
    raw = spark.read.schema(", ".join(f"{c} STRING" for c in columns)).option("sep", sep).option("quote", '"').csv(files)
    raw = raw.select(*columns, F.col("_metadata.file_name").alias("file"))
    header = parse_mixed_date("c0").isNull() & F.expr("try_cast(c1 AS DOUBLE)").isNull() & F.col("c1").isNotNull()
    names = raw.filter(header).groupBy("file").agg(F.first(F.array(*columns[1:])).alias("names"))
    cells = F.explode(F.arrays_zip(F.col("names").alias("name"), F.array(*columns[1:]).alias("raw")))
    rows = raw.filter(~header).join(names, "file").select("file", parse_mixed_date("c0").alias("day"), cells.alias("p"))
    rows = rows.filter("p.name is not null")
    if isinstance(paths, dict):
        own = {p.rstrip("/").rsplit("/", 1)[-1]: s for s, p in paths.items()}
        if len(own) < len(paths):
            raise ValueError("two price files share a name")
        rows = rows.join(spark.createDataFrame(list(own.items()), "file string, symbol string"), "file")
    else:
        rows = rows.withColumn("symbol", F.regexp_extract("file", r"^(.*?)(\.[A-Za-z0-9]+)?$", 1))
    value = F.expr("try_cast(p.raw AS DOUBLE)").alias("value")
    if registry is None:
        tail = F.lower(F.element_at(F.split("p.name", "\\."), -1))
        field = F.when(tail.isin(_FIELDS), F.replace(tail, F.lit(" "), F.lit("_"))).otherwise("price")
        return rows.select("symbol", "day", field.alias("field"), value, F.lit(False).alias("log_return"))
    wanted = spark.createDataFrame([(s, c, r) for s, (c, r) in registry.items()], "symbol string, name string, log_return boolean")
    chosen = rows.join(wanted, (rows["symbol"] == wanted["symbol"]) & (F.col("p.name") == wanted["name"]))
    return chosen.select(rows["symbol"], "day", F.lit("price").alias("field"), value, "log_return")


def pivot_fields(long_prices: DataFrame, fields: list[str]) -> DataFrame:
    """One row per (symbol, day) with a column per price field."""
    return long_prices.groupBy("symbol", "day").pivot("field", fields).agg(F.first("value", ignorenulls=True))


def read_forecasts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Forecast file: header skipped, row number dropped, `day` plus doubles `names`."""
    raw = spark.read.option("header", True).option("quote", '"').csv(path)
    columns = raw.columns[1:]
    out = [parse_mixed_date(f"`{columns[0]}`").alias("day")]
    for source, name in zip(columns[1:], names, strict=True):
        out.append(F.expr(f"try_cast(`{source}` AS DOUBLE)").alias(name))
    return raw.select(*out)
