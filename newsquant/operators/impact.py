"""Signed daily impact of events by country and actor type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions import events as fn

TYPES1 = ["actor1_type1", "actor1_type2", "actor1_type3"]
TYPES2 = ["actor2_type1", "actor2_type2", "actor2_type3"]


def countries_filter(df: DataFrame, countries: Sequence[str], a: str = "actor1_country", b: str = "actor2_country") -> DataFrame:
    return df.filter(F.col(a).isin(*countries) | F.col(b).isin(*countries))


def day_averages(df: DataFrame, day: str = "sqldate",
                 columns: Sequence[str] = ("num_articles", "num_mentions", "num_sources")) -> DataFrame:
    """Daily means and the event count."""
    return df.groupBy(day).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns], F.count("*").alias("n"))


def type_vocab(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty codes over several columns."""
    codes = df.select(F.explode(fn.distinct_types(columns)).alias("code"))
    return codes.filter(F.col("code") != "").distinct()


def impact_cells(df: DataFrame, countries: Sequence[str], kind: str = "h3", types1: Sequence[str] = tuple(TYPES1),
                 types2: Sequence[str] = tuple(TYPES2), day: str = "sqldate") -> DataFrame:
    """Long form `(day, name, impact)` summed per day and column name.

    The impact is linear in 1 / day average, so scaled sums are aggregated
    first and divided by the day average afterwards. An event's articles are
    one more cell, without a name, so the day's mean comes from the same pass
    over the events; only the sums are windowed by day. Rows without a day are
    left out.
    """
    own = countries_filter(df.filter(F.col(day).isNotNull()), countries)
    h = fn.impact(kind, F.col("num_articles"), "goldstein", "avg_tone", "quad_class")

    def side(country: str, types: Sequence[str]):
        codes = fn.distinct_types(types)
        value = h / F.size(codes)
        rows = F.transform(codes, lambda t: F.struct(
            F.col(country).alias("country"), t.alias("code"), value.cast("double").alias("value")))
        return F.when(F.col(country).isin(*countries), rows).otherwise(F.filter(rows, lambda r: F.lit(False)))

    none = F.lit(None).cast("string")
    articles = F.array(F.struct(none.alias("country"), none.alias("code"), F.col("num_articles").cast("double").alias("value")))
    cells = own.select(day, F.explode(F.concat(side("actor1_country", types1), side("actor2_country", types2), articles)).alias("c"))
    name = F.when(F.col("c.country").isNotNull(), fn.impact_column_name("c.country", "c.code", "c.value"))
    sums = cells.groupBy(day, name.alias("name")).agg(F.sum("c.value").alias("value"), F.count("c.value").alias("n"))
    mean = F.max(F.when(F.col("name").isNull(), F.try_divide("value", "n"))).over(Window.partitionBy(day))  # a row per name and day
    return sums.withColumn("mean", mean).filter(F.col("name").isNotNull()).select(day, "name", F.try_divide("value", "mean").alias("impact"))


def impact_pivot(df: DataFrame, countries: Sequence[str], names: Sequence[str], kind: str = "h3",
                 day: str = "sqldate", **types) -> DataFrame:
    """One column per name, 0 where a day has no such impact; `impact_names` over `data_codes` covers all impact."""
    cells = impact_cells(df, countries, kind, day=day, **types)
    return cells.groupBy(day).pivot("name", list(names)).agg(F.sum("impact")).fillna(0.0)


def data_codes(df: DataFrame, columns: Sequence[str], max_codes: int = 4096) -> list[str]:
    """The type codes that occur in the data, sorted; more than `max_codes` raise, as each becomes several columns."""
    rows = type_vocab(df, columns).limit(max_codes + 1).collect()
    if len(rows) > max_codes:
        raise ValueError(f"more than {max_codes} type codes")
    return sorted(r["code"] for r in rows)


def impact_names(countries: Sequence[str], codes: Sequence[str]) -> list[str]:
    return [f"{c}_{t or 'empty'}_{s}" for c in countries for t in ["", *codes] for s in ("pos", "neg")]
