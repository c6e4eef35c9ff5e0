"""Cleaning of raw events: filters, code lookups, names, row accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsquant.functions import events as fn
from newsquant.schema import EVENT_ROLES, NAMES, TOP_EXPORTERS

REQUIRED = [
    "sqldate", "quad_class", "goldstein", "num_mentions", "num_sources", "num_articles",
    "avg_tone", "action_lat", "action_long",
]
MAX_CODES = 65_536


def normalise_events(raw: DataFrame) -> DataFrame:
    """Typed columns from the 58 text columns; bad cells become NULL."""
    def num(c, kind):
        return F.expr(f"try_cast({c} AS {kind})")

    return raw.select(
        F.col("GlobalEventID").alias("event_id"), fn.parse_day("SQLDATE").alias("sqldate"), "pub_day",
        num("QuadClass", "INT").alias("quad_class"), num("GoldsteinScale", "DOUBLE").alias("goldstein"),
        num("NumMentions", "INT").alias("num_mentions"), num("NumSources", "INT").alias("num_sources"),
        num("NumArticles", "INT").alias("num_articles"), num("AvgTone", "DOUBLE").alias("avg_tone"),
        num("EventRootCode", "INT").alias("event_root_code"), F.col("EventCode").alias("event_code"),
        F.col("Actor1CountryCode").alias("actor1_country"), F.col("Actor2CountryCode").alias("actor2_country"),
        F.col("Actor1Name").alias("actor1_name"), F.col("Actor2Name").alias("actor2_name"),
        F.col("Actor1Type1Code").alias("actor1_type1"), F.col("Actor1Type2Code").alias("actor1_type2"),
        F.col("Actor1Type3Code").alias("actor1_type3"), F.col("Actor2Type1Code").alias("actor2_type1"),
        F.col("Actor2Type2Code").alias("actor2_type2"), F.col("Actor2Type3Code").alias("actor2_type3"),
        num("Actor1Geo_Type", "INT").alias("actor1_geo_type"), num("Actor2Geo_Type", "INT").alias("actor2_geo_type"),
        num("ActionGeo_Type", "INT").alias("action_geo_type"), num("ActionGeo_Lat", "DOUBLE").alias("action_lat"),
        num("ActionGeo_Long", "DOUBLE").alias("action_long"), num("IsRootEvent", "INT").alias("is_root"),
        F.col("Actor1Geo_FullName").alias("actor1_geo"), F.col("Actor2Geo_FullName").alias("actor2_geo"),
        F.col("URL").alias("url"),
    )


def is_complete(columns: Sequence[str] = REQUIRED) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def drop_incomplete(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    return df.filter(is_complete(columns))


def drop_report(df: DataFrame, keep: Column) -> DataFrame:
    """One row: total, kept, dropped."""
    kept = F.count_if(F.coalesce(keep, F.lit(False)))
    return df.agg(F.count("*").alias("total"), kept.alias("kept")).withColumn("dropped", F.col("total") - F.col("kept"))


def with_counts(df: DataFrame, keep: Column, name: str = "rows"):
    """Filter by `keep` and count on the way: `(frame, observation)`; works for streams too."""
    from pyspark.sql import Observation

    seen = Observation(name)
    flag = F.coalesce(keep, F.lit(False))
    out = df.observe(seen, F.count("*").alias("total"), F.count_if(flag).alias("kept")).filter(flag)
    return out, seen


def vocab(df: DataFrame, column: str, max_codes: int = MAX_CODES) -> DataFrame:
    """Dictionary of a category: `(code, idx)`, 1-based in code order.

    A dictionary feeds one-hot slots, so it is small by design; more than
    `max_codes` codes raise an error, which keeps the single-task numbering
    and any broadcast of the dictionary bounded.
    """
    codes = df.select(F.col(column).cast("string").alias("code")).filter(F.col("code") != "").distinct()
    idx = F.row_number().over(Window.orderBy("code"))
    message = F.concat(F.lit(f"{column}: more than {max_codes} codes"))
    return codes.select("code", F.when(idx <= max_codes, idx).otherwise(F.raise_error(message).cast("int")).alias("idx"))


def encode_lookup(df: DataFrame, column: str, codes: DataFrame, out: str | None = None,
                  default: int | None = None) -> DataFrame:
    """Replace a code by its index; unknown codes get `default` (NULL keeps them missing)."""
    out = out or f"{column}_idx"
    side = codes.select(F.col("code").alias("_code"), F.col("idx").alias(out))
    joined = df.join(side, df[column].cast("string") == F.col("_code"), "left").drop("_code")
    return joined.withColumn(out, F.coalesce(out, F.lit(default))) if default is not None else joined


def name_to_alpha3(df: DataFrame, column: str, countries: DataFrame, out: str = "alpha3") -> DataFrame:
    """Country name to alpha-3 code by a `(name, alpha3)` table, case-insensitive."""
    side = countries.select(F.upper("name").alias("_name"), F.col("alpha3").alias(out))
    return df.join(side, F.upper(df[column]) == F.col("_name"), "left").drop("_name")


def filter_exporters(df: DataFrame, symbol: str, exporters: dict[str, list[str]] = TOP_EXPORTERS,
                     a: str = "actor1_country", b: str = "actor2_country") -> DataFrame:
    """Events where either actor's country exports the commodity; `EVERYTHING` keeps all."""
    if symbol.upper() == "EVERYTHING":
        return df
    names = exporters[symbol.upper()]
    return df.filter(F.col(a).isin(names) | F.col(b).isin(names))


def exporter_counts(df: DataFrame, exporters: DataFrame, a: str = "actor1_country", b: str = "actor2_country",
                    id_col: str = "event_id") -> DataFrame:
    """Events per symbol where either actor is in the `(symbol, country)` table.

    Country pairs are counted first, so the registry join sees at most
    (countries)^2 rows; a pair that matches a symbol twice counts once.
    """
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("country", F.explode(F.array_distinct(F.array(a, b))))
    hit = pairs.join(exporters, "country").select("symbol", a, b, "n").distinct()
    return hit.groupBy("symbol").agg(F.sum("n").alias("n_events"))


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "days_since_published": fn.days_since_published("sqldate", "pub_day"),
        "is_verbal": fn.is_verbal("quad_class"),
        "is_cooperative": fn.is_cooperative("quad_class"),
    })


def clean_events(df: DataFrame, event_codes: DataFrame, country_codes: DataFrame, type_codes: DataFrame | None = None,
                 symbol: str = "EVERYTHING", exporters: dict[str, list[str]] = TOP_EXPORTERS,
                 keep: Sequence[str] = ("event_id", "pub_day")) -> DataFrame:
    """The cleaned event: 7 importance, 10 topic and 2 name columns (plus ids).

    Filters run before the lookups. With `type_codes` the actors' first type
    codes are added as optional indices.
    """
    df = add_derived(drop_incomplete(filter_exporters(df, symbol, exporters)))
    df = encode_lookup(df, "event_code", event_codes, "code_full")
    df = encode_lookup(df, "actor1_country", country_codes, "country1")
    df = encode_lookup(df, "actor2_country", country_codes, "country2")
    extra = []
    if type_codes is not None:
        df = encode_lookup(df, "actor1_type1", type_codes, "type1", 0)
        df = encode_lookup(df, "actor2_type1", type_codes, "type2", 0)
        extra = ["type1", "type2"]
    df = df.withColumn("code1", F.col("event_root_code"))
    df = df.withColumns({c: fn.clean_name(c) for c in NAMES if c in df.columns})
    columns = [r.name for r in EVENT_ROLES if r.name in df.columns]
    return df.select(*[k for k in keep if k not in columns], *columns, *extra)


def export_zeros(df: DataFrame) -> DataFrame:
    """Missing categories as 0 for file exports; NULL stays the internal marker."""
    codes = [r.name for r in EVENT_ROLES if r.kind == "categorical" and r.name in df.columns]
    return df.fillna(0, subset=codes)


def mini_event(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Compact event for medoid clustering: id plus 14 fields; a `domain` that is there already is taken as it is."""
    url = "url" if "url" in df.columns else F.lit(None).cast("string")
    domain = F.col("domain") if "domain" in df.columns else fn.url_domain(url)
    return df.select(
        *keep, "event_id", fn.days_since_epoch("sqldate").alias("day_no"), "event_code",
        F.col("quad_class").cast("string").alias("quad_class"), "goldstein", "actor1_name", "actor2_name",
        "is_root", "num_mentions", "num_sources", "num_articles", "avg_tone", "actor1_geo", "actor2_geo",
        domain.alias("domain"),
    )


def attach_raw(assigned: DataFrame, raw: DataFrame, on: str | Sequence[str] = "event_id") -> DataFrame:
    """Bring raw columns back to clustered events by id."""
    return assigned.join(raw, on)


