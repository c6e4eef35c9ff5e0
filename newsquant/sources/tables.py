"""The shared parquet tables, and the event and price views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column of the event view -> (tables it needs besides lineitem, expression)
_NEWS: dict[str, tuple[set[str], str]] = {
    "event_id": (set(), "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int))"),
    "order_no": (set(), "l_orderkey"),
    "sqldate": ({"orders"}, "cast(o_orderdate as date)"),
    "pub_day": (set(), "cast(l_shipdate as date)"),
    "quad_class": (set(), "cast(1 + case when l_linestatus = 'F' then 0 else 2 end + l_orderkey % 2 as int)"),
    "goldstein": (set(), "round(l_discount * 200 - 10, 2)"),
    "num_mentions": (set(), "cast(l_quantity as int)"),
    "num_sources": (set(), "cast(1 + l_suppkey % 5 as int)"),
    "num_articles": (set(), "l_linenumber"),
    "is_root": (set(), "cast(l_linenumber = 1 as int)"),
    "avg_tone": (set(), "round(l_tax * 1000 - 40, 2)"),
    "event_root_code": (set(), "case when l_partkey % 50 = 0 then null else cast(1 + l_partkey % 20 as int) end"),
    "event_code": ({"part"}, "p_brand"),
    "actor1_country": ({"supplier"}, "concat('N', cast(s_nationkey as string))"),
    "actor2_country": ({"orders", "customer"}, "concat('N', cast(c_nationkey as string))"),
    "actor1_name": ({"part", "supplier"}, "concat(' The ', p_name, ' of ', s_name)"),
    "actor2_name": ({"orders", "customer"}, "c_name"),
    "actor1_type1": ({"part"}, "p_type"),
    "actor1_type2": ({"orders"}, "case when l_returnflag = 'R' then '' else o_orderpriority end"),
    "actor1_type3": ({"part"}, "case when p_size % 2 = 0 then p_type else '' end"),
    "actor2_type1": ({"orders", "customer"}, "case when l_returnflag = 'A' then '' else c_mktsegment end"),
    "actor1_geo_type": ({"part"}, "nullif(p_size % 6, 0)"),
    "actor2_geo_type": ({"orders", "customer"}, "nullif(c_nationkey % 6, 0)"),
    "action_geo_type": ({"supplier"}, "nullif(s_nationkey % 6, 0)"),
    "action_lat": ({"supplier"}, "case when l_partkey % 97 = 0 then null else s_acctbal / 100 end"),
    "action_long": ({"orders", "customer"}, "case when l_partkey % 97 = 0 then null else c_acctbal / 100 end"),
}
NEWS_COLUMNS = [*_NEWS, "page_id"]


# Declared schemas: a read starts no schema-inference job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over all cores if the scan has fewer splits than half the cores.

    Only small inputs are touched: a scan with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores // 2 else df


def news(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """News events built from the order tables; all columns unless some are named.

    The foreign keys of lineitem and orders are declared complete and the
    dimension keys unique, so a table is joined only if a requested column
    reads it. Customers are joined to the orders first, so the much larger
    lineitem is shuffled for the orders only. No side is hinted: Spark broadcasts a dimension only when its
    measured size allows and otherwise shuffles it, with adaptive skew splits.
    """
    wanted = list(columns) or NEWS_COLUMNS
    needs = set().union(*[_NEWS[c][0] for c in wanted if c != "page_id"])
    df = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    if "supplier" in needs:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "orders" in needs:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needs:
            orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needs:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = [F.expr(_NEWS[c][1]).alias(c) for c in wanted if c != "page_id"]
    if "page_id" in wanted:
        n_pages = table(spark, sf_dir, "pages").agg(F.count("*").alias("n")).scalar()
        out.append((F.col("l_partkey") % n_pages).alias("page_id"))
    return df.select(*out)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per market segment: `(symbol, day, price)`, whole cents.

    One row per symbol and calendar day, so every later window over a symbol
    is bounded by the length of the calendar, however large the orders are.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.sum(cents).alias("total"), F.count("*").alias("n"))
        .select("symbol", "day", (F.expr("total div n") / 100.0).alias("price"))
    )


def forecasts(price_frame: DataFrame) -> DataFrame:
    """Deterministic stand-in forecasts: mean and half interval per price row."""
    x = F.floor("price")
    return price_frame.select(
        "symbol", "day",
        F.round(((x * 48271) % 2001 - 1000) / F.lit(50000.0), 6).alias("mean"),
        F.round(((x * 16807) % 900 + 100) / F.lit(25000.0), 6).alias("half"),
    )


# The same views as common table expressions for the SQL checks.
NEWS_SQL = """news AS (
SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS INT)) AS event_id,
  l.l_orderkey AS order_no,
  CAST(o.o_orderdate AS DATE) AS sqldate, CAST(l.l_shipdate AS DATE) AS pub_day,
  CAST(1 + CASE WHEN l.l_linestatus = 'F' THEN 0 ELSE 2 END + l.l_orderkey % 2 AS INT) AS quad_class,
  ROUND(l.l_discount * 200 - 10, 2) AS goldstein,
  CAST(l.l_quantity AS INT) AS num_mentions,
  CAST(1 + l.l_suppkey % 5 AS INT) AS num_sources,
  l.l_linenumber AS num_articles,
  CAST(l.l_linenumber = 1 AS INT) AS is_root,
  ROUND(l.l_tax * 1000 - 40, 2) AS avg_tone,
  CASE WHEN l.l_partkey % 50 = 0 THEN NULL ELSE CAST(1 + l.l_partkey % 20 AS INT) END AS event_root_code,
  p.p_brand AS event_code,
  CONCAT('N', CAST(s.s_nationkey AS VARCHAR)) AS actor1_country,
  CONCAT('N', CAST(c.c_nationkey AS VARCHAR)) AS actor2_country,
  CONCAT(' The ', p.p_name, ' of ', s.s_name) AS actor1_name,
  c.c_name AS actor2_name,
  p.p_type AS actor1_type1,
  CASE WHEN l.l_returnflag = 'R' THEN '' ELSE o.o_orderpriority END AS actor1_type2,
  CASE WHEN p.p_size % 2 = 0 THEN p.p_type ELSE '' END AS actor1_type3,
  CASE WHEN l.l_returnflag = 'A' THEN '' ELSE c.c_mktsegment END AS actor2_type1,
  NULLIF(p.p_size % 6, 0) AS actor1_geo_type,
  NULLIF(c.c_nationkey % 6, 0) AS actor2_geo_type,
  NULLIF(s.s_nationkey % 6, 0) AS action_geo_type,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE s.s_acctbal / 100 END AS action_lat,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE c.c_acctbal / 100 END AS action_long,
  l.l_partkey % (SELECT COUNT(*) FROM pages) AS page_id
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey)"""

PRICES_SQL = """prices AS (
SELECT c.c_mktsegment AS symbol, CAST(o.o_orderdate AS DATE) AS day,
  CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) // COUNT(*) / 100.0::DOUBLE AS price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2)"""

FORECASTS_SQL = """forecasts AS (
SELECT symbol, day,
  ROUND(((x * 48271) % 2001 - 1000) / 50000.0::DOUBLE, 6) AS mean,
  ROUND(((x * 16807) % 900 + 100) / 25000.0::DOUBLE, 6) AS half
FROM (SELECT symbol, day, CAST(FLOOR(price) AS BIGINT) AS x FROM prices) q)"""
