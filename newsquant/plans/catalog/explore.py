"""Queries on actor sparsity, distributions and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsquant.operators import explore as ex
from newsquant.operators import impact
from newsquant.plans.catalog.registry import query
from newsquant.sources import tables

A, B = "actor1_name", "actor2_name"

PAIRS_SQL = """
pairs AS (SELECT actor1_name AS a, actor2_name AS b, COUNT(*) AS n FROM news
          WHERE COALESCE(actor1_name, '') <> '' AND COALESCE(actor2_name, '') <> '' GROUP BY 1, 2),
partners AS (SELECT '1to2' AS direction, a AS actor, COUNT(*) AS n_co_actors FROM pairs GROUP BY 2
             UNION ALL SELECT '2to1', b, COUNT(*) FROM pairs GROUP BY 2),
per_actor AS (SELECT '1to2' AS direction, a AS actor, CAST(SUM(n) AS BIGINT) AS n_events FROM pairs GROUP BY 2
              UNION ALL SELECT '2to1', b, CAST(SUM(n) AS BIGINT) FROM pairs GROUP BY 2)"""


def _actors(spark, sf_dir, *more):
    return tables.news(spark, sf_dir, A, B, *more)


def _per_actor(spark, sf_dir):
    return ex.events_per_actor(_actors(spark, sf_dir), A, B)


@query("co_actors", "news", PAIRS_SQL, "SELECT * FROM partners")
def co_actors(spark, sf_dir):
    return ex.co_actors(_actors(spark, sf_dir), A, B)


@query("events_per_actor", "news", PAIRS_SQL, "SELECT * FROM per_actor")
def events_per_actor(spark, sf_dir):
    return _per_actor(spark, sf_dir)


@query("days_per_actor", "news", "", """
SELECT '1to2' AS direction, actor1_name AS actor, COUNT(DISTINCT sqldate) AS n_events FROM news WHERE actor1_name <> '' GROUP BY 2
UNION ALL SELECT '2to1', actor2_name, COUNT(DISTINCT sqldate) FROM news WHERE actor2_name <> '' GROUP BY 2""")
def days_per_actor(spark, sf_dir):
    return ex.events_per_actor(_actors(spark, sf_dir, "sqldate"), A, B, distinct="sqldate")


def _five_sql(source: str, column: str, by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    cells = ", ".join(
        f"ROUND(QUANTILE_CONT({column}, {q}), 6) AS {n}"
        for n, q in [("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)]
    )
    return f"SELECT {head}{cells} FROM {source}{tail}"


@query("five_number", "news", PAIRS_SQL, _five_sql("partners", "CAST(n_co_actors AS DOUBLE)", "direction"))
def five_number(spark, sf_dir):
    return ex.five_number(ex.co_actors(_actors(spark, sf_dir), A, B), "n_co_actors", ["direction"])


@query("five_number_events", "", "", _five_sql("lineitem", "l_extendedprice"))
def five_number_events(spark, sf_dir):
    """Quartiles of a nearly continuous column: the distributed rank at work."""
    df = ex.five_number(tables.table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("hazen_quartiles", "news", PAIRS_SQL, """
SELECT direction, ROUND(q1, 6) AS q1, ROUND(q2, 6) AS median, ROUND(q3, 6) AS q3 FROM (
  SELECT direction, v[CAST(FLOOR(a) AS INT) + 1] + (v[CAST(CEIL(a) AS INT) + 1] - v[CAST(FLOOR(a) AS INT) + 1]) * (a - FLOOR(a)) AS q1,
    v[CAST(FLOOR(b) AS INT) + 1] + (v[CAST(CEIL(b) AS INT) + 1] - v[CAST(FLOOR(b) AS INT) + 1]) * (b - FLOOR(b)) AS q2,
    v[CAST(FLOOR(c) AS INT) + 1] + (v[CAST(CEIL(c) AS INT) + 1] - v[CAST(FLOOR(c) AS INT) + 1]) * (c - FLOOR(c)) AS q3
  FROM (SELECT direction, list(n_events ORDER BY n_events) AS v, CAST(COUNT(*) * 0.25 - 0.5 AS DOUBLE) AS a, CAST(COUNT(*) * 0.5 - 0.5 AS DOUBLE) AS b,
    CAST(COUNT(*) * 0.75 - 0.5 AS DOUBLE) AS c FROM per_actor GROUP BY 1) q) r""")
def hazen_quartiles(spark, sf_dir):
    df = ex.five_number(_per_actor(spark, sf_dir), "n_events", ["direction"], "hazen")
    return df.select("direction", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("histogram", "news", "", """
SELECT quad_class, CAST(FLOOR((avg_tone + 40) / 2.5) AS BIGINT) AS bin, COUNT(*) AS n FROM news GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    return ex.histogram(tables.news(spark, sf_dir, "quad_class", "avg_tone"), "avg_tone", 2.5, -40.0, ["quad_class"])


@query("outliers", "news", PAIRS_SQL, """
SELECT p.* FROM per_actor p JOIN (SELECT direction, QUANTILE_CONT(CAST(n_events AS DOUBLE), 0.25) AS q1,
  QUANTILE_CONT(CAST(n_events AS DOUBLE), 0.75) AS q3 FROM per_actor GROUP BY 1) q USING (direction)
WHERE n_events < q1 - 1.5 * (q3 - q1) OR n_events > q3 + 1.5 * (q3 - q1)""")
def outliers(spark, sf_dir):
    return ex.box_outliers(_per_actor(spark, sf_dir), "n_events", ["direction"]).select("direction", "actor", "n_events")


@query("jaccard", "news", PAIRS_SQL + """,
rare1 AS (SELECT actor2_country AS actor, COUNT(*) // 40 AS n FROM news GROUP BY 1),
rare2 AS (SELECT actor1_country AS actor, COUNT(*) // 40 AS n FROM news GROUP BY 1)""", """
SELECT (SELECT COUNT(*) FROM (SELECT * FROM rare1 INTERSECT SELECT * FROM rare2) a) AS n_both,
  (SELECT COUNT(*) FROM (SELECT * FROM rare1 UNION SELECT * FROM rare2) b) AS n_any,
  (SELECT COUNT(*) FROM (SELECT * FROM rare1 INTERSECT SELECT * FROM rare2) a) /
  CAST((SELECT COUNT(*) FROM (SELECT * FROM rare1 UNION SELECT * FROM rare2) b) AS DOUBLE) AS jaccard""")
def jaccard(spark, sf_dir):
    df = tables.news(spark, sf_dir, "actor1_country", "actor2_country")

    def counts(c):
        return df.groupBy(F.col(c).alias("actor")).agg(F.expr("count(*) div 40").alias("n"))

    return ex.jaccard(counts("actor2_country"), counts("actor1_country"))


@query("jaccard_actors", "news", PAIRS_SQL + """,
rare1 AS (SELECT direction AS d, substr(actor, -3) AS actor, CAST(COUNT(*) AS BIGINT) AS n FROM per_actor GROUP BY 1, 2),
s1 AS (SELECT actor, n FROM rare1 WHERE d = '1to2'), s2 AS (SELECT actor, n FROM rare1 WHERE d = '2to1')""", """
SELECT (SELECT COUNT(*) FROM (SELECT * FROM s1 INTERSECT SELECT * FROM s2) a) AS n_both,
  (SELECT COUNT(*) FROM (SELECT * FROM s1 UNION SELECT * FROM s2) b) AS n_any,
  (SELECT COUNT(*) FROM (SELECT * FROM s1 INTERSECT SELECT * FROM s2) a) /
  CAST((SELECT COUNT(*) FROM (SELECT * FROM s1 UNION SELECT * FROM s2) b) AS DOUBLE) AS jaccard""")
def jaccard_actors(spark, sf_dir):
    """Overlap of the two directions' name endings with equal counts."""
    ends = _per_actor(spark, sf_dir).groupBy("direction", F.expr("right(actor, 3)").alias("actor")).agg(F.count("*").alias("n"))
    side = {d: ends.filter(F.col("direction") == d).select("actor", "n") for d in ("1to2", "2to1")}
    return ex.jaccard(side["1to2"], side["2to1"])


@query("bands", "news", PAIRS_SQL, """
SELECT 'rare' AS band, direction, COUNT(*) AS n FROM per_actor WHERE n_events < 10 GROUP BY 2
UNION ALL SELECT 'middle', direction, COUNT(*) FROM per_actor WHERE n_events >= 10 AND n_events < 400 GROUP BY 2""")
def bands(spark, sf_dir):
    per_actor = _per_actor(spark, sf_dir)
    rare = ex.freq_band(per_actor, "n_events", hi=10).withColumn("band", F.lit("rare"))
    middle = ex.freq_band(per_actor, "n_events", 10, 400).withColumn("band", F.lit("middle"))
    return rare.unionByName(middle).groupBy("band", "direction").agg(F.count("*").alias("n"))


@query("top_actors", "news", PAIRS_SQL, """
SELECT direction, actor, n_events FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY direction ORDER BY n_events DESC, actor) AS rn
  FROM per_actor) q WHERE rn <= 5""")
def top_actors(spark, sf_dir):
    return ex.top_k(_per_actor(spark, sf_dir), "n_events", 5, "actor", ["direction"])


@query("trim", "news", PAIRS_SQL, """
SELECT * FROM per_actor WHERE n_events < (SELECT QUANTILE_CONT(CAST(n_events AS DOUBLE), 0.95) FROM per_actor)""")
def trim(spark, sf_dir):
    return ex.trim_quantile(_per_actor(spark, sf_dir), "n_events", 0.95)


COUNTRIES = ["N0", "N1"]
TYPES1 = ["actor1_type1", "actor1_type2", "actor1_type3"]
TYPES2 = ["actor2_type1"]

IMPACT_SQL = """
own AS (SELECT *, num_articles / AVG(num_articles) OVER (PARTITION BY sqldate) AS a FROM news
        WHERE actor1_country IN ('N0', 'N1') OR actor2_country IN ('N0', 'N1')),
h AS (SELECT *, a * CASE quad_class WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -1 ELSE -2 END AS h3, a * goldstein AS h1,
        a * avg_tone AS h2 FROM own),
codes AS (SELECT sqldate, actor1_country AS country, h1, h2, h3,
            list_distinct(list_filter([actor1_type1, actor1_type2, actor1_type3], lambda x: x <> '')) AS l
          FROM h WHERE actor1_country IN ('N0', 'N1')
          UNION ALL SELECT sqldate, actor2_country, h1, h2, h3, list_distinct(list_filter([actor2_type1], lambda x: x <> ''))
          FROM h WHERE actor2_country IN ('N0', 'N1')),
parts AS (SELECT sqldate, country, UNNEST(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS code,
            h1 / GREATEST(len(l), 1) AS v1, h2 / GREATEST(len(l), 1) AS v2, h3 / GREATEST(len(l), 1) AS v3 FROM codes)"""


def _cells_sql(kind: int) -> str:
    return (f"SELECT sqldate, concat_ws('_', country, CASE WHEN code = '' THEN 'empty' ELSE code END, "
            f"CASE WHEN v{kind} > 0 THEN 'pos' ELSE 'neg' END) AS name, SUM(v{kind}) AS impact FROM parts GROUP BY 1, 2")


def _impact_input(spark, sf_dir):
    return tables.news(spark, sf_dir, "sqldate", "actor1_country", "actor2_country", "num_articles", "goldstein",
                       "avg_tone", "quad_class", *TYPES1, *TYPES2)


@query("impact_averages", "news", "", """
SELECT sqldate, ROUND(AVG(num_articles), 6) AS avg_num_articles, ROUND(AVG(num_mentions), 6) AS avg_num_mentions,
  ROUND(AVG(num_sources), 6) AS avg_num_sources, COUNT(*) AS n FROM news
WHERE actor1_country IN ('N0', 'N1') OR actor2_country IN ('N0', 'N1') GROUP BY 1""")
def impact_averages(spark, sf_dir):
    df = tables.news(spark, sf_dir, "sqldate", "actor1_country", "actor2_country", "num_articles", "num_mentions", "num_sources")
    out = impact.day_averages(impact.countries_filter(df, COUNTRIES))
    return out.select("sqldate", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("avg_")], "n")


def _impact_cells(kind):
    def run(spark, sf_dir):
        cells = impact.impact_cells(_impact_input(spark, sf_dir), COUNTRIES, kind, TYPES1, TYPES2)
        return cells.select("sqldate", "name", F.round("impact", 5).alias("impact"))
    return run


for _i in (1, 2, 3):
    query(f"impact_cells_h{_i}", "news", IMPACT_SQL,
          f"SELECT sqldate, name, ROUND(impact, 5) AS impact FROM ({_cells_sql(_i)}) q")(_impact_cells(f"h{_i}"))


# Type codes of the tables, for the check only: the query takes them from the data, so a code missing here is a failure.
CHECKED_CODES = [
    "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD",
    "MACHINERY", "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD",
]
_NAMES = impact.impact_names(COUNTRIES, CHECKED_CODES)


def impact_wide(spark, sf_dir):
    """Names of all (country, code, sign) columns and the pivot over them."""
    df = _impact_input(spark, sf_dir)
    names = impact.impact_names(COUNTRIES, impact.data_codes(df, [*TYPES1, *TYPES2]))
    return names, impact.impact_pivot(df, COUNTRIES, names, "h3", types1=TYPES1, types2=TYPES2)


@query("impact_pivot", "news", IMPACT_SQL + f",\ncells AS ({_cells_sql(3)})", "SELECT sqldate, " + ", ".join(
    f"ROUND(COALESCE(SUM(impact) FILTER (name = '{n}'), 0), 5) AS \"{n}\"" for n in _NAMES) + " FROM cells GROUP BY 1")
def impact_pivot(spark, sf_dir):
    names, wide = impact_wide(spark, sf_dir)
    return wide.select("sqldate", *[F.round(F.col(f"`{n}`"), 5).alias(n) for n in names])


@query("type_vocab", "news", "", """
SELECT DISTINCT code FROM (SELECT UNNEST([actor1_type1, actor1_type2, actor1_type3, actor2_type1]) AS code FROM news) q
WHERE code <> ''""")
def type_vocab(spark, sf_dir):
    return impact.type_vocab(tables.news(spark, sf_dir, *TYPES1, *TYPES2), [*TYPES1, *TYPES2])
