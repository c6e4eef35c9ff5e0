"""Queries on news events: cleaning, encoding, clustering core, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsquant.functions import events as fn
from newsquant.functions import hosts
from newsquant.operators import clean, clusters, encode, nearest, summary
from newsquant.plans import pipelines as pl
from newsquant.plans.catalog.registry import query
from newsquant.schema import STOP_WORDS
from newsquant.sources import events as ev
from newsquant.sources import keyed, tables

CLEAN_SQL = """
codes AS (SELECT code, CAST(row_number() OVER (ORDER BY code) AS INT) AS idx
          FROM (SELECT DISTINCT p_brand AS code FROM part) q),
countries AS (SELECT code, CAST(row_number() OVER (ORDER BY code) AS INT) AS idx
              FROM (SELECT DISTINCT CONCAT('N', CAST(n_nationkey AS VARCHAR)) AS code FROM nation) q),
cleaned AS (
SELECT n.*, CAST(n.sqldate - n.pub_day AS INT) AS days_since_published,
  CAST(quad_class IN (1, 3) AS INT) AS is_verbal, CAST(quad_class IN (1, 2) AS INT) AS is_cooperative,
  event_root_code AS code1, e.idx AS code_full, c1.idx AS country1, c2.idx AS country2
FROM news n LEFT JOIN codes e ON n.event_code = e.code
LEFT JOIN countries c1 ON n.actor1_country = c1.code
LEFT JOIN countries c2 ON n.actor2_country = c2.code
WHERE sqldate IS NOT NULL AND quad_class IS NOT NULL AND goldstein IS NOT NULL AND num_mentions IS NOT NULL
  AND num_sources IS NOT NULL AND num_articles IS NOT NULL AND avg_tone IS NOT NULL
  AND action_lat IS NOT NULL AND action_long IS NOT NULL)"""

_CATS = ["code1", "code_full", "country1", "country2", "actor1_geo_type", "actor2_geo_type", "action_geo_type"]
_NUMS = ["is_cooperative", "action_lat", "action_long"]


def seeds_sql(k: int, source: str, order: str = "order_no", key: str = "event_id") -> str:
    """K uniform seeds: smallest (order, id) at or after each target."""
    return f"""
span AS (SELECT MIN({order}) AS lo, GREATEST((MAX({order}) - MIN({order})) // {k}, 1) AS step FROM {source}),
strides AS (SELECT LEAST(({order} - lo) // step, {k} - 1) AS stride, MIN(ROW({order}, {key})) AS r
            FROM {source}, span GROUP BY 1),
seeds AS (SELECT CAST(t.i AS INT) AS i, MIN(s.r)[2] AS {key}
          FROM range(0, {k}) t(i) JOIN strides s ON s.stride >= t.i GROUP BY 1)"""


def _distance_sql() -> str:
    """Squared distance of two standardised one-hot events, from slot frequencies."""
    terms = []
    for c in _CATS:
        terms.append(
            f"CASE WHEN x.{c} IS NOT DISTINCT FROM y.{c} THEN 0 ELSE COALESCE(fx_{c}.w, 0) + COALESCE(fy_{c}.w, 0) END"
        )
    for c in _NUMS:
        terms.append(f"POWER((x.{c} - y.{c}) / (SELECT CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END FROM cleaned), 2)")
    return " + ".join(terms)


def _weights_sql() -> str:
    parts = []
    for c in _CATS:
        parts.append(
            f"w_{c} AS (SELECT {c} AS v, 1 / CASE WHEN p * (1 - p) > 1e-24 THEN p * (1 - p) ELSE 1 END AS w FROM "
            f"(SELECT {c}, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM cleaned) AS p FROM cleaned "
            f"WHERE {c} IS NOT NULL GROUP BY 1) q)"
        )
    return ",\n".join(parts)


def assigned_sql(k: int) -> str:
    joins = "\n".join(
        f"LEFT JOIN w_{c} fx_{c} ON fx_{c}.v = x.{c} LEFT JOIN w_{c} fy_{c} ON fy_{c}.v = y.{c}" for c in _CATS
    )
    return f"""{CLEAN_SQL},{seeds_sql(k, 'cleaned')},
{_weights_sql()},
centres AS (SELECT s.i, c.* FROM cleaned c JOIN seeds s USING (event_id)),
pairs AS (SELECT x.event_id, y.i, SQRT({_distance_sql()}) AS d FROM cleaned x CROSS JOIN centres y
{joins}),
nearest AS (SELECT event_id, MIN(ROW(ROUND(d * d, 9), i))[2] AS cluster_id, MIN(d) AS dist FROM pairs GROUP BY 1),
assigned AS (SELECT c.*, n.cluster_id, n.dist FROM cleaned c JOIN nearest n USING (event_id))"""


SUMMARY_SQL = """,
cells AS (SELECT pub_day, cluster_id, SUM(days_since_published) AS days_since_published, SUM(is_verbal) AS is_verbal,
  SUM(goldstein) AS goldstein, SUM(num_mentions) AS num_mentions, SUM(num_sources) AS num_sources,
  SUM(num_articles) AS num_articles, SUM(avg_tone) AS avg_tone, COUNT(*) AS events FROM assigned GROUP BY 1, 2),
totals AS (SELECT pub_day, SUM(events) AS n FROM cells GROUP BY 1),
frame AS (SELECT pub_day, n, CAST(i AS INT) AS cluster_id FROM totals CROSS JOIN range(0, {k}) t(i)),
blocks AS (SELECT f.pub_day, f.cluster_id, f.n, c.* EXCLUDE (pub_day, cluster_id) FROM frame f
           LEFT JOIN cells c ON c.pub_day = f.pub_day AND c.cluster_id = f.cluster_id
  UNION ALL SELECT pub_day, -1, SUM(events), SUM(days_since_published), SUM(is_verbal), SUM(goldstein),
    SUM(num_mentions), SUM(num_sources), SUM(num_articles), SUM(avg_tone), SUM(events) FROM cells GROUP BY 1),
summary AS (SELECT pub_day, cluster_id, COALESCE(days_since_published, 0) / CAST(n AS DOUBLE) AS days_since_published,
  COALESCE(is_verbal, 0) / CAST(n AS DOUBLE) AS is_verbal, COALESCE(goldstein, 0) / CAST(n AS DOUBLE) AS goldstein,
  COALESCE(num_mentions, 0) / CAST(n AS DOUBLE) AS num_mentions,
  COALESCE(num_sources, 0) / CAST(n AS DOUBLE) AS num_sources,
  COALESCE(num_articles, 0) / CAST(n AS DOUBLE) AS num_articles,
  COALESCE(avg_tone, 0) / CAST(n AS DOUBLE) AS avg_tone,
  COALESCE(events, 0) / CAST(n AS DOUBLE) AS share, CAST(n AS BIGINT) AS n FROM blocks)"""

MEASURES = ["days_since_published", "is_verbal", "goldstein", "num_mentions", "num_sources", "num_articles", "avg_tone"]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("clean_events", "news", CLEAN_SQL, """
SELECT event_id, days_since_published, is_verbal, is_cooperative, code1, code_full, country1, country2 FROM cleaned""")
def clean_events(spark, sf_dir):
    return pl.cleaned_news(spark, sf_dir).select(
        "event_id", "days_since_published", "is_verbal", "is_cooperative", "code1", "code_full", "country1", "country2"
    )


@query("nearest_centroid", "news", assigned_sql(pl.NEWS_K), """
SELECT event_id, cluster_id, ROUND(dist, 6) AS dist FROM assigned""")
def nearest_centroid(spark, sf_dir):
    return pl.assigned_news(spark, sf_dir).select("event_id", "cluster_id", F.round("dist", 6).alias("dist"))


@query("day_summary", "news", assigned_sql(pl.NEWS_K) + SUMMARY_SQL.format(k=pl.NEWS_K), f"""
SELECT pub_day, cluster_id, {', '.join(f'ROUND({m}, 8) AS {m}' for m in [*MEASURES, 'share'])}, n FROM summary""")
def day_summary(spark, sf_dir):
    return rounded(summary.day_summary(pl.assigned_news(spark, sf_dir), pl.NEWS_K), [*MEASURES, "share"], 8)


_WIDE = ", ".join(
    f"ROUND(MAX(CASE WHEN cluster_id = {i} THEN {m} END), 8) AS {m}_{'total' if i < 0 else i}"
    for i in [*range(pl.NEWS_K), -1] for m in ("share", "num_mentions")
)


@query("joined_features", "news prices", assigned_sql(pl.NEWS_K) + SUMMARY_SQL.format(k=pl.NEWS_K) + f""",
wide AS (SELECT pub_day AS day, {_WIDE} FROM summary GROUP BY 1),
moves AS (SELECT *, ROW_NUMBER() OVER w AS rn, AVG(price) OVER (w ROWS 4 PRECEDING) AS ma5,
  AVG(price) OVER (w ROWS 9 PRECEDING) AS ma10, AVG(price) OVER (w ROWS 29 PRECEDING) AS ma30,
  CAST(LEAD(price) OVER w > price AS INT) AS label FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY day))""", """
SELECT w.*, m.symbol, m.price, ROUND(m.ma5, 6) AS ma5, ROUND(m.ma10, 6) AS ma10, ROUND(m.ma30, 6) AS ma30, m.label
FROM wide w JOIN moves m USING (day) WHERE m.rn >= 30""")
def joined_features(spark, sf_dir):
    df = pl.joined_features(spark, sf_dir)
    df = rounded(df, ["ma5", "ma10", "ma30"])
    return rounded(df, [c for c in df.columns if c.startswith(("share_", "num_mentions_"))], 8)


@query("drop_report", "news", CLEAN_SQL, """
SELECT (SELECT COUNT(*) FROM news) AS total, (SELECT COUNT(*) FROM cleaned) AS kept,
  (SELECT COUNT(*) FROM news) - (SELECT COUNT(*) FROM cleaned) AS dropped""")
def drop_report(spark, sf_dir):
    return clean.drop_report(tables.news(spark, sf_dir, *clean.REQUIRED), clean.is_complete())


@query("exporter_filter", "news", """
exporters AS (SELECT * FROM (VALUES ('BUILDING', 0, 4), ('MACHINERY', 5, 9)) v(symbol, lo, hi)
  UNION ALL SELECT DISTINCT c_mktsegment, 0, 24 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
members AS (SELECT DISTINCT e.symbol, CONCAT('N', CAST(n_nationkey AS VARCHAR)) AS country
            FROM exporters e JOIN nation ON n_nationkey BETWEEN e.lo AND e.hi)""", """
SELECT s.symbol, COUNT(*) AS n_events FROM news n CROSS JOIN (SELECT DISTINCT symbol FROM members) s
WHERE EXISTS (SELECT 1 FROM members m WHERE m.symbol = s.symbol AND m.country IN (n.actor1_country, n.actor2_country))
GROUP BY 1""")
def exporter_filter(spark, sf_dir):
    nation = tables.table(spark, sf_dir, "nation")
    symbols = tables.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("symbol")).distinct()
    lo = F.when(F.col("symbol") == "MACHINERY", 5).otherwise(0)
    hi = F.when(F.col("symbol") == "BUILDING", 4).when(F.col("symbol") == "MACHINERY", 9).otherwise(24)
    keys = symbols.select("symbol", F.explode(F.sequence(lo, hi)).alias("n_nationkey"))
    registry = keys.join(nation, "n_nationkey").select(
        "symbol", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country")
    )
    return clean.exporter_counts(tables.news(spark, sf_dir, "actor1_country", "actor2_country"), registry)


_STOPS_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("clean_names", "news", "", f"""
SELECT event_id, array_to_string(list_filter(string_split_regex(trim(lower(actor1_name)), '\\s+'),
  lambda w: w <> '' AND NOT list_contains([{_STOPS_SQL}], w)), ' ') AS actor1_name FROM news""")
def clean_names(spark, sf_dir):
    return tables.news(spark, sf_dir, "event_id", "actor1_name").select(
        "event_id", fn.clean_name("actor1_name").alias("actor1_name")
    )


_FIELDS = ["event_root_code", "action_lat", "action_long", "actor1_geo_type", "actor2_geo_type", "action_geo_type",
           "actor1_type2", "actor1_type3", "actor2_type1"]


@query("epoch_projection", "news", "", f"""
SELECT * FROM (SELECT event_id, CAST(sqldate - DATE '1970-01-01' AS INT) AS day_no,
  CAST({' + '.join(f"CASE WHEN COALESCE(CAST({c} AS VARCHAR), '') = '' THEN 1 ELSE 0 END" for c in _FIELDS)} AS INT) AS n_empty,
  event_code, quad_class, goldstein, actor2_name, num_mentions, num_sources, num_articles, avg_tone FROM news) q
WHERE n_empty <= 5""")
def epoch_projection(spark, sf_dir):
    df = tables.news(spark, sf_dir, "event_id", "sqldate", "event_code", "quad_class", "goldstein", "actor2_name",
                     "num_mentions", "num_sources", "num_articles", "avg_tone", *_FIELDS)
    return df.filter(fn.well_formed(_FIELDS, 5)).select(
        "event_id", fn.days_since_epoch("sqldate").alias("day_no"), fn.empty_fields(_FIELDS).alias("n_empty"),
        "event_code", "quad_class", "goldstein", "actor2_name", "num_mentions", "num_sources", "num_articles", "avg_tone",
    )


def domain_sql(source: str) -> str:
    """Registered domains of `source` (page_id, url) by the suffix rules."""
    return f"""
rules AS (SELECT UNNEST({hosts.RULES}) AS rule),
hosts AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)', 1)), '.') AS host
          FROM {source}),
labels AS (SELECT *, string_split(host, '.') AS h FROM hosts),
tails AS (SELECT page_id, k, array_to_string(h[len(h) - k + 1:], '.') AS s, array_to_string(h[len(h) - k + 2:], '.') AS parent
          FROM labels, range(2, {hosts.MAX_LABELS + 1}) t(k) WHERE len(h) >= k),
sizes AS (SELECT page_id, MAX(CASE WHEN e.rule IS NOT NULL THEN 99 + k WHEN x.rule IS NOT NULL OR w.rule IS NOT NULL THEN k ELSE 1 END) % 100 AS size
          FROM tails LEFT JOIN rules e ON e.rule = concat('!', s) LEFT JOIN rules x ON x.rule = s LEFT JOIN rules w ON w.rule = concat('*.', parent)
          GROUP BY 1),
domains AS (SELECT page_id, url, CASE WHEN len(h) = 1 OR regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN host
  WHEN len(h) > COALESCE(size, 1) THEN h[len(h) - COALESCE(size, 1)] ELSE '' END AS domain FROM labels LEFT JOIN sizes USING (page_id))"""


DOMAIN_SQL = domain_sql("pages")

# Suffixes of many kinds, dealt out to the pages so that the check meets every rule form.
SUFFIXES = ["co.uk", "or.jp", "gob.mx", "com", "a.kawasaki.jp", "city.kawasaki.jp", "kawasaki.jp", "shop.ck", "www.ck", "blog.org.au", "me.sch.uk",
            "com.br.", "gov.unknown", "de", "COM.TR", "jp"]
_SPREAD_SQL = f"""
spread AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN concat('http://10.1.2.', page_id % 256, ':80/a') WHEN page_id % 19 = 0 THEN 'http://localhost/x'
  ELSE concat('https://user:p@ss@', string_split(regexp_extract(url, '://([^/]*)', 1), '.')[1], '.', {SUFFIXES}[1 + page_id % {len(SUFFIXES)}], ':8080/x@y?z') END AS url
  FROM pages),"""


@query("registered_domains", "", _SPREAD_SQL + domain_sql("spread"), "SELECT page_id, domain FROM domains")
def registered_domains(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url")
    label = F.get(F.split(F.regexp_extract("url", "://([^/]*)", 1), r"\."), F.lit(0))
    suffix = F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % len(SUFFIXES)).cast("int"))
    url = F.when(F.col("page_id") % 17 == 0, F.concat(F.lit("http://10.1.2."), (F.col("page_id") % 256).cast("string"), F.lit(":80/a"))).when(
        F.col("page_id") % 19 == 0, "http://localhost/x").otherwise(
        F.concat(F.lit("https://user:p@ss@"), label, F.lit("."), suffix, F.lit(":8080/x@y?z")))
    return pages.select("page_id", fn.url_domain(url).alias("domain"))


@query("url_domains", "news", DOMAIN_SQL, """
SELECT domain, COUNT(*) AS n FROM news JOIN domains USING (page_id) GROUP BY 1""")
def url_domains(spark, sf_dir):
    per_page = tables.news(spark, sf_dir, "page_id").groupBy("page_id").agg(F.count("*").alias("n"))
    pages = tables.table(spark, sf_dir, "pages").select("page_id", fn.url_domain("url").alias("domain"))
    return clean.attach_raw(per_page, pages, "page_id").groupBy("domain").agg(F.sum("n").alias("n"))


def _slot_sql() -> str:
    parts = []
    for r, at in pl.NEWS_LAYOUT.topics:
        if r.kind == "categorical":
            parts.append(f"SELECT event_id, CAST({at} + {r.name} - 1 AS INT) AS slot, 1.0::DOUBLE AS value FROM cleaned "
                         f"WHERE {r.name} BETWEEN 1 AND {r.size}")
        else:
            parts.append(f"SELECT event_id, {at}, CAST({r.name} AS DOUBLE) FROM cleaned WHERE {r.name} <> 0")
    for i, m in enumerate(MEASURES):
        parts.append(f"SELECT event_id, {pl.NEWS_LAYOUT.width + i}, CAST({m} AS DOUBLE) FROM cleaned WHERE {m} <> 0")
    return "\nUNION ALL ".join(parts)


@query("expanded_slots", "news", CLEAN_SQL, _slot_sql())
def expanded_slots(spark, sf_dir):
    return encode.expand(pl.cleaned_news(spark, sf_dir), pl.NEWS_LAYOUT)


@query("slot_stats", "news", CLEAN_SQL + ",\nslots AS (" + _slot_sql() + ")", f"""
SELECT CAST(t.slot AS INT) AS slot, ROUND(m, 6) AS mean,
  ROUND(CASE WHEN v > 1e-24 THEN SQRT(v) ELSE 1 END, 6) AS std
FROM (SELECT t.slot, COALESCE(SUM(value), 0) / (SELECT COUNT(*) FROM cleaned) AS m,
  COALESCE(SUM(value * value), 0) / (SELECT COUNT(*) FROM cleaned)
    - POWER(COALESCE(SUM(value), 0) / (SELECT COUNT(*) FROM cleaned), 2) AS v
  FROM range(0, {pl.NEWS_LAYOUT.width}) t(slot) LEFT JOIN slots s ON s.slot = t.slot GROUP BY 1) t""")
def slot_stats(spark, sf_dir):
    return rounded(encode.slot_stats(pl.cleaned_news(spark, sf_dir), pl.NEWS_LAYOUT), ["mean", "std"])


@query("column_stats", "news", CLEAN_SQL, "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ROUND(AVG({c}), 6) AS mean, ROUND(CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END, 6) AS std_pop FROM cleaned"
    for c in MEASURES))
def column_stats(spark, sf_dir):
    stats = encode.column_stats(pl.cleaned_news(spark, sf_dir), MEASURES)
    return rounded(stats, ["mean", "std"]).withColumnRenamed("std", "std_pop")


@query("standardised", "news", CLEAN_SQL, f"""
SELECT event_id, {', '.join(f'ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 6) AS {c}' for c in MEASURES)} FROM cleaned""")
def standardised(spark, sf_dir):
    df = pl.cleaned_news(spark, sf_dir)
    return rounded(encode.standardise(df, encode.column_stats(df, MEASURES), MEASURES), MEASURES).select("event_id", *MEASURES)


@query("day_range", "news", "", """
SELECT pub_day, COUNT(*) AS n FROM news WHERE pub_day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1""")
def day_range(spark, sf_dir):
    return ev.day_counts(ev.day_range(tables.news(spark, sf_dir, "pub_day"), "1996-01-01", "1996-12-31"))


@query("big_days", "news", "", """
SELECT sqldate, COUNT(*) AS n FROM news WHERE sqldate IN (SELECT sqldate FROM news GROUP BY 1 HAVING COUNT(*) >= 25)
GROUP BY 1""")
def big_days(spark, sf_dir):
    kept = ev.split_by_day(tables.news(spark, sf_dir, "sqldate"), 25)
    return kept.groupBy("sqldate").agg(F.count("*").alias("n"))


@query("latest_by_key", "", "", """
SELECT l_orderkey AS key, r[2] AS l_partkey, r[3] AS l_suppkey, r[4] AS l_quantity FROM (
  SELECT l_orderkey, MAX(ROW(ROW(l_linenumber, l_partkey, l_suppkey, l_quantity), l_partkey, l_suppkey, l_quantity)) AS r
  FROM lineitem GROUP BY 1) q""")
def latest_by_key(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return keyed.upsert_events(rows, order=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
                               values=["l_partkey", "l_suppkey", "l_quantity"])


@query("key_range", "", "", """
SELECT o_orderkey AS key, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) BETWEEN '1000' AND '3'""")
def key_range(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return keyed.scan_range(rows, "1000", "3", as_text=True)


@query("uniform_keys", "news", seeds_sql(64, "news"), "SELECT i, event_id FROM seeds")
def uniform_keys(spark, sf_dir):
    return keyed.uniform_keys(tables.news(spark, sf_dir, "order_no", "event_id"), 64, "order_no", "event_id").select(
        F.col("i").cast("int").alias("i"), "event_id")


@query("tiny_cells", "news", assigned_sql(pl.NEWS_K) + SUMMARY_SQL.format(k=pl.NEWS_K), "\nUNION ALL ".join(
    f"SELECT pub_day, cluster_id, '{m}' AS measure FROM summary WHERE {m} < 5e-8" for m in [*MEASURES, "share"]))
def tiny_cells(spark, sf_dir):
    daily = summary.day_summary(pl.assigned_news(spark, sf_dir), pl.NEWS_K)
    return summary.tiny_cells(daily).select("pub_day", "cluster_id", "measure")


@query("day_vectors", "news", assigned_sql(pl.NEWS_K) + SUMMARY_SQL.format(k=pl.NEWS_K), f"""
SELECT pub_day, list_concat(flatten(list([{', '.join(f'ROUND({m}, 8)' for m in [*MEASURES, 'share'])}]
  ORDER BY CASE WHEN cluster_id = -1 THEN {pl.NEWS_K} ELSE cluster_id END)), [CAST(MAX(n) AS DOUBLE)]) AS vector
FROM summary GROUP BY 1""")
def day_vectors(spark, sf_dir):
    daily = summary.day_summary(pl.assigned_news(spark, sf_dir), pl.NEWS_K)
    return summary.flatten_summary(rounded(daily, [*MEASURES, "share"], 8), pl.NEWS_K)


@query("cluster_share", "news", assigned_sql(pl.NEWS_K), """
SELECT pub_day, cluster_id, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY pub_day), 8) AS share
FROM assigned GROUP BY 1, 2""")
def cluster_share(spark, sf_dir):
    return rounded(summary.cluster_share(pl.assigned_news(spark, sf_dir)), ["share"], 8)


@query("event_counts", "news", "", """
SELECT CAST(d AS DATE) AS day, COUNT(n.sqldate) AS n FROM range(DATE '1995-01-01', DATE '1997-01-01', INTERVAL 1 DAY) t(d)
LEFT JOIN news n ON n.sqldate = CAST(d AS DATE) GROUP BY 1""")
def event_counts(spark, sf_dir):
    return summary.event_counts(tables.news(spark, sf_dir, "sqldate"), "1995-01-01", "1997-01-01")


@query("intravariance", "news", assigned_sql(pl.NEWS_K), """
SELECT cluster_id, ROUND(SUM(dist), 4) AS total, COUNT(*) AS size FROM assigned GROUP BY ROLLUP (cluster_id)""")
def intravariance(spark, sf_dir):
    return rounded(clusters.intravariance(pl.assigned_news(spark, sf_dir)), ["total"], 4)


@query("cluster_contents", "news", assigned_sql(pl.NEWS_K), """
SELECT cluster_id, event_id, url FROM assigned JOIN pages USING (page_id)""")
def cluster_contents(spark, sf_dir):
    assigned = pl.assigned_news(spark, sf_dir, pl.NEWS_K, "page_id")
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url")
    return clusters.cluster_contents(clean.attach_raw(assigned, pages, "page_id"), "url")


@query("cluster_samples", "news", assigned_sql(pl.NEWS_K), """
SELECT cluster_id, url, event_id FROM (SELECT cluster_id, url, event_id,
  ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY event_id) AS rn FROM assigned JOIN pages USING (page_id)) q
WHERE rn <= 20""")
def cluster_samples(spark, sf_dir):
    assigned = pl.assigned_news(spark, sf_dir, pl.NEWS_K, "page_id")
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url")
    return clusters.cluster_contents(clean.attach_raw(assigned, pages, "page_id"), "url", 20)


@query("keyword_spread", "news", assigned_sql(pl.NEWS_K), """
SELECT cluster_id, COUNT(*) AS hits FROM assigned JOIN pages USING (page_id) WHERE contains(lower(url), 'ref') GROUP BY 1""")
def keyword_spread(spark, sf_dir):
    assigned = pl.assigned_news(spark, sf_dir, pl.NEWS_K, "page_id")
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url")
    return clusters.keyword_spread(clean.attach_raw(assigned, pages, "page_id"), "ref")


DENSE_SQL = """
seed AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY label) - 1 AS INT) AS cluster_id, r[2] AS centroid
  FROM (SELECT label, MIN(ROW(vec_id, CAST(embedding AS DOUBLE[]))) AS r FROM embeddings GROUP BY 1) q),
near AS (SELECT vec_id, label, embedding, r[2] AS cluster_id, r[1] AS d2 FROM (
  SELECT e.vec_id, e.label, e.embedding,
    MIN(ROW(ROUND(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), s.centroid), lambda p: (p[1] - p[2]) ** 2)), 9), s.cluster_id)) AS r
  FROM embeddings e CROSS JOIN seed s GROUP BY 1, 2, 3) q)"""


def dense_assigned(spark, sf_dir):
    """Embeddings assigned to one seed vector per label (the smallest id of each)."""
    e = tables.table(spark, sf_dir, "embeddings")
    seeds = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    numbered = seeds.select(
        (F.row_number().over(Window.orderBy("label")) - 1).alias("cluster_id"), F.col("c").cast("array<double>").alias("centroid")
    )
    return nearest.assign_dense(e, nearest.freeze(numbered), "embedding")


@query("nearest_vector", "", DENSE_SQL, "SELECT vec_id, cluster_id, ROUND(SQRT(d2), 5) AS dist FROM near")
def nearest_vector(spark, sf_dir):
    return dense_assigned(spark, sf_dir).select("vec_id", "cluster_id", F.round("dist", 5).alias("dist"))


@query("lloyd_step", "", DENSE_SQL, """
SELECT cluster_id, CAST(i - 1 AS INT) AS dim, ROUND(AVG(CAST(v AS DOUBLE)), 6) AS mean FROM (
  SELECT cluster_id, UNNEST(embedding) AS v, UNNEST(range(1, len(embedding) + 1)) AS i FROM near) q GROUP BY 1, 2""")
def lloyd_step(spark, sf_dir):
    return rounded(clusters.lloyd_step(dense_assigned(spark, sf_dir)), ["mean"])


@query("kmeans_score", "", DENSE_SQL, "SELECT ROUND(-SUM(d2), 5) AS score FROM near")
def kmeans_score(spark, sf_dir):
    return rounded(clusters.kmeans_score(dense_assigned(spark, sf_dir)), ["score"], 5)


@query("purity", "", DENSE_SQL, """
SELECT ROUND(SUM(best) / SUM(n), 8) AS purity, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT cluster_id, MAX(n) AS best, SUM(n) AS n FROM (
    SELECT cluster_id, label, COUNT(*) AS n FROM near GROUP BY 1, 2) q GROUP BY 1) r""")
def purity(spark, sf_dir):
    return rounded(clusters.purity(dense_assigned(spark, sf_dir)), ["purity"], 8)
