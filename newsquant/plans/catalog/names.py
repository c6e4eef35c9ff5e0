"""Queries on name vectors and on clusters of events that carry them.

Names are the two-word names of the first actor and the type of the second.
Word vectors of the check are hashed from the words, so SQL can make them too;
`word2vec` fits real ones.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newsquant.functions.hashing import KEY_RANGE, random_key
from newsquant.operators import encode, nearest
from newsquant.operators import text as words
from newsquant.plans.catalog.news import seeds_sql
from newsquant.plans.catalog.registry import query
from newsquant.schema import Role
from newsquant.session import cut_lineage
from newsquant.sources import tables
from newsquant.sources.keyed import uniform_keys

DIM, K, MIN_COUNT = 4, 6, 2
LAYOUT = encode.layout(roles=[Role("quad_class", "categorical", 4), Role("goldstein", "numeric"), Role("name1", "string"), Role("name2", "string")],
                       names=DIM)


def _vector_sql(word: str) -> str:
    cells = ", ".join(f"CAST('0x' || substr(md5(concat({word}, ':{i}')), 1, 8) AS BIGINT) / {KEY_RANGE / 2} - 1" for i in range(DIM))
    return f"[{cells}]"


NAMES_SQL = f"""
pairs AS (SELECT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
counts AS (SELECT w, COUNT(*) AS n FROM (SELECT a AS w FROM pairs UNION ALL SELECT b FROM pairs) q GROUP BY 1),
scored AS (SELECT a, b, (COUNT(*) - {MIN_COUNT}) * (SELECT COUNT(*) FROM counts) / CAST(ANY_VALUE(x.n) * ANY_VALUE(y.n) AS DOUBLE) AS score
  FROM pairs JOIN counts x ON x.w = a JOIN counts y ON y.w = b GROUP BY a, b HAVING COUNT(*) >= {MIN_COUNT}),
accepted AS (SELECT concat(a, '_', b) AS w, concat(a, ' ', b) AS name FROM scored WHERE score > (SELECT AVG(score) FROM scored)),
known AS (SELECT name, {_vector_sql('w')} AS v FROM (
    SELECT name, w FROM accepted UNION SELECT lower(c_mktsegment), lower(c_mktsegment) FROM customer) q
  UNION ALL SELECT '', {[0.0] * DIM}),
raw AS (SELECT event_id, order_no, quad_class, goldstein, regexp_extract(actor1_name, '^ The (.*) of ', 1) AS raw1,
  lower(actor2_type1) AS raw2 FROM news)"""


def _accepted(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tokens"))
    scored = cut_lineage(words.phrase_scores(parts, MIN_COUNT))
    return scored.filter(F.col("score") > scored.agg(F.avg("score")).scalar()).select("a", "b")


def _vectors(spark, sf_dir, accepted):
    segments = tables.table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word"))
    known = accepted.select(F.concat_ws("_", "a", "b").alias("word")).unionByName(segments).distinct()
    cells = [random_key("word", i) / F.lit(KEY_RANGE / 2) - 1 for i in range(DIM)]
    return known.select("word", array_to_vector(F.array(*cells)).alias("vector"))


def named_events(spark, sf_dir):
    """Events with the vectors of both names; an event with an unknown name is left out."""
    accepted = cut_lineage(_accepted(spark, sf_dir))
    vectors = _vectors(spark, sf_dir, accepted)
    raw = tables.news(spark, sf_dir, "event_id", "order_no", "quad_class", "goldstein", "actor1_name", "actor2_type1").select(
        "event_id", "order_no", "quad_class", "goldstein", F.regexp_extract("actor1_name", "^ The (.*) of ", 1).alias("raw1"),
        F.lower("actor2_type1").alias("raw2"))
    raw = cut_lineage(raw)  # read four times below, for the distinct names and for the rows
    named = words.name_vectors(raw, "raw1", vectors, [accepted], DIM, "name1")
    return words.name_vectors(named, "raw2", vectors, [accepted], DIM, "name2")


@query("name_lookup", "news", NAMES_SQL, f"""
SELECT raw1 AS name, COUNT(*) AS n, {', '.join(f'ROUND(ANY_VALUE(v[{i + 1}]), 8) AS v{i}' for i in range(DIM))}
FROM raw JOIN known ON raw1 = name GROUP BY 1""")
def name_lookup(spark, sf_dir):
    accepted = cut_lineage(_accepted(spark, sf_dir))
    raw = tables.news(spark, sf_dir, "actor1_name").select(F.regexp_extract("actor1_name", "^ The (.*) of ", 1).alias("name"))
    named = words.name_vectors(raw, "name", _vectors(spark, sf_dir, accepted), [accepted], DIM, "v")
    return named.groupBy("name").agg(F.count("*").alias("n"), *[F.round(F.first(F.get("v", F.lit(i))), 8).alias(f"v{i}") for i in range(DIM)])


_SLOTS = [f"q{i}" for i in range(1, 5)] + ["g"] + [f"{x}{i}" for x in "ab" for i in range(1, DIM + 1)]
_NAMED_SQL = NAMES_SQL + f""",
named AS (SELECT r.event_id, order_no, {', '.join(f'CAST(quad_class = {i} AS INT)::DOUBLE AS q{i}' for i in range(1, 5))}, goldstein AS g,
  {', '.join(f'{x}.v[{i}]::DOUBLE AS {x}{i}' for x in 'ab' for i in range(1, DIM + 1))}
  FROM raw r JOIN known a ON raw1 = a.name JOIN known b ON raw2 = b.name),
st AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END AS s_{c}' for c in _SLOTS)} FROM named),
z AS (SELECT event_id, order_no, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _SLOTS)} FROM named, st),""" + seeds_sql(K, "named") + f""",
centres AS (SELECT s.i, z.* FROM seeds s JOIN z USING (event_id)),
near AS (SELECT event_id, MIN(ROW(d, i)) AS r FROM (SELECT z.event_id, c.i,
  ROUND({' + '.join(f'POWER(z.{c} - c.{c}, 2)' for c in _SLOTS)}, 9) AS d FROM z CROSS JOIN centres c) q GROUP BY 1)"""


@query("named_clusters", "news", _NAMED_SQL, "SELECT event_id, r[2] AS cluster_id, ROUND(SQRT(r[1]), 6) AS dist FROM near")
def named_clusters(spark, sf_dir):
    """Nearest centre of events whose expanded vector holds the vectors of both names."""
    events = cut_lineage(named_events(spark, sf_dir))
    stats = nearest.freeze(encode.slot_stats(events, LAYOUT))
    seeds = uniform_keys(events, K, "order_no", "event_id", [r.name for r, _ in LAYOUT.topics])
    out = nearest.assign_expanded(events, LAYOUT, stats, nearest.event_centroids(seeds, LAYOUT, stats))
    return out.select("event_id", "cluster_id", F.round("dist", 6).alias("dist"))
