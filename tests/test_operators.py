"""Operators against brute force or hand-computed values on small frames."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsquant.functions.distance import mixed_distance
from newsquant.functions.hashing import random_key
from newsquant.operators import clusters, dataset, encode, medoids, metrics, nearest, ranking, sample, series, summary, text, trading
from newsquant.operators import explore as ex
from newsquant.schema import IMPORTANCE, Role


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group."""
    rows = [(f"e{i}", "hot" if i % 3 == 0 else f"g{i % 7}", float((i * 37) % 101), i) for i in range(3000)]
    return spark.createDataFrame(rows, "event_id string, g string, v double, n int").cache()


def test_layout_width_is_938():
    lay = encode.layout()
    assert lay.width == 938 and len(lay.importance) == 7


def test_keyed_rank_equals_window(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 50)
    w = Window.partitionBy("g").orderBy(random_key("event_id", 4), "event_id")
    plain = skewed.select("event_id", F.row_number().over(w).alias("want"))
    both = ranking.keyed_rank(skewed, ["g"], "event_id", 4).join(plain, "event_id")
    assert both.count() == 3000 and both.filter(F.col("rank") != F.col("want")).count() == 0


def test_keyed_first_equals_window(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 50)
    w = Window.partitionBy("g").orderBy(random_key("event_id", 4), "event_id")
    quota = skewed.withColumn("q", F.when(F.col("g") == "hot", 333).otherwise(10))
    want = {r[0] for r in quota.withColumn("r", F.row_number().over(w)).filter("r <= q").select("event_id").collect()}
    got = [r[0] for r in ranking.keyed_first(quota, ["g"], "event_id", "q", 4).select("event_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_large_equal_sample_equals_small_path(skewed):
    big = sample.sample_per_day(skewed, 1000, 1, "g")
    assert big.count() == skewed.groupBy("g").count().select(F.sum(F.least("count", F.lit(1000)))).first()[0]


def test_proportional_sample_has_exact_size(skewed):
    got = sample.sample_proportional(skewed, 1001, 2, "g")
    assert got.count() == 1001 == got.select("event_id").distinct().count()
    hot = got.filter("g = 'hot'").count()
    assert abs(hot - 1001 / 3) <= 7
    assert sample.sample_proportional(skewed, 5000, 2, "g").count() == 3000


def test_bootstrap_and_holdout(skewed):
    draws = sample.bootstrap(skewed, 5000, 3)
    assert draws.count() == 5000 and draws.select("event_id").distinct().count() < 3000
    split = sample.repeated_holdout(skewed.select("event_id"), 0.7, 4).groupBy("draw", "split").count().collect()
    assert {(r["draw"], r["split"]): r["count"] for r in split} == {(d, s): n for d in range(4) for s, n in (("train", 2100), ("test", 900))}


@pytest.mark.parametrize("method,numpy_method", [("linear", "linear"), ("hazen", "hazen"), ("inverse_cdf", "inverted_cdf")])
def test_exact_quantiles(skewed, method, numpy_method):
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in ranking.exact_quantiles(skewed, "v", qs, ["g"], method).collect()}
    data = skewed.toPandas()
    for g, part in data.groupby("g"):
        want = np.quantile(part["v"], list(qs.values()), method=numpy_method)
        assert [got[g][n] for n in qs] == pytest.approx(want)


def test_value_prefix_equals_window(skewed):
    counts = skewed.groupBy("g", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("v")
    plain = counts.withColumn("want", F.sum("n").over(w)).select("g", "v", "want")
    both = ranking.value_prefix(counts, ["g"], "v", ["n"]).join(plain, ["g", "v"])
    assert both.filter(F.col("n_upto") != F.col("want")).count() == 0 and both.count() == counts.count()


NUM, CAT = ["x", "y"], ["a", "b"]


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(f"e{i:02d}", i, float(i * 7 % 13), float(i * i % 11) / 2, None if i % 5 == 0 else "pqr"[i % 3], "st"[i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "event_id string, seq int, x double, y double, a string, b string").cache()


def test_medoid_costs_equal_pairwise_sums(mini):
    seeds = medoids.seed_medoids(mini, 3, "seq", NUM, CAT)
    assigned = nearest.assign_mixed(mini, seeds, NUM, CAT)
    pairs = assigned.alias("l").join(assigned.alias("r"), F.col("l.cluster_id") == F.col("r.cluster_id"))
    want = pairs.groupBy("l.event_id").agg(F.sum(mixed_distance("l", "r", NUM, CAT)).alias("want"))
    both = medoids.medoid_costs(assigned, NUM, CAT).join(want, "event_id").collect()
    assert len(both) == 40 and all(r["cost"] == pytest.approx(r["want"]) for r in both)


def test_assign_mixed_equals_pairs(mini):
    seeds = medoids.seed_medoids(mini, 3, "seq", NUM, CAT)
    pairs = mini.alias("l").crossJoin(seeds.alias("r")).select(
        F.col("l.event_id"), F.struct(F.round(mixed_distance("l", "r", NUM, CAT), 9).alias("d"), F.col("r.cluster_id")).alias("s"))
    want = {r[0]: r[1] for r in pairs.groupBy("event_id").agg(F.min("s")).collect()}
    for r in nearest.assign_mixed(mini, seeds, NUM, CAT).collect():
        assert (r["cluster_id"], r["dist"]) == (want[r["event_id"]]["cluster_id"], pytest.approx(want[r["event_id"]]["d"]))


def test_medoid_with_missing_category_is_not_at_distance_zero(spark):
    df = spark.createDataFrame([("e1", 1, 0.0, 0.0, None, None)], "event_id string, seq int, x double, y double, a string, b string")
    seeds = medoids.seed_medoids(df, 1, "seq", NUM, CAT)
    assert nearest.assign_mixed(df, seeds, NUM, CAT).first()["dist"] == 2.0


def test_kmedoids_improves_until_stable(mini):
    found, history = medoids.kmedoids(mini, 3, "seq", 8, NUM, CAT)
    totals = [r[1] for r in history.groupBy("iteration").agg(F.sum("total")).orderBy("iteration").collect()]
    assert found.count() == 3 and len(totals) >= 2 and totals[-1] <= totals[0]
    last = history.agg(F.max("iteration")).first()[0]
    ids = lambda i: {r[0] for r in history.filter(F.col("iteration") == i).select("event_id").collect()}
    assert ids(last) == ids(last - 1)


LAY = encode.Layout((Role("c", "categorical", 3), Role("z", "numeric")))


def test_assign_expanded_equals_dense(spark):
    rows = [(f"e{i}", i % 4 if i % 4 else None, float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id string, c int, z double")
    stats = encode.slot_stats(df, LAY)
    s = sorted(stats.collect(), key=lambda r: r["slot"])
    mean, std = np.array([r["mean"] for r in s]), np.array([r["std"] for r in s])
    x = np.zeros((30, 4))
    for i, (_, c, z) in enumerate(rows):
        if c:
            x[i, c - 1] = 1
        x[i, 3] = z
    assert mean == pytest.approx(x.mean(axis=0)) and std == pytest.approx(x.std(axis=0))
    centres = np.array([[0.1, -0.2, 0.3, 0.5], [1.0, 0.4, -1.0, -0.7], [1.0, 0.4, -1.0, -0.7]])
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster_id int, centroid array<double>")
    d = np.sqrt(((((x - mean) / std)[:, None, :] - centres[None]) ** 2).sum(axis=2))
    got = {r["event_id"]: r for r in nearest.assign_expanded(df, LAY, stats, table).collect()}
    for i in range(30):
        assert got[f"e{i}"]["cluster_id"] == min(int(d[i].argmin()), 1)
        assert got[f"e{i}"]["dist"] == pytest.approx(d[i].min())


def test_zero_variance_column_keeps_std_one(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "c int, z double")
    stats = {r["slot"]: r for r in encode.slot_stats(df, LAY).collect()}
    assert stats[0]["std"] == 1.0 and stats[3]["std"] == 1.0 and stats[3]["mean"] == 5.0
    assert encode.column_stats(df, ["z"]).first()["std"] == 1.0


def test_model_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MAX_MODEL_CELLS", 4)
    table = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(3)], "cluster_id int, centroid array<double>")
    with pytest.raises(ValueError):
        nearest.model_rows(table, 2, "cluster_id")


def assigned_rows(spark):
    rows = [(date(2015, 1, d), c, *[float(d + c)] * 7) for d in (1, 2) for c in ((0, 0, 2) if d == 1 else (1,))]
    return spark.createDataFrame(rows, "pub_day date, cluster_id int, " + ", ".join(f"{m} double" for m in IMPORTANCE))


def test_day_summary_zero_fill_and_totals(spark):
    out = summary.day_summary(assigned_rows(spark), 3)
    rows = {(r["pub_day"].day, r["cluster_id"]): r for r in out.collect()}
    assert len(rows) == 8
    assert rows[(1, 1)]["share"] == 0 and rows[(1, 1)]["goldstein"] == 0
    assert rows[(1, -1)]["share"] == 1 and rows[(1, -1)]["n"] == 3
    for day in (1, 2):
        parts = [rows[(day, c)] for c in range(3)]
        assert sum(p["goldstein"] for p in parts) == pytest.approx(rows[(day, -1)]["goldstein"])
        assert sum(p["share"] for p in parts) == pytest.approx(1)
    flat = {r["pub_day"].day: r["vector"] for r in summary.flatten_summary(out, 3).collect()}
    assert len(flat[1]) == (3 + 1) * 8 + 1
    assert flat[1][0 * 8 + 7] == pytest.approx(2 / 3) and flat[1][3 * 8 + 7] == 1 and flat[1][-1] == 3
    sparse = summary.day_summary(assigned_rows(spark), 3, zero_fill=False)
    assert sparse.count() == 5


def test_day_summary_of_several_models(spark):
    one = assigned_rows(spark)
    many = one.withColumn("k", F.lit(3)).unionByName(one.withColumn("k", F.lit(5)))
    out = summary.day_summary(many, "k")
    assert out.filter("k = 3").count() == 8 and out.filter("k = 5").count() == 12
    assert {len(r["vector"]) for r in summary.flatten_summary(out, "k").collect()} == {33, 49}


def prices(spark, values, symbol="S"):
    rows = [(symbol, date(2015, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, day date, price double")


def column(df, name):
    return [r[name] for r in df.orderBy("day").collect()]


def test_series_edges(spark):
    p = prices(spark, [1, 2, 2, 1])
    assert column(series.rolling_mean(p, [3]), "ma3") == [None, None, pytest.approx(5 / 3), pytest.approx(5 / 3)]
    assert column(series.up_label(p, 0), "up") == [0, 1, 0, 0]
    assert column(series.up_label(p, 1), "up") == [1, 0, 0, None]
    assert column(series.diff(p), "diff") == [None, 1, 0, -1]
    runs = series.state_runs(series.up_label(p, 0), "up").orderBy("start").collect()
    assert [(r["state"], r["n"]) for r in runs] == [(0, 1), (1, 1), (0, 2)]
    assert all(r["start"] <= r["end"] for r in runs)
    assert column(series.ema(p, 14), "ema") == [None] * 4


def test_ema_recursion(spark):
    values = [10 + (i * 7 % 5) for i in range(20)]
    e = sum(values[:3]) / 3
    want = [e]
    for v in values[3:]:
        e = 0.5 * v + 0.5 * e
        want.append(e)
    got = column(series.ema(prices(spark, values), 3), "ema")
    assert got[3:] == pytest.approx(want[1:]) and got[:3] == [got[3]] * 3


def test_pacf_recursion(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=200)) * 0.1 + rng.normal(size=200) + 50
    got = {r["lag"]: r["pacf"] for r in series.pacf(prices(spark, x), 4).collect()}
    d = x - x.mean()
    rho = [float((d[k:] * d[:len(d) - k]).sum() / (d * d).sum()) for k in range(5)]
    for m in range(1, 5):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(m)] for i in range(m)])
        assert got[m] == pytest.approx(np.linalg.solve(toeplitz, rho[1:m + 1])[-1], abs=1e-9)


def test_splits(spark):
    p = prices(spark, range(1, 12))
    assert [r["split"] for r in dataset.split_ratio(p).orderBy("day").collect()] == ["train"] * 6 + ["valid"] * 2 + ["test"] * 3
    named = dataset.split_dates(p, {"train": ("2015-01-01", "2015-01-03"), "test": ("2015-01-05", "2015-01-05")})
    assert [r["split"] for r in named.orderBy("day").collect()] == ["train"] * 3 + ["test"]
    assert dataset.param_grid(spark, k=[1, 2], n=[3, 4, 5]).count() == 6


def bets(spark, moves, expected, variance=0.02):
    p = prices(spark, moves)
    return p.withColumns({"expected": F.lit(expected) * F.when(F.dayofmonth("day") % 2 == 0, 1).otherwise(-1), "variance": F.lit(variance)})


@pytest.mark.parametrize("expected,rate", [(0.01, 0.0), (0.05, 0.01), (0.001, 0.01)])
def test_kelly_fold_equals_product(spark, expected, rate):
    df = bets(spark, [15 + (i * 5 % 7) * 0.1 for i in range(25)], expected)
    a = trading.kelly(df, 15.0, rate, "product").orderBy("step").collect()
    b = trading.kelly(df, 15.0, rate, "fold").orderBy("step").collect()
    assert [r["wealth"] for r in a] == pytest.approx([r["wealth"] for r in b])
    assert a[0]["step"] == 0 and a[0]["wealth"] == a[1]["wealth"] == 15.0
    if expected < rate:
        assert {r["fraction"] for r in a} == {0.0}


def test_kelly_replay_of_first_days(spark):
    """Three trades by hand: f = e / v, wealth follows the price while invested."""
    df = prices(spark, [10, 11, 9.9]).withColumns({"expected": F.lit(0.01), "variance": F.lit(0.02)})
    wealth = [r["wealth"] for r in trading.kelly(df, 100.0).orderBy("step").collect()]
    assert wealth == pytest.approx([100, 100, 105, 105 * 0.5 + 105 * 0.5 * 0.9])
    m = trading.kelly_metrics(trading.kelly(df, 100.0), 100.0).first()
    assert m["total_return"] == pytest.approx(wealth[-1] / 100 - 1) and m["max_leverage"] == pytest.approx(0.5)


def test_phrases_merge_left_to_right(spark):
    tokens = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, ["a", "a", "a"])], "doc_id long, tokens array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "c"), ("a", "a")], "a string, b string")
    got = {r["doc_id"]: r["tokens"] for r in text.merge_phrases(tokens, pairs).collect()}
    assert got == {1: ["a_b", "b_c"], 2: ["a_a", "a"]}


def test_name_vectors(spark):
    corpus = spark.createDataFrame([(i, ["new", "york", "mayor"]) for i in range(8)], "doc_id long, tokens array<string>")
    pairs = spark.createDataFrame([("new", "york")], "a string, b string")
    _, vectors = text.fit_word2vec(text.merge_phrases(corpus, pairs), dim=4)
    names = spark.createDataFrame([("new york",), ("",), ("unknown word",)], "name string")
    got = {r["name"]: r["name_vector"] for r in text.name_vectors(names, "name", vectors, [pairs], 4).collect()}
    assert set(got) == {"new york", ""} and got[""] == [0.0] * 4
    assert np.linalg.norm(got["new york"]) == pytest.approx(1, abs=1e-5)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    m = metrics.classification_metrics(df, "y", "p").first()
    assert (m["accuracy"], m["f1"], m["recall_w"]) == pytest.approx((0.6, 2 / 3, 0.6))
    assert m["ap"] == pytest.approx(2 / 3 * 2 / 3 + 1 / 3 * 0.6)
    grid = spark.createDataFrame([(0, 0.5, "x"), (1, 0.7, "y"), (2, 0.7, "z")], "g int, score double, name string")
    assert metrics.best_params(grid, "score", "g").first()["name"] == "y"


def test_explore_helpers(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("", "x")], "a string, b string")
    co = {(r["direction"], r["actor"]): r["n_co_actors"] for r in ex.co_actors(df, "a", "b").collect()}
    assert co == {("1to2", "a"): 2, ("1to2", "b"): 1, ("2to1", "x"): 2, ("2to1", "y"): 1}
    rough = {(r["direction"], r["actor"]): r["n_co_actors"] for r in ex.co_actors(df.filter("a <> ''"), "a", "b", approx=True).collect()}
    assert rough == co
    n = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    assert [r["v"] for r in ex.box_outliers(n, "v").collect()] == [100.0]
    assert ex.trim_quantile(n, "v", 0.9).count() == 4
    assert [r["v"] for r in ex.top_k(n, "v", 2, "v").collect()] == [100.0, 4.0]


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "v int")
    b = spark.createDataFrame([(2,), (3,)], "v int")
    j = ex.jaccard(a, b).first()
    assert (j["n_both"], j["n_any"]) == (1, 3)
    assert a.exceptAll(b).count() == 2


def test_lloyd_and_pack(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "cluster_id int, embedding array<double>")
    packed = {r["cluster_id"]: r["centroid"] for r in clusters.pack_centroids(clusters.lloyd_step(df)).collect()}
    assert packed == {0: [2.0, 3.0], 1: [5.0, 6.0]}


def test_impact_pivot_keeps_all_impact(spark):
    from newsquant.operators import impact
    from newsquant.plans.catalog.explore import COUNTRIES, TYPES1, TYPES2, _impact_input, impact_wide

    names, wide = impact_wide(spark, "/root/testdata/sf0.001")
    long = impact.impact_cells(_impact_input(spark, "/root/testdata/sf0.001"), COUNTRIES, "h3", TYPES1, TYPES2)
    want = {r["sqldate"]: r["s"] for r in long.groupBy("sqldate").agg(F.sum("impact").alias("s")).collect()}
    got = {r["sqldate"]: sum(r[n] for n in names) for r in wide.collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_kelly_methods_agree_until_wealth_is_lost(spark):
    import pytest

    from newsquant.operators import trading

    rows = [("a", d, 10.0 + d % 3, 0.02 * (d % 2), 0.01) for d in range(8)] + [("b", d, 20.0 - d, 0.3, 0.1) for d in range(6)]
    df = spark.createDataFrame(rows, "symbol string, day int, price double, expected double, variance double")
    fold = {(r.symbol, r.step): r.wealth for r in trading.kelly(df, r=0.05).collect()}
    money, units, want = 15.0, 0.0, []
    for d in range(6):
        p, e, v = rows[8 + d][2:]
        wealth = money + units * p
        f = max(abs(e) - 0.05, 0) / v
        want.append(wealth)
        units, money = f * wealth / p, wealth - f * wealth
        money *= 1.05 if money < 0 else 1
    assert [round(fold["b", s + 1], 9) for s in range(6)] == [round(w, 9) for w in want]
    product = {(r.symbol, r.step): r.wealth for r in trading.kelly(df.filter("symbol = 'a'"), r=0.05, method="product").collect()}
    assert all(abs(product[k] - fold[k]) < 1e-9 for k in product)
    down = df.withColumn("expected", F.lit(-9.0)).withColumn("price", F.col("price") * (1 + F.col("day")))
    with pytest.raises(Exception, match="wealth is not positive"):
        trading.kelly(down, r=0.05, method="product").collect()
