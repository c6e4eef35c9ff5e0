"""Fitted models against direct numpy solutions or planted structure."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from newsquant.operators import autoreg, classify, clusters, encode, grid, linear, mixture, nearest, regimes, series
from newsquant.schema import Role

DAY0 = date(2015, 1, 1)


def frame(spark, columns, symbol="S"):
    names = list(columns)
    rows = [(symbol, DAY0 + timedelta(days=i), *[float(columns[n][i]) for n in names]) for i in range(len(columns[names[0]]))]
    return spark.createDataFrame(rows, "symbol string, day date, " + ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=120), rng.normal(size=120)
    return a, b, 1 + 2 * a - 3 * b + 0.1 * rng.normal(size=120)


def test_ols_equals_lstsq(spark, data):
    a, b, y = data
    df = frame(spark, {"a": a, "b": b, "y": y})
    m = linear.fit_ols(df, ["a", "b"], "y", ["symbol"])
    x = np.column_stack([np.ones(120), a, b])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    row = m.first()
    assert row["coef"] == pytest.approx(beta)
    s2 = ((y - x @ beta) ** 2).sum() / 117
    assert row["std_err"] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2))
    pred = [r["pred"] for r in linear.predict_ols(df, m, ["a", "b"], ["symbol"]).orderBy("day").collect()]
    assert pred == pytest.approx(x @ beta)
    g = {r["term"]: r for r in linear.gaussian_glm(df, ["a", "b"], "y").collect()}
    assert [g[t]["coef"] for t in ("intercept", "a", "b")] == pytest.approx(beta)
    assert g["a"]["p_value"] < 1e-6


def test_singular_ols_gives_finite_fit(spark, data):
    a, _, y = data
    row = linear.fit_ols(frame(spark, {"a": a, "b": 2 * a, "y": y}), ["a", "b"], "y").first()
    assert np.isfinite(row["coef"]).all()


def test_vif_flags_collinear_columns(spark, data):
    a, b, _ = data
    df = frame(spark, {"a": a, "b": b, "c": a + 0.05 * b})
    got = {r["column"]: r for r in linear.vif(df, ["a", "b", "c"], 10).collect()}
    assert got["a"]["drop"] and got["c"]["drop"]


def test_adf_with_lags(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    df = frame(spark, {"price": noise}, "N").unionByName(frame(spark, {"price": walk}, "W"))
    got = {r["symbol"]: r["stationary"] for r in autoreg.adf(df, 2).collect()}
    assert got == {"N": True, "W": False}


def test_ar_window_equals_direct(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(150)
    for t in range(1, 150):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    df = series.lag_matrix(frame(spark, {"x": x}), "x", [1])
    got = autoreg.fit_ar(df, ["lag1"], "x", window=50).orderBy("day").collect()
    design = np.column_stack([np.ones(149), x[:-1]])
    beta, *_ = np.linalg.lstsq(design[:50], x[1:51], rcond=None)
    assert got[0]["mean"] == pytest.approx(design[50] @ beta)
    inside = np.mean([r["lo"] <= r["actual"] <= r["hi"] for r in got])
    assert 0.85 < inside <= 1
    assert autoreg.fit_ar(df, ["lag1"], "x").count() == 149


def test_arma_order_finds_ar2(spark):
    rng = np.random.default_rng(11)
    x = np.zeros(600)
    for t in range(2, 600):
        x[t] = 0.5 * x[t - 1] + 0.3 * x[t - 2] + rng.normal()
    best = autoreg.arma_order(frame(spark, {"ret": x}), [0, 1, 2], [0]).filter("best").first()
    assert (best["p"], best["q"]) == (2, 0)


def test_hmm_finds_planted_regimes(spark):
    rng = np.random.default_rng(2)
    state = np.repeat([0, 1, 0], 80)
    x = np.where(state == 1, 1.0, -1.0) + 0.3 * rng.normal(size=240)
    out = regimes.hmm_states(frame(spark, {"log_ret": x, "ret_ema": x * 0.5})).orderBy("day").collect()
    assert np.mean([r["state"] == s for r, s in zip(out, state)]) > 0.97
    again = regimes.hmm_states(frame(spark, {"log_ret": x, "ret_ema": x * 0.5}).orderBy(F.desc("day"))).orderBy("day").collect()
    assert [r["state"] for r in again] == [r["state"] for r in out]


def test_digamma():
    assert mixture.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


def test_dp_mixture_keeps_the_planted_components(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, size=(100, 2)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, z array<double>")
    _, early, _ = mixture.fit_dpgmm(df, "z", 8, 1.0, tol=1e9)
    table, late, used = mixture.fit_dpgmm(df, "z", 8, 1.0)
    assert late > early and 3 <= used <= 8
    heavy = [r["centroid"][0] for r in table.filter("weight > 0.05").collect()]
    assert all(min(abs(h - c) for h in heavy) < 0.5 for c in (-3, 0, 3))
    assert sum(r["weight"] for r in table.collect()) == pytest.approx(1)


def test_dp_mixture_that_is_cut_short_is_an_error(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(60)], "vec_id long, z array<double>")
    with pytest.raises(RuntimeError):
        mixture.fit_dpgmm(df, "z", 4, 1.0, 1, tol=1e-9)


def test_dp_mixture_on_events_equals_the_dense_one(spark, tmp_path):
    rng = np.random.default_rng(8)
    lay = encode.layout(roles=[Role("c", "categorical", 5), Role("z", "numeric"), Role("d", "categorical", 3), Role("w", "string")], names=2)
    kind = [i % 3 for i in range(240)]
    rows = [(f"e{i:03d}", None if i % 40 == 7 else 1 + k, float(rng.normal(4 * k, 0.3)), 1 + int(rng.integers(3)), rng.normal(0, 1, 2).tolist())
            for i, k in enumerate(kind)]
    df = spark.createDataFrame(rows, "event_id string, c int, z double, d int, w array<double>")
    stats = nearest.freeze(encode.slot_stats(df, lay))
    table, score, used = mixture.fit_dpgmm_events(df, lay, stats, 6, 1.0, tol=1e-4)
    stat = sorted(stats.collect(), key=lambda r: r["slot"])
    mean, std = np.array([r["mean"] for r in stat]), np.array([r["std"] for r in stat])

    def dense(r):
        x = np.zeros(lay.width)
        for role, at in lay.topics:
            v = r[1 + ["c", "z", "d", "w"].index(role.name)]
            if role.kind == "categorical" and v is not None:
                x[at + v - 1] = 1.0
            elif role.kind != "categorical":
                x[at:at + (role.size if role.kind == "vector" else 1)] = v
        return ((x - mean) / std).tolist()

    plain = spark.createDataFrame([(r[0], dense(r)) for r in rows], "event_id string, x array<double>")
    want, want_score, want_used = mixture.fit_dpgmm(plain, "x", 6, 1.0, id_col="event_id")
    assert (score, used) == (pytest.approx(want_score), want_used)
    for a, b in zip(table.orderBy("cluster_id").collect(), want.orderBy("cluster_id").collect()):
        assert a.n == pytest.approx(b.n, abs=1e-6) and np.allclose(a.centroid, b.centroid)
    table.write.parquet(str(tmp_path / "m"))
    out = {r.event_id: r.cluster_id for r in mixture.assign_mixture(df, lay, stats, spark.read.parquet(str(tmp_path / "m"))).collect()}
    saved = table.orderBy("cluster_id").collect()
    params = {"m": np.array([r.centroid for r in saved]), "b": np.array([r.b for r in saved]),
              **{c: np.array([r[c] for r in saved]) for c in ("beta", "a", "log_pi")}}
    likely = mixture._log_weights(params, np.array([dense(r) for r in rows])).argmax(axis=1)
    assert [out[r[0]] for r in rows] == likely.tolist() and len(set(likely)) > 1


def test_kmeans_centroids_in_standardised_slots(spark, tmp_path):
    lay = encode.Layout((Role("c", "categorical", 3), Role("z", "numeric")))
    df = spark.createDataFrame([(f"e{i}", 1 + i % 2, float(i % 2) * 10) for i in range(40)], "event_id string, c int, z double")
    stats = nearest.freeze(encode.slot_stats(df, lay))
    rows = sorted(stats.collect(), key=lambda r: r["slot"])
    vectors = encode.sparse_vectors(df, lay, std=[r["std"] for r in rows])
    models, scores = clusters.kmeans_sweep(vectors, [2, 3], max_iter=5)
    assert {r["k"]: r["score"] for r in scores.collect()}[2] == pytest.approx(0, abs=1e-9)
    table = clusters.centroid_table(spark, models[2], [r["mean"] / r["std"] for r in rows], encode.slot_order(lay))
    assigned = nearest.assign_expanded(df, lay, stats, table)
    assert assigned.agg(F.max("dist")).first()[0] == pytest.approx(0, abs=1e-6)
    models[2].write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml.clustering import KMeansModel

    assert len(KMeansModel.load(str(tmp_path / "model")).clusterCenters()) == 2


def test_grid_search_cells(spark):
    rng = np.random.default_rng(6)
    n = 100
    rows = []
    for i in range(n):
        split = "train" if i < 60 else "valid" if i < 80 else "test"
        news = rng.normal(size=4)
        p = rng.normal()
        rows.append(("S", 4, split, float(p), float(p + 2 * news[0] + 0.1 * rng.normal()), news.tolist()))
    panel = spark.createDataFrame(rows, "symbol string, k int, split string, price double, y double, news array<double>")
    got = {r["n"]: r for r in grid.grid_search(panel, ["price"], "y", [2, None]).collect()}
    assert set(got) == {2, None} and got[None]["r2_test"] > 0.95
    assert got[None]["improvement"] > 0.3 and got[None]["num_days"] == n
    assert got[2]["baseline_r2_train"] == pytest.approx(got[None]["baseline_r2_train"])


@pytest.fixture(scope="module")
def ring(spark):
    """Label 1 inside a circle: only non-linear kernels separate it."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, size=(300, 2))
    rows = [(Vectors.dense(v), float((v ** 2).sum() < 0.6), "train" if i < 180 else "valid" if i < 240 else "test") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["features", "label", "split"]).cache()


def test_svm_kernels(ring):
    table, (kernel, _) = classify.svm_grid(ring, ["linear", "poly", "rbf"], [10.0], max_iter=20)
    got = {r["kernel"]: r["test_acc"] for r in table.collect()}
    assert got["poly"] > 0.9 and got["rbf"] > 0.85 and got["linear"] < got["poly"]
    assert kernel in ("poly", "rbf")


def test_logistic_grid(spark, ring):
    line = ring.withColumn("label", (F.element_at(classify.vector_to_array("features"), 1) > 0).cast("double"))
    table, model = classify.logistic_grid(line, ["l1", "l2"], [0.01, 10.0], max_iter=20)
    best = table.filter("best").first()
    assert best["valid_acc"] > 0.95 and table.filter("best").count() == 1
    assert classify.probability(model.transform(line)).filter("prob < 0 or prob > 1").count() == 0


def test_pca_by_variance(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 1)) @ np.ones((1, 4)) * 5 + 0.01 * rng.normal(size=(100, 4)) + 100
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x], ["features"])
    model = linear.fit_pca(df, variance=0.95)
    out = [r["pca"] for r in model.transform(df).collect()]
    assert out[0].size == 1 and abs(np.mean([v[0] for v in out])) < 1e-6


def test_lasso_picks_the_true_column(spark, data):
    a, b, _ = data
    df = classify.assemble(frame(spark, {"a": a, "b": b, "label": 2 * a}), ["a", "b"])
    table, model = linear.lasso_cv(df, [0.01, 5.0], 2)
    assert table.filter("best").first()["lambda"] == 0.01
    assert model.coefficients[0] > 1.5 and abs(model.coefficients[1]) < 0.05
