"""Moving-window ARMA and lasso against planted models and plain solvers."""

import datetime

import numpy as np
import pytest

from newsquant.operators import arma, lasso

DAY = datetime.date(2000, 1, 1)


def table(spark, values, columns=()):
    """One row per day and symbol from (symbol, y, x...) arrays."""
    rows = [(s, DAY + datetime.timedelta(i), float(v), *map(float, x)) for s, ys, xs in values for i, (v, x) in enumerate(zip(ys, xs, strict=True))]
    return spark.createDataFrame(rows, "symbol string, day date, y double" + "".join(f", {c} double" for c in columns))


def simulate(rng, n, phi, theta, c=0.3, beta=0.0):
    e, x, y = rng.normal(size=n), rng.normal(size=n), np.zeros(n)
    for t in range(1, n):
        y[t] = c + phi * y[t - 1] + theta * e[t - 1] + beta * x[t] + e[t]
    return y, x[:, None]


def plain_sse(y, c, phi, theta):
    e = 0.0
    total = 0.0
    for t in range(1, len(y)):
        e = y[t] - c - phi * y[t - 1] - theta * e
        total += e * e
    return total


@pytest.mark.parametrize(("phi", "theta"), [(0.5, 0.4), (0.0, -0.6), (-0.7, 0.0)])
def test_planted_coefficients_are_found(phi, theta):
    y, x = simulate(np.random.default_rng(1), 6000, phi, theta, beta=2.0)
    coef, _, sse = arma.fit_windows(y[None], x[None], 1, 1)
    c, p, b, q = coef[0]
    assert (b, sse[0] / len(y)) == pytest.approx((2.0, 1.0), abs=0.06)
    assert p + q == pytest.approx(phi + theta, abs=0.06) and c == pytest.approx(0.3, abs=0.06)
    if phi and theta:
        assert (p, q) == pytest.approx((phi, theta), abs=0.06)


def test_fit_is_the_least_of_the_neighbourhood():
    y, _ = simulate(np.random.default_rng(2), 400, 0.4, 0.5)
    coef, _, sse = arma.fit_windows(y[None], np.zeros((1, 400, 0)), 1, 1)
    c, p, q = coef[0]
    assert sse[0] == pytest.approx(plain_sse(y, c, p, q))
    for d in (-1e-3, 1e-3):
        assert min(plain_sse(y, c + d, p, q), plain_sse(y, c, p + d, q), plain_sse(y, c, p, q + d)) >= sse[0]


def test_windows_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    ys, xs = zip(*[simulate(rng, 160, 0.3, 0.4, beta=1.0) for _ in range(2)])
    df = table(spark, zip("ab", ys, xs), ["x"])
    got = {(r.symbol, r.day): r for r in arma.arma_forecast(df, [1], [1], 120, "y", ["x"]).collect()}
    assert len(got) == 2 * 40
    for s, y, x in zip("ab", ys, xs):
        for t in (120, 143, 159):
            coef, e, sse = arma.fit_windows(y[None, t - 120:t], x[None, t - 120:t], 1, 1)
            c, p, b, q = coef[0]
            r = got[s, DAY + datetime.timedelta(t)]
            assert r.mean == pytest.approx(c + p * y[t - 1] + b * x[t, 0] + q * e[0, -1], abs=1e-5)
            assert r.hi - r.lo == pytest.approx(2 * 1.96 * np.sqrt(sse[0] / (119 - 4)), rel=1e-5)


def test_order_is_chosen_once_and_intervals_cover(spark):
    y, x = simulate(np.random.default_rng(4), 900, 0.0, 0.8)
    out = arma.arma_forecast(table(spark, [("a", y, x * 0)], ["x"]), [0, 1], [0, 1], 300, "y").collect()
    assert {(r.p, r.q) for r in out} == {(0, 1)} and len(out) == 600
    assert 0.92 < np.mean([r.lo <= r.actual <= r.hi for r in out]) < 0.98
    errors = np.array([r.actual - r.mean for r in out])
    assert errors.var() < 1.15  # the innovations have variance 1, the series 1.64


def test_odd_series(spark):
    short = ("s", np.arange(5.0), np.zeros((5, 1)))
    flat = ("f", np.full(30, 2.0), np.zeros((30, 1)))
    df = table(spark, [short, flat], ["x"])
    out = arma.arma_forecast(df, [1], [1], 20, "y").collect()
    assert {r.symbol for r in out} == {"f"} and all(r.mean == pytest.approx(2.0, abs=1e-6) for r in out)
    assert arma.arma_forecast(df.limit(0), [1], [1], 20, "y").count() == 0
    assert lasso.lasso_forecast(df.limit(0), ["x"], "y", 20, [0.1]).count() == 0
    out = lasso.lasso_forecast(df, ["x"], "y", 20, [0.1], folds=2).collect()
    assert {(r.symbol, r.pred, r.nonzero, r.best) for r in out} == {("f", 2.0, 0, True)}


def subgradient(x, y, lam, slope, cut):
    """Largest break of the lasso's conditions on standardised data."""
    sx, sy = x.std(axis=0), y.std()
    sx = np.where(sx > 1e-9, sx, np.inf)
    z = (x - x.mean(axis=0)) / sx
    pull = z.T @ (y - cut - x @ slope) / len(y) / sy
    on = slope != 0
    return max(np.abs(pull[on] - lam * np.sign(slope[on])).max(initial=0), (np.abs(pull[~on]) - lam).max(initial=0))


def test_every_window_meets_the_conditions_of_the_minimum():
    rng = np.random.default_rng(5)
    n, window = 420, 60
    factor = rng.normal(size=(n, 4))
    x = np.column_stack([factor @ rng.normal(size=(4, 20)) + 0.3 * rng.normal(size=(n, 20)), np.full(n, 7.0)])
    x[:, 3] = x[:, 2]  # two equal columns
    y = x[:, 0] - 0.5 * x[:, 5] + rng.normal(size=n)
    rows = np.column_stack([np.ones(n), x, y])
    lambdas = [0.02, 0.3, 0.1]
    corr, mean, sd = lasso.correlations(lasso.products(rows, window))
    cut, slope = lasso._raw(lasso.path(corr, lambdas), mean, sd)
    for w in range(0, n - window, 7):
        for i, lam in enumerate(lambdas):
            assert subgradient(x[w:w + window], y[w:w + window], lam, slope[w, i], cut[w, i]) < 1e-6
    assert (np.abs(slope[:, 1]) > 0).sum() < (np.abs(slope[:, 0]) > 0).sum()


def test_folds_follow_in_time():
    rng = np.random.default_rng(6)
    x, n, window = rng.normal(size=(90, 3)), 90, 40
    y = x[:, 0] + 0.1 * rng.normal(size=n)
    rows = np.column_stack([np.ones(n), x, y])
    lambdas = [0.5, 0.05]
    got = lasso.fold_errors(rows, window, 3, lambdas, slice(0, n - window))
    for w in (0, 20, n - window - 1):
        want = np.zeros(2)
        for train in (10, 20, 30):
            learn, held = rows[w:w + train], rows[w + train:w + train + 10]
            corr, mean, sd = lasso.correlations((learn.T @ learn)[None])
            cut, slope = lasso._raw(lasso.path(corr, lambdas), mean, sd)
            for i in range(2):
                want[i] += ((held[:, -1] - cut[0, i] - held[:, 1:-1] @ slope[0, i]) ** 2).sum()
        assert got[w] == pytest.approx(want, rel=1e-8)


def test_sparse_truth_is_kept(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    y = 2 * x[:, 2] + 0.2 * rng.normal(size=300)
    columns = [f"x{i}" for i in range(6)]
    out = lasso.lasso_forecast(table(spark, [("a", y, x)], columns), columns, "y", 100, [0.9, 0.1], folds=3).toPandas()
    assert len(out) == 400 and set(out[out.penalty == 0.1].nonzero) <= {1, 2, 3}
    assert out[out.best].penalty.eq(0.1).all()
    assert (out[out.best].pred - out[out.best].actual).abs().mean() < 0.4
