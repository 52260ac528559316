"""The fit in columns against the same fit written out with loops."""

import numpy as np
import pytest

from shelfwise.functions import penalised

SPLITS = penalised.SPLITS


def descend(x, y, alpha, rounds=20000):
    """Plain coordinate descent for |y - b - xw|^2 / 2n + alpha |w|_1."""
    xc, yc, w, n = x - x.mean(0), y - y.mean(), np.zeros(2), len(y)
    for _ in range(rounds):
        old = w.copy()
        for j in range(2):
            var = xc[:, j] @ xc[:, j] / n
            if var == 0:
                continue
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / var
        if np.abs(w - old).max() < 1e-13:
            break
    return w, y.mean() - x.mean(0) @ w


def brute(x, y, latest):
    """The cross-validated forecast written out with loops."""

    def folds(n):
        test = n // (SPLITS + 1)
        return [(n - (SPLITS - i) * test, n - (SPLITS - 1 - i) * test) for i in range(SPLITS)]

    def fit(xt, yt):
        mean, sd = xt.mean(0), xt.std(0)
        sd[sd == 0] = 1
        z = (xt - mean) / sd
        loss = {}
        for alpha in penalised.ALPHAS[::-1]:
            per = []
            for a, b in folds(len(yt)):
                w, c = descend(z[:a], yt[:a], alpha)
                per.append(((z[a:b] @ w + c - yt[a:b]) ** 2).mean())
            loss[alpha] = np.mean(per)
        best = min(loss, key=lambda a: (loss[a], -a))
        w, c = descend(z, yt, best)
        return best, lambda q: (q - mean) / sd @ w + c

    maes, bases = [], []
    for a, b in folds(len(y)):
        if a < SPLITS + 1:
            continue
        _, predict = fit(x[:a], y[:a])
        maes.append(np.abs(predict(x[a:b]) - y[a:b]).mean())
        bases.append(np.abs(y[a - 1] - y[a:b]).mean())
    alpha, predict = fit(x, y)
    return alpha, np.mean(maes), np.mean(bases), predict(latest)


def evaluated(spark, series):
    rows = [(k, i, float(a), float(b), float(c)) for k, (x, y) in series.items() for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "name string, at int, x1 double, x2 double, y double")
    return {r["name"]: r for r in penalised.evaluated(penalised.numbered(df, ["name"], "at"), ["name"]).collect()}


def ahead(row, latest):
    f = row["fit"]
    return f["y_0"] + f["b"] + f["w1"] * (latest[0] - f["x1_0"]) + f["w2"] * (latest[1] - f["x2_0"])


def test_matches_loops(spark):
    series = {}
    for seed, n in [(0, 8), (1, 13), (2, 40)]:
        rng = np.random.default_rng(seed)
        price = 900 + np.cumsum(rng.normal(0, 3, n + 2))
        series[str(seed)] = (np.column_stack([price[:n], np.abs(rng.normal(0, 1, n))]), 0.7 * price[2:] + 0.3 * price[:n])
    got = evaluated(spark, series)
    for k, (x, y) in series.items():
        latest = np.array([y[-1], 0.5])
        alpha, mae, base, prediction = brute(x, y, latest)
        assert got[k]["fit"]["alpha"] == pytest.approx(alpha)
        assert got[k]["cv_mae"] == pytest.approx(mae, rel=1e-5)
        assert got[k]["baseline_mae"] == pytest.approx(base, rel=1e-9)
        assert ahead(got[k], latest) == pytest.approx(prediction, rel=1e-7)


def test_optimality_short_flat_and_exact_series(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 2)) @ np.array([[1.0, 0.6], [0.0, 0.8]])
    y = x @ np.array([2.0, -0.5]) + rng.normal(0, 0.3, 50)
    line = np.column_stack([np.arange(30.0), np.zeros(30)])
    short = np.ones((5, 2))
    got = evaluated(
        spark,
        {"free": (x, y), "line": (line, np.arange(30.0) + 2), "flat": (np.full((20, 2), 5.1), np.full(20, 5.1)), "short": (short, short[:, 0])},
    )
    fit, sd = got["free"]["fit"], x.std(0)
    w, xc, yc = np.array([fit["w1"], fit["w2"]]), (x - x.mean(0)) / sd, y - y.mean()
    pull = xc.T @ (yc - xc @ (w * sd)) / 50
    for j in range(2):
        if w[j] != 0:
            assert pull[j] == pytest.approx(fit["alpha"] * np.sign(w[j]), abs=1e-9)
        else:
            assert abs(pull[j]) <= fit["alpha"] + 1e-9
    assert ahead(got["line"], (30.0, 0.0)) == pytest.approx(32, abs=0.01)
    assert ahead(got["flat"], (5.1, 5.1)) == 5.1 and got["flat"]["cv_mae"] == 0 and got["flat"]["cv_r2"] == 1
    assert "short" not in got
