"""Forecasts at several horizons against the definition in numpy."""

import math

import numpy as np
import pytest

from sedge.operators import forecasts as P


def by_hand(x, dims, theiler):
    now = np.arange(dims - 1, len(x) - 7)
    v = np.column_stack([x[now - (dims - 1) + j] for j in range(dims)])
    y = np.column_stack([x[now + h] for h in (1, 3, 7)])
    cut = int(0.6 * len(x))
    lib, test = now + 7 < cut, now >= cut

    def guess(at, theta, mask):
        out = []
        for q, ok in zip(at, mask, strict=True):
            d = np.sqrt(((v[lib] - q) ** 2).sum(1))
            w = np.where(ok, np.exp(-theta * d / d[ok].mean()), 0)
            a = np.column_stack([np.ones(lib.sum()), v[lib]])
            out.append(np.r_[1, q] @ np.linalg.solve(a.T @ (a * w[:, None]) + 1e-8 * np.eye(dims + 1), a.T @ (y[lib] * w[:, None])))
        return np.array(out)

    apart = np.abs(now[lib][:, None] - now[lib][None, :]) > theiler
    fit = {t: np.sqrt(((guess(v[lib], t, apart) - y[lib]) ** 2).mean(0)) for t in P.THETAS}
    free = np.ones((test.sum(), lib.sum()), bool)
    out = {}
    for k, h in enumerate((1, 3, 7)):
        theta = min(P.THETAS, key=lambda t: (fit[t][k], t))
        e, e0 = ((y[test] - guess(v[test], t, free))[:, k] for t in (theta, 0.0))
        d = e0**2 - e**2
        c = d - d.mean()
        var = (c @ c + 2 * sum(c[i:] @ c[:-i] for i in range(1, h))) / len(c)
        dm = d.mean() / math.sqrt((var if var > 0 else c @ c / len(c)) / len(c))
        out[h] = (theta, np.sqrt((e**2).mean()), np.sqrt((e0**2).mean()), np.sqrt(((y[test][:, k] - x[now[test]]) ** 2).mean()), dm, 0.5 * math.erfc(dm / math.sqrt(2)))
    return out


def test_gains_by_horizon(spark):
    x = [0.4]
    for _ in range(159):
        x.append(3.8 * x[-1] * (1 - x[-1]))
    x = np.array(x)
    rows = [("map", i, float(v)) for i, v in enumerate(x)] + [("short", i, float(v)) for i, v in enumerate(x[:12])] + [("gap", i, None if i == 5 else float(v)) for i, v in enumerate(x)] + [("flat", i, 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "cell string, t int, x double")
    got = {(r.cell, r.horizon): r for r in P.horizon_gains(P.forecast_errors(df, ["cell"], "t", "x", 2, 1, 3, rows=50), ["cell"]).collect()}
    assert set(got) == {("map", 1), ("map", 3), ("map", 7), ("short", 0), ("gap", 0), ("flat", 0)} and got["gap", 0].gain is None
    for h, (theta, rmse, linear, step, dm, p) in by_hand(x, 2, 3).items():
        r = got["map", h]
        assert r.theta == theta and r.rmse_step == pytest.approx(step)
        assert r.rmse == pytest.approx(rmse, rel=1e-7) and r.rmse_linear == pytest.approx(linear, rel=1e-7)
        if theta > 0:
            assert r.dm == pytest.approx(dm, rel=1e-6) and r.p == pytest.approx(p, rel=1e-5)
    assert got["map", 1].gain > 0.5
    none = spark.createDataFrame([], "cell string, t int, x double")
    assert P.horizon_gains(P.forecast_errors(none, ["cell"], "t", "x", 2, 1, 3), ["cell"]).count() == 0
