"""Summaries of tests against definitions worked out in numpy."""

import math

import numpy as np
import pytest

from sedge.operators import diagnostics as G
from sedge.operators import inference as I
from sedge.operators import summaries as M


def test_verdict_takes_the_hardest_setting(spark):
    rows = [("a", "p1", "positive", 10, 0.2, 0.9), ("a", "p2", "positive", 10, 0.2, 0.8), ("a", "s", "size", 10, 0.2, 0.2), ("a", "s", "size", 5, 0.0, 0.9), ("b", "p1", "positive", 10, 0.2, 1.0), ("b", "p2", "positive", 10, 0.2, 0.7), ("c", "p1", "positive", 10, 0.2, 1.0), ("c", "p2", "positive", 10, 0.2, 1.0), ("c", "s", "size", 10, 0.2, 0.21)]
    rates = spark.createDataFrame(rows, "descriptor string, control string, role string, n int, noise double, rate double")
    got = {r.descriptor: (r.powered, r.passed) for r in M.gate_verdict(rates, 0.8, 0.2, 2).collect()}
    assert got == {"a": (2, True), "b": (1, False), "c": (2, False)}


def test_normal_tail(spark):
    z = [0.0, 0.1, -1.0, 1.959963984540054, 4.0, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").selectExpr("z", f"{M.two_sided_normal_sql('z')} as p").collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-6) for r in got)


def test_permutations_without_draws_and_by_hand(spark):
    rng = np.random.default_rng(3)
    gains = rng.normal(size=(5, 12))
    gains[:, 0] += 2
    rows = [("g", c, d, float(gains[c, d])) for c in range(5) for d in range(12)] + [("h", 9, 0, 1.0)]
    out = {r.k: r for r in M.permutation_summary(spark.createDataFrame(rows, "k string, cell int, draw int, gain double"), ["k"]).collect()}
    null = gains[:, 1:]
    share = np.mean(gains[:, 0] > np.quantile(null, 0.95, axis=1))
    shares = [np.mean(null[:, s] > np.quantile(np.delete(null, s, 1), 0.95, axis=1)) for s in range(11)]
    medians = np.median(null, axis=0)
    assert out["g"].gain_median == pytest.approx(np.median(gains[:, 0])) and out["g"].null_median == pytest.approx(np.median(medians))
    assert out["g"].p == pytest.approx((1 + np.sum(medians >= np.median(gains[:, 0]))) / 12)
    assert out["g"].cells_beyond == pytest.approx(share) and out["g"].p_beyond == pytest.approx((1 + np.sum(np.array(shares) >= share)) / 12)
    assert out["h"].cells == 1 and out["h"].null_median is None


def test_autocorrelation_widens_a_trend(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.cumsum(rng.normal(size=30)), 3)
    t = np.arange(30.0)
    slope = np.median([(x[j] - x[i]) / (j - i) for i in range(30) for j in range(i + 1, 30)])
    left = np.round(x - slope * t, 9)
    c = np.array([(left < v).sum() + ((left == v).sum() + 1) / 2 for v in left]) - 15.5
    total = 0.0
    for k in range(1, 28):
        rho = (c[:-k] * c[k:]).sum() / (c * c).sum()
        total += (30 - k) * (29 - k) * (28 - k) * rho if abs(rho) > I.Z95 / math.sqrt(30) else 0
    rows = [("walk", float(a), float(b)) for a, b in zip(t, x, strict=True)] + [("flat", float(i), 1.0) for i in range(10)] + [("short", 0.0, 1.0), ("gap", 0.0, None), ("gap", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "cell string, t double, x double")
    got = {r.cell: r for r in I.autocorrelated_trend(df, ["cell"], "t", "x").collect()}
    assert got["walk"].ratio == pytest.approx(max(1 + 2 * total / (30 * 29 * 28), 1e-6)) and got["walk"].slope == pytest.approx(slope)
    assert got["flat"].ratio == 1 and got["short"].ratio == 1
    field = {r.cell: r for r in M.trend_field(df.selectExpr("'f' as f", "*"), ["f"], "cell", "t", "x", 0.05).collect()}
    assert field["walk"].slope == pytest.approx(10 * slope) and field["flat"].p is None and not field["flat"].marked and field["short"].slope is None


def test_block_diagnostics_by_hand(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=70).cumsum() * 0.1 + rng.normal(size=70), 6)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("flat", i, 2.0) for i in range(9)], "cell string, t int, x double")
    got = {r.cell: r for r in G.block_diagnostics(df, ["cell"], "t", "x").collect()}
    t = np.linspace(0, 1, 70)
    design = np.column_stack([np.ones(70), t])
    beta = np.linalg.lstsq(design, x, rcond=None)[0]
    s = design * (x - design @ beta)[:, None]
    meat = s.T @ s + sum((1 - k / 15) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:]) for k in range(1, 15))
    bread = np.linalg.inv(design.T @ design)
    z = beta[1] / math.sqrt((bread @ meat @ bread)[1, 1])
    assert got["a"].change == pytest.approx(beta[1]) and got["a"].change_p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-5)
    parts = np.array_split(x, 4)
    acf = [((p - p.mean())[1:] * (p - p.mean())[:-1]).sum() / ((p - p.mean()) ** 2).sum() for p in parts]
    assert got["a"].deviation_ratio == pytest.approx(max(p.std() for p in parts) / min(p.std() for p in parts)) and got["a"].acf_range == pytest.approx(max(acf) - min(acf))
    assert got["a"].mean_range == pytest.approx((max(p.mean() for p in parts) - min(p.mean() for p in parts)) / x.std())
    sup = np.abs(np.cumsum(x - x.mean())).max() / math.sqrt(((x - x.mean()) ** 2).sum() / 69 * 70)
    assert got["a"].shift_p == pytest.approx(min(1, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * sup * sup) for k in range(1, 100))), abs=1e-9)
    assert got["flat"].change_p is None and got["flat"].shift_p is None and got["flat"].alerts == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "cell string, t int, x double")
    assert G.block_diagnostics(none, ["cell"], "t", "x").count() == 0 and I.autocorrelated_trend(none, ["cell"], "t", "x").count() == 0
