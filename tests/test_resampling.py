"""Draws, permutations, surrogates of several kinds, and what gaps give."""

import numpy as np
import pandas as pd
import pytest

from sedge.kernels import dynamics as D
from sedge.kernels import surrogates as G
from sedge.kernels import fits
from tests import controls as K
from sedge.operators import resampling as B
from sedge.operators import series_tests as T
from sedge.plans import surrogate_jobs as J


def test_every_draw_takes_as_many_clusters_as_there_are(spark):
    clusters = spark.createDataFrame([("a", k) for k in range(7)] + [("b", k) for k in (3, 9)], "grp string, cell long")
    got = B.picks(clusters, "cell", 40, "s", ["grp"]).toPandas()
    assert (got.groupby(["grp", "draw"]).times.sum() == got.groupby(["grp", "draw"]).grp.first().map({"a": 7, "b": 2})).all()
    assert set(got[got.grp == "b"].cell) == {3, 9} and got[got.grp == "a"].cell.nunique() == 7
    again = B.picks(clusters.orderBy("cell", ascending=False), "cell", 40, "s", ["grp"]).toPandas()
    key = ["grp", "draw", "cell", "times"]
    assert (got.sort_values(key)[key].to_numpy() == again.sort_values(key)[key].to_numpy()).all()


def test_interval_of_resampled_means_by_hand(spark):
    sums = pd.DataFrame({"cell": range(6), "n": [2, 1, 4, 3, 2, 2], "s": [1.0, 9.0, -2.0, 5.0, 0.5, 3.0]})
    draws = B.resampled(spark.createDataFrame(sums), "cell", ["n", "s"], 200, "x")
    got = draws.toPandas().set_index("draw")
    taken = B.picks(spark.createDataFrame(sums[["cell"]]), "cell", 200, "x").toPandas()
    for draw, part in taken.groupby("draw"):
        weights = part.set_index("cell").times.reindex(range(6), fill_value=0).to_numpy()
        assert got.n[draw] == (weights * sums.n).sum() and abs(got.s[draw] - (weights * sums.s).sum()) < 1e-9
    means = (got.s / got.n)[got.index >= 0]
    row = B.interval(draws.selectExpr("draw", "s / n as v"), [], "v").first()
    assert abs(row["estimate"] - sums.s.sum() / sums.n.sum()) < 1e-12 and row["draws"] == 200
    assert np.allclose([row["lo"], row["hi"]], np.quantile(means, [0.025, 0.975]))
    assert abs(row["p"] - min(1, 2 * (min((means <= 0).sum(), (means >= 0).sum()) + 1) / 201)) < 1e-12


def test_permuted_values_are_the_same_values(spark):
    cells = spark.createDataFrame([(k, k * k / 3) for k in range(11)], "k long, x double")
    got = B.permuted(cells, "k", "x", 25, "p").toPandas()
    for _, part in got.groupby("draw"):
        assert sorted(part.x) == [k * k / 3 for k in range(11)] and part.k.nunique() == 11
    assert (got[got.draw == 3].sort_values("k").x.to_numpy() != got[got.draw == 4].sort_values("k").x.to_numpy()).any()


def test_gaps_are_errors_and_not_spliced(spark):
    rows = [(c, d, None if c == "gap" and d == 40 else float((d * 37) % 11 + d % 3)) for c in ("gap", "whole") for d in range(90)]
    s = spark.createDataFrame(rows, "cell string, day int, x double")
    got = T.suite(s, ["cell"], "day", "x", lambda x: {"lag": D.reversal_asymmetry(x, 1)}, 9).toPandas().set_index("cell")
    assert got.descriptor["gap"] == "error" and "1 of 90" in got.error["gap"] and got.n["gap"] == 90 and pd.isna(got.pvalue["gap"])
    assert got.descriptor["whole"] == "lag" and got.n_null["whole"] == 9 and pd.isna(got.error["whole"])
    flat = T.per_series(s, ["cell"], "day", ["x"], lambda x: {"m": float(x.mean())}, ["m"]).toPandas().set_index("cell")
    assert pd.isna(flat.m["gap"]) and "missing" in flat.error["gap"] and flat.m["whole"] > 0


def test_suite_by_hand(spark):
    x = np.sin(np.arange(80) / 3.1) ** 3 + np.arange(80) % 7 / 20
    s = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "cell string, day int, x double")
    for side in ("greater", "less", "absolute", "two_sided"):
        row = T.suite(s, ["cell"], "day", "x", lambda v: {"a": D.reversal_asymmetry(v, 2)}, 19, 4, G.phase_randomised, side).first()
        null = np.array([D.reversal_asymmetry(G.phase_randomised(x, T.replicate_stream(T.seed_of(4, "c"), r)), 2) for r in range(1, 20)])
        assert abs(row["observed"] - D.reversal_asymmetry(x, 2)) < 1e-12 and abs(row["null_mean"] - null.mean()) < 1e-12
        assert abs(row["z"] - (row["observed"] - null.mean()) / null.std(ddof=1)) < 1e-9
        assert abs(row["pvalue"] - G.p_value(row["observed"], null, side)) < 1e-12


def test_aligned_phases_keep_values_and_cross_correlations():
    rng = np.random.default_rng(2)
    a = np.cumsum(rng.normal(size=600)) * 0.2 + np.sin(np.arange(600) / 9)
    x = np.column_stack([np.exp(a / 4), np.roll(a, 3) + rng.normal(size=600) / 5])
    y = G.aligned_phases(x, np.random.default_rng(1))
    apart = np.column_stack([G.amplitude_adjusted(c, np.random.default_rng(7 + i)) for i, c in enumerate(x.T)])
    assert (np.sort(y, axis=0) == np.sort(x, axis=0)).all()
    assert G.cross_errors(x, y)["cross_error"] < 0.5 * G.cross_errors(x, apart)["cross_error"]
    exact = G.cross_errors(x, G.shared_phases(x, rng), 0)
    assert exact["spectral_error"] < 1e-9 and exact["cross_error"] < 1e-9


def test_years_and_dither():
    x = np.arange(25.0)
    y = G.years_dealt(x, np.random.default_rng(3), 10)
    assert sorted(y[:20:10]) == [0, 10] and (np.diff(y[:10]) == 1).all() and (y[20:] == x[20:]).all()
    z = G.dithered(np.zeros(50), np.random.default_rng(3))
    assert len(set(z)) == 50 and 0 <= z.min() and z.max() < 1e-6


def test_realistic_fit_finds_what_made_the_series():
    rng = np.random.default_rng(5)
    n = 365 * 24
    t = np.arange(n)
    x = 10 + 4 * np.sin(2 * np.pi * t / 365) + 0.001 * t + (1 + 0.5 * np.cos(2 * np.pi * t / 365)) * K.ar1(n, 0.6, rng) * 0.8
    fit = fits.realistic_fit(x)
    assert abs(fit["phi"] - 0.6) < 0.05 and abs(fit["slope"] - 0.001) < 1e-4 and all(abs(q - 0.6) < 0.08 for q in fit["by_quarter"])
    assert abs(fit["mean"][91] - fit["mean"][273] - 8) < 1.5 and fit["alpha"] < 0.1


def test_exponents_of_a_table_of_chaos(spark, tmp_path):
    days = pd.date_range("2011-01-01", periods=900).date
    x = {"A": K.logistic(900), "B": np.random.default_rng(0).random(900)}
    pd.concat([pd.DataFrame({"l_returnflag": c, "l_shipdate": days, "l_quantity": v}) for c, v in x.items()]).to_parquet(tmp_path / "lineitem.parquet")
    got = J.exponents_and_dimension_cells(spark, str(tmp_path)).toPandas().set_index("cell")
    assert got.dimension_3["A"] < 1.4 < 2.2 < got.dimension_3["B"] and got.r2["A"] > 0.8
    assert (got.distance_1 < got.distance_10).all() and got.error.isna().all()
    z = (x["A"] - x["A"].mean()) / x["A"].std()
    curve = D.divergence(z, 3, 1, 7, 12)
    assert abs(got.curve_end["A"] - curve[-1]) < 1e-9
    errors = J.surrogate_kind_errors(spark, str(tmp_path)).toPandas().set_index(["cell", "descriptor"])
    assert errors.greatest[("A", "phases_spectral_error")] < 1e-9 and errors["mean"][("A", "ranks_keeps_values")] == 1 and errors.n.min() == 19
