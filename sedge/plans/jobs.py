"""Batches of numerical kernels over cells: rows-only, held against known answers in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.kernels import surrogates as G
from sedge.operators import inference as I
from sedge.operators import series_tests as T
from sedge.plans.base import CELL, totals
from sedge.plans.registry import query


@query("surrogate_suite_cells")
def surrogate_suite_cells(spark, sf_dir):
    """Descriptors of each cell against amplitude-adjusted surrogates."""
    return T.suite(totals(spark, sf_dir), CELL, "day", "x", replicates=39, prepare=T.embedding)


@query("surrogate_suite_families")
def surrogate_suite_families(spark, sf_dir):
    """The suite's p values adjusted within each descriptor."""
    rows = T.suite(totals(spark, sf_dir), CELL, "day", "x", lambda x: dict(zip(("entropy", "complexity"), D.entropy_complexity(D.ordinal_counts(x, 3)), strict=True)), 39)
    return I.adjusted(rows.select("cell", "descriptor", "observed", "z", "pvalue"), ["descriptor"], "pvalue").withColumn("rejects", F.col("bh") <= 0.05 + 1e-9)


@query("ft_surrogate_asymmetry")
def ft_surrogate_asymmetry(spark, sf_dir):
    """Asymmetry against phase-randomised surrogates."""
    return T.suite(totals(spark, sf_dir), CELL, "day", "x", lambda x: {"asymmetry": D.reversal_asymmetry(x, 2)}, 99, make=G.phase_randomised)


@query("ews_trend_test")
def ews_trend_test(spark, sf_dir):
    """Kendall trends of rolling variance and autocorrelation of the detrended series."""

    def measure(x: np.ndarray) -> dict[str, float]:
        r = D.gaussian_detrended(x, 365)
        w = len(r) // 2
        parts = np.lib.stride_tricks.sliding_window_view(r, w)
        a, b = parts[:, :-1] - parts[:, :-1].mean(1, keepdims=True), parts[:, 1:] - parts[:, 1:].mean(1, keepdims=True)
        ar = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        return {"variance_trend": D.kendall(parts.var(1, ddof=1)), "ar1_trend": D.kendall(ar)}

    return T.suite(totals(spark, sf_dir), CELL, "day", "x", measure, 39, side="greater")


@query("smap_gain_cells")
def smap_gain_cells(spark, sf_dir):
    """Gain of locally weighted over linear forecasts."""
    return T.per_series(totals(spark, sf_dir), CELL, "day", ["x"], lambda x: D.forecast_gain(x, 3, 1, 7, every=1), ["theta", "linear", "nonlinear", "gain"])


@query("ccm_pairs")
def ccm_pairs(spark, sf_dir):
    """Cross mapping between pairs of cells, by library size, both ways."""
    s = totals(spark, sf_dir)
    pairs = s.select(F.col("cell").alias("a"), "day", F.col("x").alias("xa")).join(s.select(F.col("cell").alias("b"), "day", F.col("x").alias("xb")), "day").where("a < b").withColumn("pair", F.concat_ws("-", "a", "b"))

    def skill(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
        return {"a_from_b_100": D.cross_map(y, x, 3, 1, 7, 100), "a_from_b": D.cross_map(y, x, 3, 1, 7), "b_from_a_100": D.cross_map(x, y, 3, 1, 7, 100), "b_from_a": D.cross_map(x, y, 3, 1, 7)}

    return T.per_series(pairs, ["pair"], "day", ["xa", "xb"], skill, ["a_from_b_100", "a_from_b", "b_from_a_100", "b_from_a"])
