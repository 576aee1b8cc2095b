"""Surrogates of several kinds and their errors, exponents and dimensions, fits of realistic nulls: kernels on series of bounded length, dealt by cell and replicate.

Rows only: the tests hold each against known answers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.kernels import surrogates as G
from sedge.kernels import fits as K
from sedge.operators import series_tests as T
from sedge.plans.base import CELL, totals
from sedge.plans.registry import query

REPLICATES = 19


def kinds_of(x: np.ndarray, rng: np.random.Generator) -> dict[str, float]:
    """Errors of one surrogate of each kind of a series."""
    made = {"phases": G.phase_randomised(x, rng), "ranks": G.amplitude_adjusted(x, rng), "years": G.years_dealt(x, rng), "wet": G.wet_shuffled(x, rng), "dither": G.dithered(x, rng)}
    out = {f"{k}_spectral_error": G.spectral_error(x, y) for k, y in made.items()}
    return out | {f"{k}_keeps_values": float(np.allclose(np.sort(x), np.sort(y), atol=2e-6)) for k, y in made.items()}


@query("surrogate_kind_errors")
def surrogate_kind_errors(spark, sf_dir):
    """Spectral errors of surrogates by phases, ranks, whole years, wet amounts, and of dithering: mean and greatest over 19 of each."""
    # what is made of a series here is its errors already; the series itself has none
    rows = T.replicate_values(totals(spark, sf_dir), CELL, "day", "x", lambda made: made if isinstance(made, dict) else {}, REPLICATES, 3, kinds_of)
    return rows.where("replicate > 0").groupBy(*CELL, "descriptor").agg(F.avg("value").alias("mean"), F.max("value").alias("greatest"), F.count("value").alias("n"), F.max("error").alias("error"))


@query("exponents_and_dimension_cells")
def exponents_and_dimension_cells(spark, sf_dir):
    """Divergence curve (its ends), its slope and r squared, quantiles of pair distances, the radius of a recurrence rate, the correlation dimension in three to five dimensions."""

    def measure(x: np.ndarray) -> dict[str, float]:
        z = (x - x.mean()) / x.std()
        v = D.delay_vectors(z, 3, 1)
        curve = D.divergence(z, 3, 1, 7, 12)
        slope, r2 = D.lyapunov(z, 3, 1, 7, 12, (0, 6))
        q = D.distance_quantiles(v, 7, (0.01, 0.02, 0.05, 0.1))
        return {"curve_start": float(curve[0]), "curve_end": float(curve[-1]), "exponent": slope, "r2": r2, **{f"distance_{n}": float(d) for n, d in zip((1, 2, 5, 10), q, strict=True)}, "recurrence_radius": D.recurrence_radius(v, 0.05, 7), **{f"dimension_{m}": D.correlation_dimension(z, m, 1, 7) for m in (3, 4, 5)}}

    names = ["curve_start", "curve_end", "exponent", "r2", *(f"distance_{n}" for n in (1, 2, 5, 10)), "recurrence_radius", "dimension_3", "dimension_4", "dimension_5"]
    return T.per_series(totals(spark, sf_dir), CELL, "day", ["x"], measure, names)


@query("realistic_null_fits")
def realistic_null_fits(spark, sf_dir):
    """What the realistic nulls need of each cell: lag-one correlation over all and by quarter, trend, the regimes around the median, GARCH parameters."""

    def measure(x: np.ndarray) -> dict[str, float]:
        fit = K.realistic_fit(x)
        low, high = fit["regimes"]
        return {"phi": fit["phi"], **{f"phi_q{k + 1}": v for k, v in enumerate(fit["by_quarter"])}, "slope": fit["slope"], "alpha": fit["alpha"], "beta": fit["beta"], "phi_low": low[1], "phi_high": high[1], "threshold": fit["threshold"]}

    names = ["phi", *(f"phi_q{k}" for k in range(1, 5)), "slope", "alpha", "beta", "phi_low", "phi_high", "threshold"]
    return T.per_series(totals(spark, sf_dir), CELL, "day", ["x"], measure, names)
