"""Fits of seasonal stochastic models to a daily series. numpy only."""

from __future__ import annotations

import numpy as np

YEAR = 365


def realistic_fit(x: np.ndarray, period: int = YEAR) -> dict:
    """What the realistic nulls need of a daily series: deviation by day of the period, lag-one correlation over all and by season, trend, the two regimes around the median, and a GARCH fit of the residuals."""
    from sedge.kernels.estimators import garch, threshold_ar

    t = np.arange(len(x))
    day = t % period
    mean = np.bincount(day, x, period) / np.maximum(1, np.bincount(day, minlength=period))
    slope, base = np.polyfit(t, x - mean[day], 1)
    rest = x - mean[day] - base - slope * t
    sd = np.sqrt(np.bincount(day, rest**2, period) / np.maximum(1, np.bincount(day, minlength=period)))
    sd = np.where(sd > 0, sd, rest.std())
    z = rest / sd[day]
    quarter = (4 * day) // period
    phi = float(np.corrcoef(z[:-1], z[1:])[0, 1])
    by_quarter = [float(np.corrcoef(z[:-1][q], z[1:][q])[0, 1]) if (q := quarter[1:] == k).sum() > 2 else phi for k in range(4)]
    alpha, beta = garch(z[1:] - phi * z[:-1])
    return {"mean": mean, "sd": sd, "slope": float(slope), "base": float(base), "phi": phi, "by_quarter": by_quarter, "regimes": threshold_ar(z), "threshold": float(np.median(z)), "alpha": float(alpha), "beta": float(beta)}
