"""Polygons, areas covered, exact intervals of rates, further estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sedge.kernels import estimators as E
from sedge.kernels import special as P
from sedge.operators import polygons as G
from sedge.operators import series_tests as T
from sedge.plans.base import CELL, r6, totals
from sedge.plans.registry import query
from sedge.plans.statistics import _GRID, _grid
from sedge.sources.tables import read


def _zones(spark, sf_dir):
    """A box for each region, partly over each other."""
    k = F.col("r_regionkey").cast("double")
    corner = lambda dy, dx: F.struct((k * 0.4 + dx).alias("x"), (k * 0.35 + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.0, 0.9), corner(0.8, 0.9), corner(0.8, 0.0))
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("polygon"), ring.alias("ring"))


_BOX = "b AS (SELECT r_regionkey AS polygon, r_regionkey * 0.35::DOUBLE AS s, r_regionkey * 0.4::DOUBLE AS w FROM region)"


@query("points_in_polygons", f"WITH {_GRID}, {_BOX} SELECT polygon, count(*) AS points, round(sum(x), 4) + 0.0 AS total FROM g JOIN b ON lat + 0.01 > s AND lat + 0.01 < s + 0.8 AND lon + 0.01 > w AND lon + 0.01 < w + 0.9 GROUP BY 1")
def points_in_polygons(spark, sf_dir):
    """Points joined to the polygons they are in."""
    pts = _grid(spark, sf_dir).withColumn("lat", F.col("lat") + 0.01).withColumn("lon", F.col("lon") + 0.01)
    return G.points_in_polygons(pts, _zones(spark, sf_dir), "lat", "lon").groupBy("polygon").agg(F.count(F.lit(1)).alias("points"), (F.round(F.sum("x"), 4) + F.lit(0.0)).alias("total"))


@query("polygon_cell_areas", f"""WITH {_BOX}, c AS (SELECT i, j FROM (SELECT unnest(range(0, 20)) AS i) CROSS JOIN (SELECT unnest(range(0, 20)) AS j)), a AS (SELECT polygon, i, j, greatest(least(s + 0.8, (i + 1) * 0.25) - greatest(s, i * 0.25), 0) * greatest(least(w + 0.9, (j + 1) * 0.25) - greatest(w, j * 0.25), 0) AS area FROM b CROSS JOIN c)
    SELECT polygon, i, j, round(area, 6) + 0.0 AS area FROM a WHERE area > 1e-9""")
def polygon_cell_areas(spark, sf_dir):
    """Areas of polygons by cell."""
    return G.polygon_cell_areas(_zones(spark, sf_dir), 0.25).where("area > 1e-9").select("polygon", "i", "j", r6("area", "area"))


@query("covered_area_without_overlap")
def covered_area_without_overlap(spark, sf_dir):
    """Area covered by any polygon, by cell."""
    return G.covered_cell_areas(_zones(spark, sf_dir), 0.25).select("i", "j", r6("area", "area"))


@query("rates_with_exact_intervals")
def rates_with_exact_intervals(spark, sf_dir):
    """Shares by group with Clopper-Pearson bounds and a reading against a limit; groups are few."""
    g = read(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]).groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("k"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        for pdf in batches:
            pdf["lo"], pdf["hi"] = zip(*(P.exact_interval(int(k), int(n)) for k, n in zip(pdf.k, pdf.n, strict=True)), strict=True) if len(pdf) else ([], [])
            pdf["reading"] = [P.reading(int(k), int(n), 0.3) for k, n in zip(pdf.k, pdf.n, strict=True)]
            yield pdf

    return g.mapInPandas(run, "grp string, k long, n long, lo double, hi double, reading string")


@query("stationarity_cells")
def stationarity_cells(spark, sf_dir):
    """Unit-root and level statistics and threshold fits of each cell."""

    def measure(x: np.ndarray) -> dict[str, float]:
        low, high = E.threshold_ar(x)
        return {"dickey_fuller": E.dickey_fuller(x), "level": E.level_stationarity(x), "slope_low": low[1], "slope_high": high[1]}

    return T.per_series(totals(spark, sf_dir), CELL, "day", ["x"], measure, ["dickey_fuller", "level", "slope_low", "slope_high"])


@query("wolf_kantz_cao_cells")
def wolf_kantz_cao_cells(spark, sf_dir):
    """Further estimators of each cell's series."""

    def measure(x: np.ndarray) -> dict[str, float]:
        e1, e2 = E.cao(x, 4, 1, 7)
        out = {"cao_dimension": float(E.cao_dimension(e1)), "cao_random": float(np.abs(1 - e2).max())}
        for share, (slope, used) in zip((1, 2, 5, 10), E.kantz(x, 3, 1, 7), strict=True):
            out |= {f"kantz_{share}": slope, f"kantz_{share}_points": float(used)}
        return out | {f"wolf_{k}": v for k, v in E.wolf(x, 3, 1, 7).items()}

    names = ["cao_dimension", "cao_random", *(f"kantz_{s}{e}" for s in (1, 2, 5, 10) for e in ("", "_points")), *(f"wolf_{k}" for k in ("exponent", "steps", "asked", "made", "angle"))]
    return T.per_series(totals(spark, sf_dir), CELL, "day", ["x"], measure, names)
