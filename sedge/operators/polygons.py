"""Points and cells against polygons: both sides meet on grid squares, the exact test comes after."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.kernels import geometry


def _squares(polygons: DataFrame, step: float) -> DataFrame:
    """polygons (polygon, ring array<struct<x,y>>) once for each square of side step that its box meets."""
    side = lambda how, c: F.floor(F.expr(f"{how}(transform(ring, p -> p.{c}))") / step)
    box = polygons.select("polygon", "ring", side("array_min", "y").alias("i0"), side("array_max", "y").alias("i1"), side("array_min", "x").alias("j0"), side("array_max", "x").alias("j1"))
    return box.withColumn("_i", F.explode(F.sequence("i0", "i1"))).withColumn("_j", F.explode(F.sequence("j0", "j1"))).select("polygon", "ring", "_i", "_j")


def points_in_polygons(points: DataFrame, polygons: DataFrame, lat: str, lon: str, step: float = 0.25) -> DataFrame:
    """Points with each polygon they are in: the parity of the edges east of a point, as an expression on the ring."""
    keyed = points.withColumn("_i", F.floor(F.col(lat) / step)).withColumn("_j", F.floor(F.col(lon) / step))
    near = keyed.join(_squares(polygons, step), ["_i", "_j"])
    crossings = F.expr(f"size(filter(transform(ring, (p, k) -> named_struct('a', p, 'b', ring[(k + 1) % size(ring)])), e -> (e.a.y > {lat}) != (e.b.y > {lat}) and {lon} < e.a.x + ({lat} - e.a.y) * (e.b.x - e.a.x) / (e.b.y - e.a.y)))")
    return near.where(crossings % 2 == 1).drop("_i", "_j", "ring")


def polygon_cell_areas(polygons: DataFrame, step: float) -> DataFrame:
    """(polygon, i, j, area): the part of every polygon in every square of side step, in square degrees."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, ring, i, j in zip(pdf["polygon"], pdf["ring"], pdf["_i"], pdf["_j"], strict=True):
                pts = np.array([(p["x"], p["y"]) for p in ring])
                part = geometry.clip(pts, j * step, i * step, (j + 1) * step, (i + 1) * step)
                a = geometry.area(part) if len(part) >= 3 else 0.0
                if a > 0:
                    out.append((name, i, j, a))
            yield pd.DataFrame(out, columns=["polygon", "i", "j", "area"])

    kind = polygons.schema["polygon"].dataType.simpleString()
    return _squares(polygons, step).mapInPandas(run, f"polygon {kind}, i long, j long, area double")


def covered_cell_areas(polygons: DataFrame, step: float) -> DataFrame:
    """(i, j, area): what is covered by any polygon in a square, overlaps once. A square's polygons are clipped to it first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        rings = [geometry.clip(np.array([(p["x"], p["y"]) for p in r]), j * step, i * step, (j + 1) * step, (i + 1) * step) for r in pdf["ring"]]
        return pd.DataFrame([(i, j, geometry.union_area([r for r in rings if len(r) >= 3]))], columns=["i", "j", "area"])

    return _squares(polygons, step).groupBy("_i", "_j").applyInPandas(run, "i long, j long, area double").where("area > 0")
