"""Grids, areas and spatial statistics on latitude and longitude columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84: semi-major axis in km and eccentricity.
AXIS_KM, ECCENTRICITY = 6378.137, 0.0818191908426215
#: Cells of a block, about; pairs of cells that one step of a task meets; squares that a reach is long.
BLOCK, STEP, SQUARES = 4096, 1 << 17, 4


def cell_id(lat: Column, lon: Column, prefix: str = "CELL") -> Column:
    return F.format_string(f"{prefix}_%+07.2f_%+08.2f", lat, lon)


def snapped(x: Column, step: float, up: bool = False) -> Column:
    return (F.ceil(x / step) if up else F.floor(x / step)) * F.lit(step)


def grid(boxes: DataFrame, step: float) -> DataFrame:
    """Cells centred on multiples of step that meet each box (south, north, west, east), clipped to it: centre, edges, share of the full cell that is inside."""
    centres = lambda lo, hi: F.explode(F.sequence(F.ceil(F.col(lo) / step - 0.5), F.floor(F.col(hi) / step + 0.5)))
    half = step / 2
    g = boxes.withColumn("_i", centres("south", "north")).withColumn("_j", centres("west", "east")).withColumn("lat", F.col("_i") * step).withColumn("lon", F.col("_j") * step)
    edges = {"south": F.greatest(F.col("lat") - half, "south"), "north": F.least(F.col("lat") + half, "north"), "west": F.greatest(F.col("lon") - half, "west"), "east": F.least(F.col("lon") + half, "east")}
    share = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) / (step * step)
    return g.withColumns(edges).drop("_i", "_j").where("north > south and east > west").withColumn("share", share)


def zone_area(lat: Column) -> Column:
    """km2 between the equator and a latitude, per degree of longitude, on the ellipsoid."""
    e = ECCENTRICITY
    s = F.sin(F.radians(lat))
    b2 = AXIS_KM**2 * (1 - e * e)
    q = s / (1 - e * e * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)
    return q * (b2 / 2) * (math.pi / 180)


def box_area(south: Column, north: Column, degrees: Column) -> Column:
    """km2 of a box of latitudes and a width in degrees."""
    return (zone_area(north) - zone_area(south)) * degrees


def overlap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(hi, other_hi) - F.greatest(lo, other_lo), F.lit(0.0))


def neighbours(cells: DataFrame, key: str, lat: str, lon: str, radius: float) -> DataFrame:
    """Ordered pairs of cells within `radius` degrees, and their distance.

    Both sides are keyed by squares of the radius, and one side looks into the
    nine around its own, so the join is an equality and grows with the cells.
    """
    side = cells.withColumn("_i", F.floor(F.col(lat) / radius)).withColumn("_j", F.floor(F.col(lon) / radius))
    around = F.expr("explode(flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> named_struct('a', a, 'b', b)))))")
    left = side.withColumn("_s", around).select(F.col(key).alias("a"), F.col(lat).alias("lat_a"), F.col(lon).alias("lon_a"), (F.col("_i") + F.col("_s.a")).alias("_i"), (F.col("_j") + F.col("_s.b")).alias("_j"))
    right = side.select(F.col(key).alias("b"), F.col(lat).alias("lat_b"), F.col(lon).alias("lon_b"), "_i", "_j")
    d = F.hypot(F.col("lat_a") - F.col("lat_b"), F.col("lon_a") - F.col("lon_b"))
    return left.join(right, ["_i", "_j"]).where(F.col("a") != F.col("b")).withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


def block_pairs(squares: DataFrame) -> DataFrame:
    """(i, j, p, i2, j2, p2): each two blocks that may hold cells within reach of each other, once. squares: _i, _j and parts, the blocks of a square, which are few against the cells."""
    far = range(-SQUARES - 1, SQUARES + 2)
    steps = [(a, b) for a in far for b in far if (a, b) >= (0, 0) and math.hypot(max(abs(a) - 1, 0), max(abs(b) - 1, 0)) <= SQUARES]
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    left = squares.withColumn("_s", around).select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("parts").alias("_n"), (F.col("_i") + F.col("_s.a")).alias("_i"), (F.col("_j") + F.col("_s.b")).alias("_j"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = left.join(squares, ["_i", "_j"]).withColumn("p", upto("_n")).withColumn("p2", upto("parts"))
    return met.select("i", "j", "p", F.col("_i").alias("i2"), F.col("_j").alias("j2"), "p2").where("i != i2 or j != j2 or p <= p2")


def class_sums(cells: DataFrame, key: str, lat: str, lon: str, models: Sequence[str], radius: float, width: float, reach: float) -> DataFrame:
    """(model, class, w, gx, gy, m, ge) over all ordered pairs of cells with unequal keys within `reach`.

    cells: key, lat, lon (a row for each such three), and for model number k
    one{k} (how many rows it has there), rx{k}, ry{k} and e{k}, 0 where it has
    none. class is the distance in widths, rounded up; w the pairs, gx and gy
    the sums of their products of rx and ry; m and ge the pairs within `radius`
    and their products of e. Squares of a fourth of the reach are cut into
    blocks, which meet two at a time, so a task's memory is bounded; the time
    grows with the pairs within reach, all of which count.
    """
    side, n = reach / SQUARES, int(math.ceil(reach / width)) + 1
    values = [f"{v}{k}" for k in range(len(models)) for v in ("one", "rx", "ry", "e")]
    placed = cells.select(F.col(key).alias("_key"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), *values).where("_key is not null and _lat is not null and _lon is not null")
    placed = placed.withColumn("_i", F.floor(F.col("_lat") / side)).withColumn("_j", F.floor(F.col("_lon") / side))
    squares = placed.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    pairs = block_pairs(squares)
    cut = placed.join(squares, ["_i", "_j"]).withColumn("_p", F.pmod(F.xxhash64("_key"), F.col("parts"))).drop("parts")
    ends = lambda i, j, p: [F.col(i) == F.col("_i"), F.col(j) == F.col("_j"), F.col(p) == F.col("_p")]
    shape = [*pairs.columns, "_second", "_key", "_lat", "_lon", *values]
    first = pairs.join(cut, ends("i", "j", "p")).withColumn("_second", F.lit(False)).select(*shape)
    second = pairs.where("i != i2 or j != j2 or p != p2").join(cut, ends("i2", "j2", "p2")).withColumn("_second", F.lit(True)).select(*shape)

    def run(t: pa.Table) -> pa.Table:
        keys = t["_key"].combine_chunks().dictionary_encode().indices.to_numpy()
        column = {c: t[c].to_numpy() for c in ("_lat", "_lon", *values)}
        other = t["_second"].to_numpy()
        a = np.flatnonzero(~other)
        # a block that meets itself has all ordered pairs; of two blocks each pair is met once and counts twice
        b, times = (np.flatnonzero(other), 2.0) if other.any() else (a, 0.0 if t["i"][0] != t["i2"][0] or t["j"][0] != t["j2"][0] or t["p"][0] != t["p2"][0] else 1.0)
        sums = np.zeros((len(models), 5, n + 1))
        plain = [bool((column[f"one{k}"] == 1).all()) for k in range(len(models))]
        step = max(1, STEP // max(1, len(b)))
        for lo in range(0, len(a) if times else 0, step):
            x = a[lo : lo + step]
            d = np.hypot(column["_lat"][x, None] - column["_lat"][b], column["_lon"][x, None] - column["_lon"][b])
            ok = (d <= reach) & (keys[x, None] != keys[b])
            at = np.where(ok, np.ceil(np.round(np.where(ok, d, 0.0) / width, 9)), n).astype(np.int64).ravel()
            i, j = np.nonzero(ok & (d <= radius))
            close = at.reshape(d.shape)[i, j]
            count = np.bincount(at, minlength=n + 1)
            for k, out in enumerate(sums):
                one, rx, ry, e = (column[f"{v}{k}"] for v in ("one", "rx", "ry", "e"))
                product = lambda v, x=x: np.bincount(at, (v[x, None] * v[b]).ravel(), n + 1)
                out += [count if plain[k] else product(one), product(rx), product(ry), np.bincount(close, one[x[i]] * one[b[j]], n + 1), np.bincount(close, e[x[i]] * e[b[j]], n + 1)]
        which, found = np.nonzero(sums[:, 0, :n])
        picked = sums[which, :, found] * times
        return pa.table({"model": pa.array([models[k] for k in which], pa.string()), "class": found.astype(np.int64), **{c: picked[:, k] for k, c in enumerate(("w", "gx", "gy", "m", "ge"))}})

    met = first.unionAll(second).groupBy(*pairs.columns).applyInArrow(run, "model string, class long, w double, gx double, gy double, m double, ge double")
    return met.groupBy("model", "class").agg(*(F.sum(c).alias(c) for c in ("w", "gx", "gy", "m", "ge")))


def moran(values: DataFrame, pairs: DataFrame, key: str, x: str, *by: str) -> DataFrame:
    """Moran's I of x over pairs (a, b), in groups of pairs if by is given: (n / W) * sum of products / sum of squares."""
    stats = values.agg(F.avg(x).alias("_m"), F.count(x).alias("_n"))
    dev = values.crossJoin(F.broadcast(stats)).select(F.col(key).alias("_k"), (F.col(x) - F.col("_m")).alias("_d"), "_n")
    square = dev.agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"), F.max("_n").alias("_n"))
    rows = pairs.join(dev.select(F.col("_k").alias("a"), F.col("_d").alias("_da")), "a").join(dev.select(F.col("_k").alias("b"), F.col("_d").alias("_db")), "b")
    top = rows.groupBy(*by).agg(F.sum(F.col("_da") * F.col("_db")).alias("_t"), F.count(F.lit(1)).alias("pairs"))
    return top.crossJoin(F.broadcast(square)).withColumn("moran", F.col("_n") / F.col("pairs") * F.col("_t") / F.col("_s")).drop("_t", "_s", "_n")
