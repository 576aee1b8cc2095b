"""Convergent cross mapping of pairs of series: skill by library size and lag, and its significance against surrogates of whole years."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.kernels import surrogates as G
from sedge.operators.joint import arrays
from sedge.operators.series_tests import checked_series, seed_of

#: The counts of the published rule: sizes from a tenth of the library to all of it, draws of a size, lags of the target, surrogates.
SIZES, SAMPLES, LAGS, SURROGATES = 5, 30, (0, -1, -2), 99


def _sizes(n: int, dims: int, delay: int, lags: Sequence[int], steps: int) -> np.ndarray:
    whole = n - (dims - 1) * delay - max(-min(lags), 0)
    return np.unique(np.linspace(0.1 * whole, whole, steps).astype(int))


def cross_skills(pairs: DataFrame, key: Sequence[str], order: str, library: str, target: str, dims: int, delay: int, theiler: int, period: int, lags: Sequence[int] = LAGS, samples: int = SAMPLES, surrogates: int = SURROGATES, sizes: int = SIZES, seed: int = 13) -> DataFrame:
    """(key, kind, lag, size, draw, rho): how well `library`'s shadow manifold tells `target` (lag steps before), a row for each draw.

    Kind 'data': libraries of several sizes drawn at random. Kind 'null': the
    target with its whole years of `period` rows in another order, told from
    one draw of the largest size. The neighbours of a draw are searched once
    and serve all lags, and all surrogates. Pairs are rows of arrays of bounded
    length; draws are dealt over the cluster. A pair with gaps, a constant
    series or too few rows is one row of kind 'error'.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    whole = arrays(pairs, key, order, [library, target])
    # draw 0 is that of the surrogates
    tasks = whole.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples)))).repartition(3 * pairs.sparkSession.sparkContext.defaultParallelism, *key, "draw")
    columns = ["kind", "lag", "size", "draw", "rho"]

    def found(row: dict) -> list[tuple]:
        x, y, draw = checked_series(row["_0"]), checked_series(row["_1"]), int(row["draw"])
        v, n = D.delay_vectors(x, dims, delay), len(x)
        times = np.arange(len(v)) + (dims - 1) * delay
        steps = _sizes(n, dims, delay, lags, sizes)
        if steps[0] < dims + 2 or steps[-1] <= 2 * theiler + dims + 1:
            raise ValueError("the series is too short")
        rng = np.random.default_rng(seed_of(seed, *(row[c] for c in key), draw))
        first = max(0, -min(lags) - int(times[0]))  # times that all lags reach back from
        out = []
        for size in steps if draw else steps[-1:]:
            chosen = first + np.sort(rng.choice(len(v) - first, size=min(int(size), len(v) - first), replace=False))
            near, weight = D.simplex(v[first:], times[first:], chosen - first, theiler)
            at = times[first:]
            if draw:
                out += [("data", lag, int(size), draw, D.skill((weight * y[at + lag][near]).sum(1), y[at + lag])) for lag in lags]
                continue
            for k in range(1, surrogates + 1):
                z = G.years_dealt(y, np.random.default_rng(seed_of(seed, "null", k)), period)
                out += [("null", lag, int(size), k, D.skill((weight * z[at + lag][near]).sum(1), z[at + lag])) for lag in lags]
        return out

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    rows = found(row)
                except Exception:  # a pair's failure is a result of that pair
                    rows = [("error", 0, 0, 0, None)] if row["draw"] == 0 else []
                yield pd.DataFrame(rows, columns=columns).assign(**{c: row[c] for c in key})[[*key, *columns]]

    return tasks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", kind string, lag int, size int, draw int, rho double")


def skill_curves(skills: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, lag, size, rho, draws): mean skill of each lag by library size."""
    known = F.when(~F.isnan("rho"), F.col("rho"))
    return skills.where("kind = 'data'").groupBy(*key, "lag", "size").agg(F.avg(known).alias("rho"), F.count(known).cast("int").alias("draws"))


def cross_map_test(skills: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, rho, lag, rho_least, convergence, rho_null, n_null, p): the lag of greatest skill at the largest library (ties: the nearest), how much the skill grows from the smallest, and its p against the surrogates, each of which chooses its own best lag.

    Failed pairs have one row with nulls.
    """
    curves = skill_curves(skills, key)
    ends = curves.withColumn("_big", F.max("size").over(Window.partitionBy(*key))).withColumn("_small", F.min("size").over(Window.partitionBy(*key)))
    best = ends.where(F.col("size") == F.col("_big")).groupBy(*key).agg(F.max(F.struct("rho", "lag")).alias("_b")).select(*key, F.col("_b.rho").alias("rho"), F.col("_b.lag").alias("lag"))
    least = ends.where(F.col("size") == F.col("_small")).select(*key, "lag", F.col("rho").alias("rho_least"))
    null = skills.where("kind = 'null' and not isnan(rho)").groupBy(*key, "draw").agg(F.max("rho").alias("_null"))
    tested = best.join(null, list(key), "left").groupBy(*key, "rho", "lag").agg(F.avg("_null").alias("rho_null"), F.count("_null").cast("int").alias("n_null"), ((1 + F.count(F.when(F.col("_null") >= F.col("rho"), 1))) / (F.count("_null") + 1)).alias("p"))
    out = tested.join(least, [*key, "lag"]).select(*key, "rho", "lag", "rho_least", (F.col("rho") - F.col("rho_least")).alias("convergence"), "rho_null", "n_null", "p")
    return out.unionByName(skills.where("kind = 'error'").select(*key), allowMissingColumns=True)
