"""Forecasts of series by locally weighted linear maps, at several horizons, and how they compare."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.operators.series_tests import checked_series
from sedge.operators.summaries import two_sided_normal_sql

THETAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
HORIZONS = (1, 3, 7)


def forecast_errors(series: DataFrame, cell: Sequence[str], order: str, x: str, dims: int, delay: int, theiler: int, thetas: Sequence[float] = THETAS, horizons: Sequence[int] = HORIZONS, share: float = 0.6, rows: int = 256) -> DataFrame:
    """(cell, stage, theta, horizon, at, error, step, target): a row for each forecast.

    The library is the vectors all of whose targets lie in the first `share` of
    the series. Stage 'fit' forecasts it from itself without times within
    theiler, 'test' the vectors of the rest. step is the error of staying where
    one is. A series is one array of bounded length; theta and blocks of `rows`
    vectors are dealt over the cluster. A series that has gaps, doesn't vary or
    is too short is one row of stage 'error', target null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    far = max(horizons)
    whole = series.groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, x))), lambda s: s[x]).alias("_x"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_x") - 1) / rows).cast("int"))
    tasks = whole.withColumn("theta", F.explode(F.array(*map(F.lit, map(float, thetas))))).withColumn("_block", F.explode(blocks)).repartition(3 * series.sparkSession.sparkContext.defaultParallelism, *cell, "theta", "_block")
    names = [*cell, "stage", "theta", "horizon", "at", "error", "step", "target"]

    def errors(values, theta: float, block: int):
        v = checked_series(values)
        cut = int(share * len(v))
        vectors = D.delay_vectors(v, dims, delay)
        now = np.arange(len(vectors)) + (dims - 1) * delay
        vectors, now = vectors[now + far < len(v)], now[now + far < len(v)]
        targets = v[now[:, None] + np.array(horizons)[None, :]]
        known = now + far < cut
        if known.sum() <= 2 * theiler + dims + 1 or not (now >= cut).any():
            raise ValueError("the series is too short")
        library, seen, times = vectors[known], targets[known], now[known]
        for stage, chosen in (("fit", known), ("test", now >= cut)):
            here = np.flatnonzero(chosen & (now // rows == block))
            if len(here):
                banned = (lambda i, t=now[here]: np.abs(times - t[i]) <= theiler) if stage == "fit" else None
                left = targets[here] - D.local_linear(library, seen, vectors[here], theta, banned)
                for k, h in enumerate(horizons):
                    yield pd.DataFrame({"stage": stage, "theta": theta, "horizon": h, "at": now[here], "error": left[:, k], "step": targets[here, k] - v[now[here]], "target": targets[here, k]})

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    found = list(errors(row["_x"], row["theta"], int(row["_block"])))
                except Exception:  # a cell's failure is a result of that cell
                    first = row["theta"] == float(thetas[0]) and row["_block"] == 0
                    found = [pd.DataFrame({"stage": ["error"], "theta": [0.0], "horizon": [0], "at": [0], "error": [None], "step": [None], "target": [None]}, dtype=object)] if first else []
                for part in found:
                    yield part.assign(**{c: row[c] for c in cell})[names]

    return tasks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", stage string, theta double, horizon int, at long, error double, step double, target double")


def horizon_gains(errors: DataFrame, cell: Sequence[str]) -> DataFrame:
    """By cell and horizon: the theta of least fit error (the least such), errors of its forecasts, of the linear map, of staying and of 0 (an anomaly's normal), gain over the linear map, and the one-sided test that it errs less.

    The test is Diebold and Mariano's with the autocovariances of horizon - 1
    lags, none of them where their sum isn't positive; with theta 0 its p is 1.
    Failed series have one row of horizon 0 with nulls.
    """
    keys = [*cell, "horizon"]
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    best = errors.where("stage = 'fit'").groupBy(*keys, "theta").agg(rmse("error").alias("_fit")).groupBy(*keys).agg(F.min(F.struct("_fit", "theta"))["theta"].alias("theta"))
    test = errors.where("stage = 'test'")
    own = test.join(best, [*keys, "theta"]).select(*keys, "theta", "at", "error")
    both = own.join(test.where("theta = 0").select(*keys, "at", F.col("error").alias("linear"), "step", "target"), [*keys, "at"])
    d = both.withColumn("_d", F.col("linear") * F.col("linear") - F.col("error") * F.col("error"))
    d = d.withColumn("_c", F.col("_d") - F.avg("_d").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy("at")
    lagged = sum((F.when(F.col("horizon") > i, F.coalesce(F.lag("_c", i).over(w), F.lit(0.0))).otherwise(0.0) for i in range(1, max(HORIZONS))), F.lit(0.0))
    g = d.withColumn("_l", lagged).groupBy(*keys, "theta").agg(
        F.count(F.lit(1)).alias("n"), rmse("error").alias("rmse"), rmse("linear").alias("rmse_linear"), rmse("step").alias("rmse_step"), rmse("target").alias("rmse_normal"),
        F.avg("_d").alias("_m"), F.avg(F.col("_c") * F.col("_c")).alias("_v0"), F.avg(F.col("_c") * (F.col("_c") + 2 * F.col("_l"))).alias("_v"),
    )
    v = F.when(F.col("_v") > 0, F.col("_v")).when(F.col("_v0") > 0, F.col("_v0"))
    g = g.withColumn("dm", F.when(F.col("theta") > 0, F.col("_m") / F.sqrt(v / F.col("n"))))
    p = F.expr(f"CASE WHEN dm IS NULL THEN 1.0 WHEN dm > 0 THEN {two_sided_normal_sql('dm')} / 2 ELSE 1 - {two_sided_normal_sql('dm')} / 2 END")
    out = g.withColumn("gain", F.when(F.col("rmse_linear") > 0, 1 - F.col("rmse") / F.col("rmse_linear"))).withColumn("p", p)
    out = out.select(*keys, "theta", "n", "rmse", "rmse_linear", "rmse_step", "rmse_normal", "gain", "dm", "p")
    failed = errors.where("stage = 'error'").select(*keys)
    return out.unionByName(failed, allowMissingColumns=True)
