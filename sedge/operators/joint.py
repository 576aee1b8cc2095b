"""Forecasts of a series from several series at once: delay vectors over channels, predictor sets, and how much each adds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.operators.forecasts import THETAS
from sedge.operators.series_tests import checked_series, replicate_stream
from sedge.operators.summaries import two_sided_normal_sql

#: Share of a series that forecasts are learned from; nearest neighbours that one takes the mean of; every so many library vectors choose theta.
SHARE, NEIGHBOURS, EVERY = 0.6, 5, 4
#: Vectors that a task forecasts.
ROWS = 512

#: (dims, delay) of a channel.
Shape = tuple[int, int]


def joint_vectors(series: DataFrame, cell: Sequence[str], order: str, channels: Mapping[str, Shape], horizon: int = 1) -> DataFrame:
    """(cell, order, at, n, one array a channel, next_<channel>): delay vectors of all channels at the same time, and their values `horizon` steps on.

    An array is x(t), x(t - delay), ...; at counts a cell's rows from 0, n is
    how many it has. Rows without a whole vector or a next value are left out;
    where a value is missing the array holds a null.
    """
    w = Window.partitionBy(*cell).orderBy(order)
    span = max((dims - 1) * delay for dims, delay in channels.values())
    rows = series.select(*cell, order, *channels).withColumn("at", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*cell)))
    made = [F.array(*(F.lag(c, k * delay).over(w) for k in range(dims))).alias(f"v_{c}") for c, (dims, delay) in channels.items()]
    nexts = [F.lead(c, horizon).over(w).alias(f"next_{c}") for c in channels]
    out = rows.select(*cell, order, "at", "n", *made, *nexts)
    return out.where((F.col("at") >= span) & (F.col("at") < F.col("n") - horizon)).select(*cell, order, "at", "n", *(F.col(f"v_{c}").alias(c) for c in channels), *(f"next_{c}" for c in channels))


def arrays(series: DataFrame, cell: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """A row for each cell, with its columns, in order, as arrays _0, _1, ...: of a series' bounded length."""
    listed = series.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_all"))
    return listed.select(*cell, *(F.col(f"_all.{c}").alias(f"_{k}") for k, c in enumerate(columns)))


def _cut(n: Column) -> Column:
    return F.floor(F.lit(SHARE) * n)


def linear_errors(vectors: DataFrame, cell: Sequence[str], channels: Mapping[str, Shape], target: str, predictors: Sequence[str], theiler: int) -> DataFrame:
    """(cell, at, error, sigma): a vector autoregression on the predictors' delay vectors, learned from the first part and tested on the rest.

    vectors: joint_vectors() of one step. The sums of products that least
    squares need are aggregates; only they, a row a cell, go to the solver.
    sigma is the deviation of the learned part's target. Cells with a missing
    value or too few rows have no rows.
    """
    names = [F.col(c)[k] for c in predictors for k in range(channels[c][0])]
    x, y = [F.lit(1.0), *names], F.col(f"next_{target}")
    learned = F.col("at") + 1 + theiler < _cut(F.col("n"))
    p = len(x)
    pairs = list(combinations_with_replacement(range(p), 2))
    whole = F.array(*x, y)
    sums = vectors.withColumn("_gap", F.exists(whole, lambda v: v.isNull())).groupBy(*cell).agg(
        F.array(*(F.sum(F.when(learned, x[i] * x[j])) for i, j in pairs)).alias("xx"), F.array(*(F.sum(F.when(learned, xi * y)) for xi in x)).alias("xy"),
        F.max("_gap").alias("_gap"), F.count(F.when(learned, 1)).alias("_m"), F.stddev_pop(F.when(F.col("at") + 1 < _cut(F.col("n")), y)).alias("sigma"),
    )
    sums = sums.where(~F.col("_gap") & (F.col("_m") > p))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def solved(batches):
        i, j = np.array(pairs).T
        for pdf in batches:
            found = []
            for xx, xy in zip(pdf["xx"], pdf["xy"], strict=True):
                m = np.zeros((p, p))
                m[i, j] = m[j, i] = xx
                scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
                found.append((np.linalg.lstsq(m / scale[:, None] / scale[None, :], np.array(xy) / scale, rcond=1e-13)[0] / scale).tolist())
            yield pdf[[*cell, "sigma"]].assign(beta=found)

    beta = sums.mapInPandas(solved, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", sigma double, beta array<double>")
    test = vectors.where(F.col("at") >= _cut(F.col("n"))).join(beta, list(cell))
    guess = sum((F.col("beta")[k + 1] * v for k, v in enumerate(names)), F.col("beta")[0])
    return test.select(*cell, "at", (y - guess).alias("error"), "sigma")


def _vectors_of(x: dict[str, np.ndarray], channels: Mapping[str, Shape], names: Sequence[str], now: np.ndarray) -> np.ndarray:
    return np.column_stack([x[c][now - k * channels[c][1]] for c in names for k in range(channels[c][0])])


def _made(copies: DataFrame, cell: Sequence[str], n: int, make, seed: int) -> DataFrame:
    """copies with the arrays of replicates from 1 on made from the cell's own, once for each; arrays that can't be stay, and fail later."""

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if row["replicate"]:
                    try:
                        x = np.column_stack([checked_series(row[f"_{k}"]) for k in range(n)])
                        y = make(x, replicate_stream(seed, row["replicate"]))
                        row |= {f"_{k}": y[:, k] for k in range(n)}
                    except Exception:  # noqa: S110  the cell's failure is a result of its forecasts
                        pass
                rows.append(row)
            yield pd.DataFrame(rows, columns=pdf.columns)

    return copies.repartition(3 * copies.sparkSession.sparkContext.defaultParallelism, *cell, "replicate").mapInPandas(run, copies.schema)


def predictor_errors(series: DataFrame, cell: Sequence[str], order: str, channels: Mapping[str, Shape], targets: Sequence[str], sets: Mapping[str, Sequence[str]], theiler: int, thetas: Sequence[float] = THETAS, replicates: int = 0, make=None, seed: int = 11) -> DataFrame:
    """(cell, replicate, target, predictors, model, theta, stage, at, error, sigma): forecasts one step on, by nearest neighbours and by locally weighted maps.

    sets: channels of each set of predictors, where `target` stands for the
    target itself and `rest` for all other channels. The library is the vectors
    whose targets lie more than theiler before the cut at SHARE of the series;
    stage 'test' forecasts what is from the cut on, stage 'fit' every EVERY-th
    of the library from the rest of it without times within theiler, and is a
    row of at = the block with the mean square as error. sigma is the deviation
    of the target before the cut.

    A cell's channels are one row of arrays of bounded length; targets, sets,
    blocks of vectors and replicates are dealt over the cluster. From 1 on a
    replicate is make(columns, generator) of the cell's channels; generators
    depend on the replicate only, so all cells share them. A cell with gaps, a
    constant channel or too few rows is one row of stage 'error'.
    """
    names = list(channels)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    whole = arrays(series, cell, order, names)
    copies = whole.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    if replicates:
        copies = _made(copies, cell, len(names), make, seed)
    plan = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(s).alias("predictors")) for t in targets for s in sets))
    tasks = copies.withColumn("_p", F.explode(plan)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.size("_0") - 1) / ROWS).cast("int"))))
    tasks = tasks.select("*", "_p.target", "_p.predictors").drop("_p").repartition(3 * series.sparkSession.sparkContext.defaultParallelism, *cell, "replicate", "target", "predictors", "_block")
    columns = ["model", "theta", "stage", "at", "error", "sigma"]

    def errors(row: dict) -> list[tuple]:
        x, target, block = {c: checked_series(row[f"_{k}"]) for k, c in enumerate(names)}, row["target"], row["_block"]
        chosen = [c for s in sets[row["predictors"]] for c in ([target] if s == "target" else [c for c in names if c != target] if s == "rest" else [s])]
        n = len(x[target])
        cut = int(SHARE * n)
        now = np.arange(max((dims - 1) * delay for dims, delay in channels.values()), n - 1)
        v, y = _vectors_of(x, channels, chosen, now), x[target][now + 1]
        known = now + 1 + theiler < cut
        if known.sum() <= 2 * theiler + v.shape[1] + NEIGHBOURS or not (now >= cut).any():
            raise ValueError("the series is too short")
        lib_v, lib_y, times, sigma = v[known], y[known], now[known], float(x[target][:cut].std())
        out: list[tuple] = []
        here = np.flatnonzero((now >= cut) & (now // ROWS == block))
        if len(here):
            near = D.nearest_mean(lib_v, lib_y, v[here], NEIGHBOURS)
            out += [("nearest", None, "test", int(t), float(e), sigma) for t, e in zip(now[here], y[here] - near, strict=True)]
            for theta, guess in zip(thetas, D.local_maps(lib_v, lib_y, v[here], thetas), strict=True):
                out += [("local", float(theta), "test", int(t), float(e), sigma) for t, e in zip(now[here], y[here] - guess, strict=True)]
        rows = np.arange(0, known.sum(), EVERY)
        rows = rows[times[rows] // ROWS == block]
        if len(rows):
            apart = np.abs(times[rows][:, None] - times[None, :]) > theiler
            left = lib_y[rows] - D.local_maps(lib_v, lib_y, lib_v[rows], thetas, apart)
            out += [("local", float(theta), "fit", block, float((e * e).sum()), float(len(rows))) for theta, e in zip(thetas, left, strict=True)]
        return out

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    found = errors(row)
                except Exception:  # a cell's failure is a result of that cell
                    found = [(None, None, "error", 0, None, None)] if row["_block"] == 0 else []
                yield pd.DataFrame(found, columns=columns).assign(**{c: row[c] for c in (*cell, "replicate", "target", "predictors")})[[*cell, "replicate", "target", "predictors", *columns]]

    return tasks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", replicate int, target string, predictors string, model string, theta double, stage string, at long, error double, sigma double")


def predictor_scores(errors: DataFrame, cell: Sequence[str], base: str = "own") -> DataFrame:
    """(cell, replicate, target, predictors, model, theta, n, score, gain, dm, p) of predictor_errors(): score is the test's error in deviations of the target.

    Local maps take the theta of least error on the library (ties: the least).
    gain is the score of the set `base` under the same model less one's own; dm
    and p are Diebold and Mariano's one-sided test that the squared errors are
    less than the base's at the same times. Failed cells have no rows.
    """
    keys = [*cell, "replicate", "target", "predictors"]
    fit = errors.where("stage = 'fit'").groupBy(*keys, "theta").agg((F.sum("error") / F.sum("sigma")).alias("_fit"))
    best = fit.groupBy(*keys).agg(F.min(F.struct("_fit", "theta"))["theta"].alias("_theta"))
    test = errors.where("stage = 'test'").join(best, keys).where((F.col("model") != "local") | (F.col("theta") == F.col("_theta"))).drop("_theta")
    return scores(test.select(*keys, "model", "theta", "at", "error", "sigma"), [*cell, "replicate", "target"], base)


def scores(test: DataFrame, by: Sequence[str], base: str) -> DataFrame:
    """predictor_scores() of test errors: by, predictors, model, theta, at, error, sigma."""
    keys = [*by, "model"]
    ours = test.where(F.col("predictors") == base).select(*keys, "at", F.col("error").alias("_base"))
    d = test.join(ours, [*keys, "at"], "left").withColumn("_d", F.col("_base") * F.col("_base") - F.col("error") * F.col("error"))
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    g = d.groupBy(*by, "predictors", "model", "theta").agg(F.count(F.lit(1)).alias("n"), (rmse("error") / F.max("sigma")).alias("score"), (rmse("_base") / F.max("sigma")).alias("_score"), F.avg("_d").alias("_m"), F.var_pop("_d").alias("_v"))
    other = F.col("predictors") != base
    g = g.withColumn("gain", F.col("_score") - F.col("score")).withColumn("dm", F.when(other & (F.col("_v") > 0), F.col("_m") / F.sqrt(F.col("_v") / F.col("n"))))
    p = F.expr(f"CASE WHEN dm > 0 THEN {two_sided_normal_sql('dm')} / 2 ELSE 1 - {two_sided_normal_sql('dm')} / 2 END")
    return g.select(*by, "predictors", "model", "theta", "n", "score", "gain", "dm", F.when(F.col("dm").isNotNull(), p).when(other, 1.0).alias("p"))


def joint_test(found: DataFrame, cell: Sequence[str], joint: str = "joint") -> DataFrame:
    """(cell, target, model, statistic, observed, null_mean, n_null, p): the joint set's score (less is better) and its gain over the better of the other sets, against replicates. found: predictor_scores()."""
    keys = [*cell, "replicate", "target", "model"]
    by = found.groupBy(*keys).agg(F.max(F.when(F.col("predictors") == joint, F.col("score"))).alias("score"), F.min(F.when(F.col("predictors") != joint, F.col("score"))).alias("_other"))
    rows = by.select(*keys, F.explode(F.array(F.struct(F.lit("score").alias("statistic"), F.col("score").alias("value")), F.struct(F.lit("gain").alias("statistic"), (F.col("_other") - F.col("score")).alias("value")))).alias("s")).select(*keys, "s.*")
    by = [*cell, "target", "model", "statistic"]
    seen = rows.where("replicate = 0").select(*by, F.col("value").alias("observed"))
    d = rows.join(seen, by)
    null = F.when(F.col("replicate") > 0, F.col("value"))
    reached = F.when(F.col("statistic") == "gain", null >= F.col("observed")).otherwise(null <= F.col("observed"))
    return d.groupBy(*by).agg(F.max("observed").alias("observed"), F.avg(null).alias("null_mean"), F.count(null).cast("int").alias("n_null"), ((1 + F.count(F.when(reached, 1))) / (F.count(null) + 1)).alias("p"))


def state_dependence(series: DataFrame, cell: Sequence[str], order: str, channels: Mapping[str, Shape], target: str, forcing: str, theta: float) -> DataFrame:
    """(cell, n, dependence): rank correlation between what a local map gives the forcing's present value and the target's present value, over all times.

    Each time is mapped from all others; the coefficient is the difference that
    a thousandth of the forcing's deviation makes. Cells that have gaps or too
    few rows have a null. Blocks of times are dealt over the cluster, ranks and
    their correlation are windows and an aggregate.
    """
    names = list(channels)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    whole = arrays(series, cell, order, names)
    tasks = whole.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.size("_0") - 1) / ROWS).cast("int")))).repartition(3 * series.sparkSession.sparkContext.defaultParallelism, *cell, "_block")
    columns = ["at", "coefficient", "state"]

    def found(row: dict) -> pd.DataFrame:
        x = {c: checked_series(row[f"_{k}"]) for k, c in enumerate(names)}
        now = np.arange(max((dims - 1) * delay for dims, delay in channels.values()), len(x[target]) - 1)
        v, y = _vectors_of(x, channels, names, now), x[target][now + 1]
        if len(v) <= v.shape[1] + 2:
            raise ValueError("the series is too short")
        column = sum(channels[c][0] for c in names[: names.index(forcing)])
        step = 1e-3 * v[:, column].std()
        here = np.flatnonzero(now // ROWS == row["_block"])
        moved = v[here].copy()
        moved[:, column] += step
        others = here[:, None] != np.arange(len(v))[None, :]
        slope = (D.local_maps(v, y, moved, [theta], others)[0] - D.local_maps(v, y, v[here], [theta], others)[0]) / step
        return pd.DataFrame({"at": now[here], "coefficient": slope, "state": x[target][now[here]]})

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    part = found(row)
                except Exception:  # a cell's failure is a result of that cell
                    part = pd.DataFrame({"at": [0], "coefficient": [None], "state": [None]}, dtype=object) if row["_block"] == 0 else pd.DataFrame([], columns=columns)
                yield part.assign(**{c: row[c] for c in cell})[[*cell, *columns]]

    local = tasks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", at long, coefficient double, state double")
    rank = lambda c: (F.rank().over(Window.partitionBy(*cell).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*cell, c)) - 1) / 2)
    known = local.where("coefficient is not null").select(*cell, rank("coefficient").alias("_a"), rank("state").alias("_b"))
    got = known.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("dependence"))
    return whole.select(*cell).join(got, list(cell), "left").select(*cell, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "dependence")

