"""Several series of a cell together: joint delay vectors, what each adds to a forecast, cross mapping, surrogates that keep how they hang together."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.kernels import surrogates as G
from sedge.operators import crossmap as C
from sedge.operators import folds as O
from sedge.operators import joint as J
from sedge.operators import series as S
from sedge.operators import series_tests as T
from sedge.plans.base import CELL, r6
from sedge.plans.registry import query
from sedge.sources.tables import read

#: Delay vectors of the channels: dims, delay; near times that are no neighbours.
CHANNELS, THEILER = {"x": (3, 1), "y": (2, 2)}, 7
SETS = {"own": ["target"], "other": ["rest"], "joint": ["target", "rest"]}
REPLICATES = 39
YEAR = 365


def measures(spark, sf_dir) -> DataFrame:
    """Quantity and rebate by return flag and day, over all days, 0 where nothing was shipped."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.to_date("l_shipdate").alias("day"), "l_quantity", (F.col("l_extendedprice") * F.col("l_discount") / 1000).alias("rebate"))
    daily = rows.groupBy("cell", "day").agg(F.sum("l_quantity").alias("x"), F.round(F.sum("rebate"), 6).alias("y"))
    return S.spine(daily, CELL).select("cell", "day", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


_MEASURES = """d AS (SELECT l_returnflag AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS x, round(sum(l_extendedprice * l_discount / 1000), 6) AS y FROM lineitem GROUP BY 1, 2),
    days AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
    m AS (SELECT c.cell, days.day, coalesce(d.x, 0) AS x, coalesce(d.y, 0) AS y FROM (SELECT DISTINCT cell FROM d) c CROSS JOIN days LEFT JOIN d ON d.cell = c.cell AND d.day = days.day)"""


@query("joint_delay_vectors", f"""WITH {_MEASURES}, v AS (SELECT cell, day, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY cell) AS n, x AS x0, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, y AS y0, lag(y, 2) OVER w AS y1, lead(x) OVER w AS next_x, lead(y) OVER w AS next_y FROM m WINDOW w AS (PARTITION BY cell ORDER BY day))
    SELECT cell, day, step, round(x0, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2, round(y0, 3) + 0.0 AS y0, round(y1, 3) + 0.0 AS y1, round(next_x, 6) + 0.0 AS next_x, round(next_y, 3) + 0.0 AS next_y FROM v WHERE step >= 2 AND step < n - 1""")  # fmt: skip
def joint_delay_vectors(spark, sf_dir):
    """Delay vectors of two channels, each with dimension and delay of its own, at the same times."""
    v = J.joint_vectors(measures(spark, sf_dir), CELL, "day", CHANNELS)
    r3 = lambda c, name: (F.round(c, 3) + F.lit(0.0)).alias(name)
    return v.select("cell", "day", F.col("at").alias("step"), *(r6(F.col("x")[k], f"x{k}") for k in range(3)), *(r3(F.col("y")[k], f"y{k}") for k in range(2)), r6("next_x", "next_x"), r3(F.col("next_y"), "next_y"))


def _linear(series: DataFrame) -> DataFrame:
    """Errors of vector autoregressions for every target and set of predictors."""
    v = J.joint_vectors(series, CELL, "day", CHANNELS).cache()
    other = {"x": "y", "y": "x"}
    chosen = {"own": lambda t: [t], "other": lambda t: [other[t]], "joint": lambda t: [t, other[t]]}
    parts = [J.linear_errors(v, CELL, CHANNELS, t, f(t), THEILER).select("cell", F.lit(0).alias("replicate"), F.lit(t).alias("target"), F.lit(s).alias("predictors"), F.lit("linear").alias("model"), F.lit(None).cast("double").alias("theta"), "at", "error", "sigma") for t in CHANNELS for s, f in chosen.items()]
    return reduce(DataFrame.unionAll, parts)


@query("joint_forecast_errors")
def joint_forecast_errors(spark, sf_dir):
    """A target forecast from itself, from the other channel and from both, by autoregression, neighbours and local maps: scores, gains over the target alone, and whether they err less."""
    series = measures(spark, sf_dir)
    found = J.predictor_scores(J.predictor_errors(series, CELL, "day", CHANNELS, ["x", "y"], SETS, THEILER), CELL)
    return found.unionByName(J.scores(_linear(series), [*CELL, "replicate", "target"], "own")).drop("replicate")


@query("joint_forecast_test")
def joint_forecast_test(spark, sf_dir):
    """The joint forecast's error and its gain over single channels, against surrogates that keep spectra and cross spectra."""
    errors = J.predictor_errors(measures(spark, sf_dir), CELL, "day", CHANNELS, ["x", "y"], SETS, THEILER, thetas=(), replicates=REPLICATES, make=G.aligned_phases)
    test = errors.where("stage = 'test'").drop("stage")
    return J.joint_test(J.scores(test, [*CELL, "replicate", "target"], "own"), CELL)


@query("state_dependence_cells")
def state_dependence_cells(spark, sf_dir):
    """Whether what one channel does to the other depends on the other's state."""
    return J.state_dependence(measures(spark, sf_dir), CELL, "day", {"x": (1, 1), "y": (1, 1)}, "x", "y", 4.0)


def _pairs(spark, sf_dir) -> DataFrame:
    """All ordered pairs of cells, on common days."""
    s = measures(spark, sf_dir)
    one, two = s.select(F.col("cell").alias("library"), "day", F.col("x").alias("lib")), s.select(F.col("cell").alias("target"), "day", F.col("x").alias("tar"))
    return one.join(two, "day").where("library <> target")


def _skills(spark, sf_dir) -> DataFrame:
    return C.cross_skills(_pairs(spark, sf_dir), ["library", "target"], "day", "lib", "tar", 3, 1, THEILER, YEAR)


@query("cross_map_curves")
def cross_map_curves(spark, sf_dir):
    """Skill of cross mapping by library size and lag, over 30 draws of each."""
    return C.skill_curves(_skills(spark, sf_dir), ["library", "target"])


@query("cross_map_significance")
def cross_map_significance(spark, sf_dir):
    """The best lag's skill, its convergence, and its p against 99 surrogates of whole years that choose their lag too."""
    return C.cross_map_test(_skills(spark, sf_dir), ["library", "target"])


def joint_surrogate_errors(series: DataFrame, cell: list[str], order: str, channels: list[str], replicates: int, seed: int = 5) -> DataFrame:
    """(cell, replicate, kind, spectral_error, cross_error, cross_ratio, error): how well surrogates of a cell's channels keep spectra and correlations.

    Kinds: 'shared' turns all channels by the same phases, 'aligned' keeps values
    too. The phases of a replicate depend on the seed and the replicate only, so
    the cells, each a task for each replicate, are turned alike and the cross
    spectra between cells are kept without any group that holds them together.
    A cell with gaps or a constant channel has its error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    whole = J.arrays(series, cell, order, channels)
    tasks = whole.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).repartition(3 * series.sparkSession.sparkContext.defaultParallelism, *cell, "replicate")
    names = [*cell, "replicate", "kind", "spectral_error", "cross_error", "cross_ratio", "error"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                for kind, make in (("shared", G.shared_phases), ("aligned", G.aligned_phases)):
                    got, error = {}, None
                    try:
                        x = np.column_stack([T.checked_series(row[f"_{k}"]) for k in range(len(channels))])
                        got = G.cross_errors(x, make(x, T.replicate_stream(seed, int(row["replicate"]))))
                    except Exception as e:  # a cell's failure is a result of that cell
                        error = f"{type(e).__name__}: {e}"[:200]
                    rows.append({**{c: row[c] for c in (*cell, "replicate")}, "kind": kind, **got, "error": error})
            yield pd.DataFrame(rows, columns=names)

    return tasks.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in cell) + ", replicate int, kind string, spectral_error double, cross_error double, cross_ratio double, error string")


@query("cross_surrogate_errors")
def cross_surrogate_errors(spark, sf_dir):
    """Surrogates of a cell's channels together, by shared phases and by aligned phases and ranks: errors of spectra and of correlations at 30 lags both ways."""
    return joint_surrogate_errors(measures(spark, sf_dir), CELL, "day", ["x", "y"], 19)


# ---- rolling origins ----

CONFIGS = {"base": [("x", 0), ("x", 1)], **{f"y@{k}": [("x", 0), ("x", 1), ("y", k)] for k in (0, 2, 4, 8)}}
HORIZONS, VALIDATION = (1, 4), 1


def composites(spark, sf_dir) -> DataFrame:
    """Means of measures() over composites of eight days, with year and slot."""
    d = measures(spark, sf_dir).withColumn("year", F.year("day")).withColumn("slot", F.least(F.floor((F.dayofyear("day") - 1) / 8), F.lit(45)).cast("int"))
    return d.groupBy("cell", "year", "slot").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("step", F.col("year") * 46 + F.col("slot"))


def _folds(series: DataFrame) -> list[tuple[int, int]]:
    """The last three years, each a fold."""
    last = series.agg(F.max("year")).first()[0] or 0
    return [(y, y) for y in range(last - 2, last + 1)]


def _fold_errors(spark, sf_dir) -> DataFrame:
    series = composites(spark, sf_dir)
    return O.fold_errors(series, CELL, "step", "year", "slot", ["x", "y"], "x", CONFIGS, HORIZONS, _folds(series), VALIDATION).cache()


@query("rolling_origin_folds")
def rolling_origin_folds(spark, sf_dir):
    """A fold's choice of predictors, lag and theta in the years before its test, and its test error."""
    errors = _fold_errors(spark, sf_dir)
    choice = O.chosen(errors, CELL, list(CONFIGS), "base")
    test = O.origin_errors(errors, choice, CELL).groupBy(*CELL, "fold", "horizon", "predictors", "model").agg(F.count("error").alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("test_rmse"))
    return choice.join(test, [*CELL, "fold", "horizon", "predictors", "model"])


@query("rolling_origin_scores")
def rolling_origin_scores(spark, sf_dir):
    """Errors over all folds, gains of the joint predictors over the base, and whether they err less."""
    errors = _fold_errors(spark, sf_dir)
    return O.origin_scores(O.origin_errors(errors, O.chosen(errors, CELL, list(CONFIGS), "base"), CELL), CELL)
