"""Batteries of rank associations over a plan of models: suppliers as cells of a grid, with what they ship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators import associations as A
from sedge.operators import inference as I
from sedge.operators import resampling as B
from sedge.plans.base import r6
from sedge.plans.registry import query
from sedge.sources.tables import read

DRAWS = 199
CONTROLS = ("lat", "n", "d")
#: The plan: exposure, response, controls, and the cells that take part.
MODELS = [
    A.Model("registered", "q", "bal", CONTROLS),
    A.Model("without_controls", "q", "bal"),
    A.Model("more_controls", "q", "bal", (*CONTROLS, "lon")),
    A.Model("change", "late", "bal", CONTROLS),
    A.Model("even_cells", "q", "bal", CONTROLS, "k % 2 = 0"),
    A.Model("other_exposure", "n", "d", ("lat",)),
]
PLACEBOS = [A.Model("placebo", "k", "bal", CONTROLS), A.Model("placebo_plain", "k", "bal"), A.Model("reversed", "bal", "k", CONTROLS), A.Model("longitude", "lon", "bal", ("lat",))]
ROBUST = [A.Model("observed", "q", "bal", CONTROLS), A.Model("null", "half", "bal", CONTROLS), A.Model("excess", "excess", "bal", CONTROLS), A.Model("even_cells", "q", "bal", CONTROLS, "k % 2 = 0")]

_CELLS = """f AS (SELECT l_suppkey AS k, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 3) AS q, round(avg(l_discount), 4) AS d, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 3) AS half, round(avg(CASE WHEN year(l_shipdate) > 1998 THEN l_quantity END) - avg(CASE WHEN year(l_shipdate) <= 1998 THEN l_quantity END), 3) AS late FROM lineitem GROUP BY 1),
    cells AS (SELECT f.*, round(q - half, 3) AS excess, (f.k // 10) * 0.25 AS lat, (f.k % 10) * 0.25 AS lon, s_acctbal AS bal FROM f JOIN supplier ON s_suppkey = f.k)"""


def cells(spark, sf_dir) -> DataFrame:
    """Suppliers on a grid, with balance, number of lines, mean quantity (of all, of one half, change) and discount."""
    x, year = F.col("l_quantity"), F.year("l_shipdate")
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg(x), 3).alias("q"), F.round(F.avg("l_discount"), 4).alias("d"), F.round(F.avg(F.when(F.col("l_linestatus") == "F", x)), 3).alias("half"),
        F.round(F.avg(F.when(year > 1998, x)) - F.avg(F.when(year <= 1998, x)), 3).alias("late"),
    )
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return f.join(s, "k").select("*", F.round(F.col("q") - F.col("half"), 3).alias("excess"), (F.floor(F.col("k") / 10) * 0.25).alias("lat"), ((F.col("k") % 10) * 0.25).alias("lon"))


def battery_sql(models: list[A.Model], sizes: tuple[float, ...], seed: str) -> str:
    """A.battery() of each block size in SQL."""
    names = A.variables(models)
    used = [(m, [m.exposure, m.response, *m.controls]) for m in models]
    long = " UNION ALL ".join(f"SELECT '{m.name}' AS model, lat, lon, {', '.join(f'CAST({c} AS DOUBLE) AS {v}' for c, v in zip([*u, *['0.0'] * (len(names) - len(u))], names, strict=True))} FROM cells WHERE {m.where} AND {' AND '.join(f'{c} IS NOT NULL' for c in u)}" for m, u in used)
    ranks = ", ".join(f"rank() OVER (PARTITION BY model ORDER BY {v}) + (count(*) OVER (PARTITION BY model, {v}) - 1) / 2.0 AS {v}" for v in names)
    sums = A.moments(names)
    blocks = " UNION ALL ".join(f"SELECT model || '|{s}' AS run, {A.block('lat', 'lon', s)} AS block, {', '.join(f'CAST(sum({v}) AS DOUBLE) AS {k}' for k, v in sums.items())} FROM r GROUP BY 1, 2" for s in sizes)
    steps = A.correlation_steps(names)
    nested = ", ".join(f"d{k} AS (SELECT *, {', '.join(f'{v} AS {c}' for c, v in step.items())} FROM {'w' if not k else f'd{k - 1}'})" for k, step in enumerate(steps))
    return f"""WITH {_CELLS}, l AS ({long}), r AS (SELECT model, lat, lon, {ranks} FROM l), b AS ({blocks}), {B.picks_sql('p', 'b', 'block', DRAWS, seed, 'run')},
    w AS (SELECT b.run, draw, {', '.join(f'sum({k} * times) AS {k}' for k in sums)} FROM p JOIN b ON b.run = p.b AND b.block = p.block GROUP BY 1, 2 UNION ALL SELECT run, -1, {', '.join(f'sum({k})' for k in sums)} FROM b GROUP BY 1), {nested},
    v AS (SELECT run, draw, round(r{len(names) - 2}_x_y, 9) AS v FROM d{len(steps) - 1}), i AS ({B.interval_sql('v', 'run', 'v')}),
    a AS (SELECT run, CAST(n AS BIGINT) AS cells, round(r0_x_y, 6) + 0.0 AS raw FROM d{len(steps) - 1} WHERE draw = -1)
    SELECT split_part(run, '|', 1) AS model, CAST(split_part(run, '|', 2) AS DOUBLE) AS size, cells, raw, estimate AS partial, lo, hi, p, draws FROM i JOIN a USING (run)"""


def batteries(spark, sf_dir, models: list[A.Model], sizes: tuple[float, ...], seed: str) -> DataFrame:
    """A.battery() for each block size; draws are told by model and size."""
    table, out = cells(spark, sf_dir), None
    for s in sizes:
        got = A.battery(table, "k", "lat", "lon", models, s, DRAWS, seed).withColumn("size", F.lit(float(s)))
        out = got if out is None else out.unionAll(got)
    return out.select("model", "size", "cells", r6("raw", "raw"), r6("partial", "partial"), r6("lo", "lo"), r6("hi", "hi"), r6("p", "p"), "draws")


@query("association_battery", battery_sql(MODELS, (1.0,), "battery"))
def association_battery(spark, sf_dir):
    """Rank associations of every model of the plan, raw and given any number of controls, with intervals and p by drawing blocks."""
    return batteries(spark, sf_dir, MODELS, (1.0,), "battery")


@query("placebo_battery", battery_sql(PLACEBOS, (1.0,), "placebo"))
def placebo_battery(spark, sf_dir):
    """The battery with exposures that should tell nothing."""
    return batteries(spark, sf_dir, PLACEBOS, (1.0,), "placebo")


@query("robustness_battery", battery_sql(ROBUST, (1.0, 3.0), "robust"))
def robustness_battery(spark, sf_dir):
    """Observed, null and excess exposures and a subset, with blocks of two sizes."""
    return batteries(spark, sf_dir, ROBUST, (1.0, 3.0), "robust")


@query("spatial_inference_models")
def spatial_inference_models(spark, sf_dir):
    """P of the partial associations with the degrees of freedom that spatial likeness leaves, and Moran's I of the residuals."""
    return A.spatial_inference(cells(spark, sf_dir), "k", "lat", "lon", MODELS, 0.26, 0.5, 1000.0)


@query("registered_tests")
def registered_tests(spark, sf_dir):
    """The registered tests' p by blocks and by effective number, each adjusted over the family."""
    table = cells(spark, sf_dir)
    blocks = A.battery(table, "k", "lat", "lon", MODELS, 1.0, DRAWS, "battery").select("model", "cells", "partial", "lo", "hi", "p")
    spatial = A.spatial_inference(table, "k", "lat", "lon", MODELS, 0.26, 0.5, 1000.0).select("model", "n_eff", F.col("p").alias("p_n_eff"), "moran")
    both = blocks.join(spatial, "model").withColumn("_f", F.lit(1)).cache()  # a family of as many tests as the plan has models, which the adjustments read eight times
    one = I.adjusted(both, ["_f"], "p").withColumnsRenamed({"bh": "p_bh", "holm": "p_holm"})
    return I.adjusted(one, ["_f"], "p_n_eff").withColumnRenamed("holm", "p_n_eff_holm").drop("_f", "bh")
