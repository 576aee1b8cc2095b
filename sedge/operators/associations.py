"""Rank associations of very many models at once: exposure, response and controls are columns of one table, models rows of a plan.

One scan deals the cells to the models; ranks are windows within a model, and
all that least squares on ranks needs are sums of products by model and spatial
block. Sums of blocks add up, so a bootstrap of blocks is a join, too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators import resampling as B
from sedge.operators import spatial as P
from sedge.operators.inference import average_rank


@dataclass(frozen=True)
class Model:
    """where: SQL of the cells that take part."""

    name: str
    exposure: str
    response: str
    controls: tuple[str, ...] = ()
    where: str = "true"


def variables(models: Sequence[Model]) -> list[str]:
    """x, y and as many controls as the model with most has."""
    return ["x", "y", *(f"c{k + 1}" for k in range(max((len(m.controls) for m in models), default=0)))]


def dealt(cells: DataFrame, key: str, lat: str, lon: str, models: Sequence[Model]) -> DataFrame:
    """(model, key, lat, lon, n, and the ranks of x, y and the controls within the model): a row for each model and cell that has all its values. A control that a model lacks is 0."""
    names = variables(models)
    rows = []
    for m in models:
        used = [m.exposure, m.response, *m.controls]
        values = [F.col(c).cast("double").alias(v) for c, v in zip(used, names, strict=False)] + [F.lit(0.0).alias(v) for v in names[len(used) :]]
        ok = F.expr(m.where) & F.expr(" and ".join(f"{c} is not null" for c in used))
        rows.append(F.when(ok, F.struct(F.lit(m.name).alias("model"), *values)))
    long = cells.select(key, lat, lon, F.explode(F.array(*rows)).alias("_m")).where("_m is not null").select("_m.model", key, lat, lon, *(f"_m.{v}" for v in names))
    return long.select("model", key, lat, lon, *(average_rank(v, "model").alias(v) for v in names))


def moments(names: Sequence[str]) -> dict[str, str]:
    """Sums of products by name, as SQL."""
    return {"n": "1", **{f"s_{v}": v for v in names}, **{f"s_{a}_{b}": f"{a} * {b}" for a, b in combinations_with_replacement(names, 2)}}


def correlation_steps(names: Sequence[str]) -> list[dict[str, str]]:
    """Steps of SQL columns from sums to `raw` and `partial`: plain correlations, then those given one control more each; a constant variable has none with others (0), and null as x or y."""
    var = {v: f"(n * s_{v}_{v} - s_{v} * s_{v})" for v in names}
    pairs = list(combinations(names, 2))
    first = {f"r0_{a}_{b}": f"CASE WHEN {var[a]} * {var[b]} > 1e-9 THEN (n * s_{a}_{b} - s_{a} * s_{b}) / sqrt({var[a]} * {var[b]}) {'' if (a, b) == ('x', 'y') else 'ELSE 0.0 '}END" for a, b in pairs}
    steps, left = [first], list(names)
    for k, control in enumerate(names[2:]):
        left.remove(control)
        r = lambda a, b, k=k: f"r{k}_{a}_{b}" if (a, b) in pairs else f"r{k}_{b}_{a}"
        steps.append({f"r{k + 1}_{a}_{b}": f"CASE WHEN (1 - {r(a, control)} * {r(a, control)}) * (1 - {r(b, control)} * {r(b, control)}) > 1e-9 THEN ({r(a, b)} - {r(a, control)} * {r(b, control)}) / sqrt((1 - {r(a, control)} * {r(a, control)}) * (1 - {r(b, control)} * {r(b, control)})) END" for a, b in combinations(left, 2)})
    return steps


def with_partial(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds raw and partial, the rank correlations of x and y without and with the controls, to sums of products."""
    for step in correlation_steps(names):
        sums = sums.withColumns({k: F.expr(v) for k, v in step.items()})
    return sums.withColumn("raw", F.round("r0_x_y", 9)).withColumn("partial", F.round(f"r{len(names) - 2}_x_y", 9))


def block(lat: str, lon: str, size: float) -> str:
    """SQL of the number of a spatial block."""
    return f"CAST(floor({lat} / {size}) AS BIGINT) * 1000 + CAST(floor({lon} / {size}) AS BIGINT)"


def battery(cells: DataFrame, key: str, lat: str, lon: str, models: Sequence[Model], size: float, draws: int, seed: str) -> DataFrame:
    """(model, cells, raw, partial, lo, hi, p, draws): each model's rank associations, with the interval and p of the partial one from draws of whole blocks.

    Ranks are those of the data in every draw. A model whose exposure or
    response is constant has nulls; one without cells has no row.
    """
    names = variables(models)
    sums = dealt(cells, key, lat, lon, models).groupBy("model", F.expr(block(lat, lon, size)).alias("block")).agg(*(F.sum(F.expr(v)).cast("double").alias(k) for k, v in moments(names).items()))
    drawn = with_partial(B.resampled(sums, "block", list(moments(names)), draws, seed, ["model"]), names)
    data = drawn.where("draw = -1").select("model", F.col("n").cast("long").alias("cells"), "raw")
    return data.join(B.interval(drawn, ["model"], "partial").withColumnRenamed("estimate", "partial"), "model")


def residuals(ranks: DataFrame, names: Sequence[str]) -> DataFrame:
    """ranks with rx and ry, what the controls leave of x and y, and e, what rx leaves of ry.

    One variable at a time is taken from the rest. The slopes come from one
    table of sums of products (a row a model, whose number the plan bounds), so
    ranks are read twice, however many controls there are. A variable of which
    those before leave under 1e-10 of its squares takes nothing.
    """
    left = [*names[2:], "x", "y"]
    pair = lambda a, b: f"_s_{a}_{b}" if left.index(a) <= left.index(b) else f"_s_{b}_{a}"
    pairs = list(combinations_with_replacement(left, 2))
    sums = ranks.groupBy("model").agg(F.count(F.lit(1)).alias("_n"), *(F.avg(v).alias(f"_m_{v}") for v in left), *(F.sum(F.col(a) * F.col(b)).alias(pair(a, b)) for a, b in pairs))
    sums = sums.withColumns({pair(a, b): F.expr(f"{pair(a, b)} - _n * _m_{a} * _m_{b}") for a, b in pairs}).withColumns({f"_w_{v}": F.col(pair(v, v)) for v in left})
    for k, v in enumerate(left[:-1]):
        rest = left[k + 1 :]
        some = F.col(pair(v, v)) > F.greatest(F.col(f"_w_{v}") * 1e-10, F.lit(1e-9))
        sums = sums.withColumns({f"_b_{v}_{w}": F.when(some, F.col(pair(v, w)) / F.col(pair(v, v))).otherwise(0.0) for w in rest})
        sums = sums.withColumns({pair(w, u): F.col(pair(w, u)) - F.col(f"_b_{v}_{w}") * F.col(pair(v, u)) for w, u in combinations_with_replacement(rest, 2)})
    slopes = sums.select("model", *(f"_m_{v}" for v in left), *(f"_b_{v}_{w}" for v, w in combinations(left, 2)))
    rows = ranks.join(F.broadcast(slopes), "model").withColumns({f"_{v}": F.col(v) - F.col(f"_m_{v}") for v in left})
    for k, v in enumerate(left[:-1]):
        if v == "x":
            rows = rows.withColumn("rx", F.col("_x")).withColumn("ry", F.col("_y"))
        rows = rows.withColumns({f"_{w}": F.col(f"_{w}") - F.col(f"_b_{v}_{w}") * F.col(f"_{v}") for w in left[k + 1 :]})
    return rows.select(*ranks.columns, "rx", "ry", F.col("_y").alias("e"))


#: Nodes and weights on (0, 1) of the double exponential rule, which holds at ends where powers below 1 meet.
_STEP = 0.03125
_NODES = [(1 / (1 + math.exp(math.pi * math.sinh(-k * _STEP))), _STEP * math.pi / 4 * math.cosh(k * _STEP) / math.cosh(math.pi / 2 * math.sinh(k * _STEP)) ** 2) for k in range(-104, 105)]


def _integral(f, dialect: str) -> str:
    """SQL of the integral over (0, 1) of f(node)."""
    nodes, weights = (", ".join(f"{v[i]!r}" for v in _NODES) for i in (0, 1))
    if dialect == "spark":
        return f"aggregate(zip_with(array({nodes}), array({weights}), (u, w) -> cast(w as double) * {f('cast(u as double)')}), cast(0 as double), (a, v) -> a + v)"
    return f"list_sum(list_transform(list_zip([{nodes}], [{weights}]), lambda z: z[2]::DOUBLE * {f('z[1]::DOUBLE')}))"


def student_sql(t: str, df: str, dialect: str = "spark") -> str:
    """SQL of the chance that Student's t with df (above 0) degrees of freedom is farther from 0 than t.

    The tail is the integral of sin(v) ** (df - 1) up to atan(sqrt(df) / |t|),
    over that up to pi / 2. Under two degrees v ** (df - 1), whose integral is
    known, is taken out, since the rest is smooth. Good to 1e-9.
    """
    plain = lambda end: f"(({end}) * {_integral(lambda u: f'pow(sin(({end}) * {u}), ({df}) - 1)', dialect)})"
    ratio = lambda end, u: f"(sin(({end}) * {u}) / (({end}) * {u}))"
    small = lambda end: f"(pow({end}, {df}) / ({df}) + ({end}) * {_integral(lambda u: f'pow(({end}) * {u}, ({df}) - 1) * (pow({ratio(end, u)}, ({df}) - 1) - 1)', dialect)})"
    far, whole = f"atan2(sqrt({df}), abs({t}))", "(pi() / 2)"
    return f"CASE WHEN ({df}) >= 2 THEN {plain(far)} / {plain(whole)} WHEN ({df}) > 0 THEN {small(far)} / {small(whole)} END"


def student_two_sided(t: Column, df: Column, rows: DataFrame, name: str) -> DataFrame:
    """rows with the chance that Student's t is farther from 0 than t."""
    return rows.withColumn("_t", t).withColumn("_df", df).withColumn(name, F.expr(student_sql("_t", "_df"))).drop("_t", "_df")


def spatial_inference(cells: DataFrame, key: str, lat: str, lon: str, models: Sequence[Model], radius: float, width: float, reach: float) -> DataFrame:
    """(model, cells, partial, n_eff, df, p, moran): the partial rank association's p with the degrees of freedom that are left where cells are alike nearby.

    n_eff is Clifford, Richardson and Hemon's: 1 + n^2 / sum over pairs of the
    products of both residuals' autocorrelations in classes of `width` degrees
    up to `reach` (all pairs if the table spans less), which meet by blocks;
    df is n_eff - 2 less one for each control. moran is Moran's I of what is left of the response, over
    neighbours within `radius`.
    """
    names = variables(models)
    r = residuals(dealt(cells, key, lat, lon, models), names).select("model", F.col(key).alias("_k"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.lit(1.0).alias("one"), "rx", "ry", "e").cache()
    stats = r.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rx") * F.col("rx")).alias("xx"), F.sum(F.col("ry") * F.col("ry")).alias("yy"), F.sum(F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("e") * F.col("e")).alias("ee"))
    # a row a cell with all models' values; rows of one key and place add up, as their products do
    by = lambda m, v: F.sum(F.when(F.col("model") == m, F.col(v)).otherwise(0.0))
    wide = r.groupBy("_k", "_lat", "_lon").agg(*(by(m.name, v).alias(f"{v}{i}") for i, m in enumerate(models) for v in ("one", "rx", "ry", "e")))
    classes = P.class_sums(wide, "_k", "_lat", "_lon", [m.name for m in models], radius, width, reach)
    rho = lambda g, s: F.col(g) / F.col("w") / (F.col(s) / F.col("n"))
    total = classes.join(stats, "model").groupBy("model").agg(F.sum(F.col("w") * rho("gx", "xx") * rho("gy", "yy")).alias("_v"), F.sum("m").alias("m"), F.sum("ge").alias("ge"))
    g = stats.join(total, "model", "left")
    variance = F.greatest((F.col("n") + F.coalesce("_v", F.lit(0.0))) / (F.col("n") * F.col("n")), 1 / F.col("n"))
    count = F.create_map(*(F.lit(v) for m in models for v in (m.name, len(m.controls))))
    g = g.withColumn("n_eff", 1 + 1 / variance).withColumn("df", F.greatest(F.col("n_eff") - 2 - count[F.col("model")], F.lit(1e-9)))
    g = g.withColumn("partial", F.when((F.col("xx") > 1e-9) & (F.col("yy") > 1e-9), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))))
    g = student_two_sided(F.col("partial") * F.sqrt(F.col("df") / F.greatest(1 - F.col("partial") * F.col("partial"), F.lit(1e-12))), F.col("df"), g, "p")
    moran = F.when((F.col("m") > 0) & (F.col("ee") > 1e-9), F.col("n") / F.col("m") * F.col("ge") / F.col("ee"))
    return g.select("model", F.col("n").alias("cells"), "partial", "n_eff", "df", "p", moran.alias("moran"))
