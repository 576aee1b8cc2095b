"""Batches over cells, variables and windows, in parts that can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.kernels import dynamics as D
from sedge.operators import series_tests as T
from sedge.plans.coupled import measures
from sedge.plans.registry import query
from sedge.sources.cubes import DAYS, fitting, read_points, write_cube
from sedge.sources.parts import Batch, scratch
from sedge.sources.tables import read

SPEC = {"status": "frozen", "version": 1, "descriptors": {"ordinal": 4}, "surrogates": {"count": 39, "seed": 3}, "report": {"digits": 3}}
#: The sections that results depend on.
USED = ("descriptors", "surrogates")
KEYS = ["variable", "window", "cell"]


def windowed(series: DataFrame) -> DataFrame:
    """(variable, window, cell, day, v, part): each variable of each cell, whole and in halves of the table's span."""
    ends = series.agg(F.min("day").alias("a"), F.max("day").alias("b")).select("a", "b", F.date_add("a", (F.datediff("b", "a") / 2).cast("int")).alias("m"))
    long = series.select("cell", "day", F.explode(F.array(F.struct(F.lit("x").alias("variable"), F.col("x").alias("v")), F.struct(F.lit("y").alias("variable"), F.col("y").alias("v")))).alias("s")).select("cell", "day", "s.*")
    half = F.when(F.col("day") <= F.col("m"), "first").otherwise("second")
    rows = long.crossJoin(F.broadcast(ends)).withColumn("window", F.explode(F.array(F.lit("whole"), half))).drop("a", "b", "m")  # ends is one row
    return rows.withColumn("part", F.concat_ws("|", *KEYS))


@query("resumed_descriptor_batch")
def resumed_descriptor_batch(spark, sf_dir):
    """Ordinal descriptors of two variables and three windows against 39 surrogates, in parts; a run that stops after half of its rounds is taken up by the next, which computes the rest."""
    series = windowed(measures(spark, sf_dir))

    def compute(parts: DataFrame) -> DataFrame:
        chosen = series.join(parts, "part", "left_semi")
        rows = T.suite(chosen, KEYS, "day", "v", lambda x: dict(zip(("entropy", "complexity"), D.entropy_complexity(D.ordinal_counts(x, SPEC["descriptors"]["ordinal"])), strict=True)), SPEC["surrogates"]["count"], SPEC["surrogates"]["seed"])
        return rows.withColumn("part", F.concat_ws("|", *KEYS))

    folder, parts = scratch(spark), series.select("part").distinct()
    Batch(spark, folder, SPEC, USED).run(parts, compute, size=6, rounds=1)  # as if killed
    batch = Batch(spark, folder, {**SPEC, "report": {"digits": 4}}, USED)
    batch.run(parts, compute, size=6)
    return batch.results().drop("part")


_YEARS = "SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, count(*) AS orders, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1"


@query("resumed_yearly_totals", f"WITH t AS ({_YEARS}) SELECT part, orders, total, true AS sound FROM t")
def resumed_yearly_totals(spark, sf_dir):
    """Totals by year, two years a round, taken up after one round; sound if the results are what the manifest says."""
    orders = read(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"]).withColumn("part", F.year("o_orderdate").cast("string"))

    def compute(parts: DataFrame) -> DataFrame:
        return orders.join(parts, "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("orders"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"))

    batch = Batch(spark, scratch(spark), SPEC, USED)
    for rounds in (1, None):
        batch.run(orders.select("part"), compute, size=2, rounds=rounds)
    bad = batch.damaged().select("part", F.lit(False).alias("_sound"))
    return batch.results().drop("round").join(bad, "part", "left").select("part", "orders", "total", F.coalesce("_sound", F.lit(True)).alias("sound"))


@query("blocked_point_reads", """WITH c AS (SELECT CAST(l_shipdate AS DATE) AS day, (l_suppkey // 10) * 0.25 AS lat, (l_suppkey % 10) * 0.25 AS lon, round(sum(l_quantity), 6) AS x FROM lineitem GROUP BY 1, 2, 3),
    p AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, ((o_custkey % 100) // 10) * 0.25 AS lat, (o_custkey % 10) * 0.25 AS lon FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997)
    SELECT k, p.day, p.lat, p.lon, c.x + 0.0 AS x FROM p LEFT JOIN c ON c.day = p.day AND c.lat = p.lat AND c.lon = p.lon""")
def blocked_point_reads(spark, sf_dir):
    """A cube of days and places written in chunks, read at the places and days of urgent orders of one year: only chunks that they touch."""
    items = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    place = lambda k: ((F.floor(k / 10) * 0.25).alias("lat"), ((k % 10) * 0.25).alias("lon"))
    placed = items.select(F.to_date("l_shipdate").alias("day"), *place(F.col("l_suppkey")), "l_quantity")
    cube = placed.groupBy("day", "lat", "lon").agg(F.round(F.sum("l_quantity"), 6).alias("x"))
    orders = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and year(o_orderdate) = 1997")
    points = orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), *place(F.col("o_custkey") % 100))
    path, degrees = scratch(spark), fitting(placed, "day", "lat", "lon")
    write_cube(cube, path, "day", "lat", "lon", DAYS, degrees)
    return read_points(spark, path, points, "day", "lat", "lon", ["x"], DAYS, degrees).select("k", "day", "lat", "lon", (F.col("x") + F.lit(0.0)).alias("x"))
