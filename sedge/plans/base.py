"""The series that the queries share, as DataFrames and as the same tables in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.numbers import rounded
from sedge.operators import series as S
from sedge.sources.tables import read

CELL = ["cell"]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by return flag and day: a daily series per cell."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    return rows.groupBy("cell", "day").agg(F.sum("l_quantity").alias("x"), F.count(F.lit(1)).alias("n"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily() on all days; x is null where nothing was shipped."""
    return S.spine(daily(spark, sf_dir), CELL).select("cell", "day", "x")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily() on all days, 0 where nothing was shipped: series without gaps."""
    return dense(spark, sf_dir).withColumn("x", F.coalesce("x", F.lit(0.0)))


def r6(x: Column | str, name: str) -> Column:
    return rounded(F.col(x) if isinstance(x, str) else x).alias(name)


DAILY = "daily AS (SELECT l_returnflag AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2)"
DENSE = (
    DAILY
    + """, days AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
    dense AS (SELECT c.cell, d.day, y.x FROM (SELECT DISTINCT cell FROM daily) c CROSS JOIN days d LEFT JOIN daily y ON y.cell = c.cell AND y.day = d.day)"""
)


def smooth_sql(source: str, name: str, half: int, x: str) -> str:
    """SQL of smooth_year: source has cell, doy and x."""
    return f"""{name}_d AS (SELECT c.cell, g.doy, s.{x} AS v FROM (SELECT DISTINCT cell FROM {source}) c CROSS JOIN (SELECT unnest(range(1, 367)) AS doy) g LEFT JOIN {source} s ON s.cell = c.cell AND s.doy = g.doy),
    {name}_t AS (SELECT cell, doy, t, doy + t AS pos, v FROM {name}_d CROSS JOIN (VALUES (-366), (0), (366)) u(t)),
    {name}_k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS ba, last_value(v IGNORE NULLS) OVER b AS bv,
        first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS aa, first_value(v IGNORE NULLS) OVER a AS av FROM {name}_t
        WINDOW b AS (PARTITION BY cell ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cell ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {name}_f AS (SELECT cell, doy, t, pos, coalesce(v, bv + (av - bv) * (pos - ba) / (aa - ba), bv, av) AS v FROM {name}_k),
    {name} AS (SELECT cell, doy, v FROM (SELECT cell, doy, t, avg(v) OVER (PARTITION BY cell ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS v FROM {name}_f) WHERE t = 0)"""
