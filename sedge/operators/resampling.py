"""Bootstraps and permutations as joins: what a draw takes is a hash of the seed, the draw and the place, so any engine draws the same.

Statistics of resampled clusters need the clusters' sums only, so rows are
folded by cluster first and draws meet a table of one row a cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.inference import bootstrap_p


def drawn(seed: str, *parts: Column) -> Column:
    """A number below 2**32 from a seed and parts: eight digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def picks(clusters: DataFrame, key: str, draws: int, seed: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, key, times): how often each draw, of as many clusters as there are, takes each. clusters: by and key, one row each."""
    w = Window.partitionBy(*by)
    numbered = clusters.select(*by, key, (F.row_number().over(w.orderBy(key)) - 1).cast("long").alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    taken = numbered.groupBy(*by).agg(F.max("_n").alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition("draw", *by).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    taken = taken.select(*by, "draw", (drawn(seed, F.col("draw"), F.col("_k")) % F.col("_n")).alias("_i")).groupBy(*by, "draw", "_i").agg(F.count(F.lit(1)).alias("times"))
    return taken.join(numbered.drop("_n"), [*by, "_i"]).select(*by, "draw", key, "times")


def resampled(sums: DataFrame, key: str, columns: Sequence[str], draws: int, seed: str, by: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """(by, draw, within, columns): the columns summed over the clusters that a draw takes, as often as it takes them; draw -1 is the data.

    sums: a row for each by, key and within. Clusters are drawn within each `by`.
    """
    taken = picks(sums.select(*by, key).distinct(), key, draws, seed, by)
    rows = sums.join(taken, [*by, key])
    out = rows.groupBy(*by, "draw", *within).agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in columns))
    data = sums.groupBy(*by, *within).agg(*(F.sum(c).alias(c) for c in columns)).withColumn("draw", F.lit(-1))
    return data.select(*by, "draw", *within, *columns).unionAll(out.select(*by, "draw", *within, *columns))


def interval(draws: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, estimate, lo, hi, p, draws): the data's value (draw -1), the middle 95 % of the draws that have one, and the p around 0."""
    v = F.when(F.col("draw") >= 0, F.col(x))
    ends = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col(x))).alias("estimate"), ends.alias("_e"), bootstrap_p(v).alias("p"), F.count(v).alias("draws")).select(*by, "estimate", F.col("_e")[0].alias("lo"), F.col("_e")[1].alias("hi"), "p", "draws")


def permuted(values: DataFrame, key: str, x: str, draws: int, seed: str) -> DataFrame:
    """(draw, key, x): the values dealt anew to the keys in every draw; draw -1 is the data. values are a bounded grid of cells."""
    numbered = values.select(F.col(key), F.col(x), (F.row_number().over(Window.orderBy(key)) - 1).alias("_i"))
    places = numbered.select(key).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col(key).cast("string"))), key)
    dealt = places.withColumn("_i", F.row_number().over(order) - 1).join(numbered.select("_i", x), "_i")
    return dealt.select("draw", key, x).unionAll(values.select(F.lit(-1).alias("draw"), key, x))


# ---- the same in SQL ----


def picks_sql(name: str, source: str, key: str, draws: int, seed: str, by: str = "1") -> str:
    """CTEs that end in `name` (b, draw, key, times). source: a table expression with the key and what `by` names, one row a cluster."""
    return f"""{name}_i AS (SELECT {by} AS b, {key}, row_number() OVER (PARTITION BY {by} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
    {name}_k AS (SELECT b, n, draw, unnest(range(n)) AS k FROM (SELECT DISTINCT b, n FROM {name}_i) CROSS JOIN (SELECT unnest(range({draws})) AS draw)),
    {name}_t AS (SELECT b, draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || k), 1, 8) AS BIGINT) % n AS i, count(*) AS times FROM {name}_k GROUP BY 1, 2, 3),
    {name} AS (SELECT t.b, t.draw, c.{key}, t.times FROM {name}_t t JOIN {name}_i c ON c.b = t.b AND c.i = t.i)"""


def interval_sql(source: str, by: str, x: str, digits: int = 6) -> str:
    """Estimate, bounds, p and draws of `source` (by, draw, x), as interval() has them."""
    v = f"CASE WHEN draw >= 0 THEN {x} END"
    return f"""SELECT {by}{', ' if by else ''}round(max(CASE WHEN draw < 0 THEN {x} END), {digits}) + 0.0 AS estimate, round(quantile_cont({v}, 0.025), {digits}) + 0.0 AS lo, round(quantile_cont({v}, 0.975), {digits}) + 0.0 AS hi,
    round(least(2 * (least(count(CASE WHEN {v} <= 0 THEN 1 END), count(CASE WHEN {v} >= 0 THEN 1 END)) + 1) / CAST(count({v}) + 1 AS DOUBLE), 1.0), {digits}) + 0.0 AS p, count({v}) AS draws FROM {source}{' GROUP BY ' + by if by else ''}"""
