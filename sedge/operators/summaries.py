"""Summaries of tests over cells: verdicts, permutations shared by all cells, variants beside their base, trend fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators import inference as I

# The Chebyshev fit of the complementary error function, good to 1.2e-7 of its value.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_normal_sql(z: str) -> str:
    """The chance of a normal value farther from 0 than z, as SQL of both engines; the exact one needs an error function, which neither has."""
    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"{t} * exp(-({z}) * ({z}) / 2 + {poly})"


def gate_verdict(rates: DataFrame, power: float, size: float, required: int) -> DataFrame:
    """A verdict for each descriptor from rejection rates at the greatest length and noise.

    rates: descriptor, control, role ('positive', 'size' or 'alert'), n, noise,
    rate. Passed: at least `required` positives with a rate of `power` or more,
    and every size control at `size` or less; no size control, nothing against it.
    """
    last = rates.join(F.broadcast(rates.agg(F.max("n").alias("n"), F.max("noise").alias("noise"))), ["n", "noise"])
    of = lambda role: F.col("role") == role
    g = last.groupBy("descriptor").agg(
        F.count(F.when(of("positive"), 1)).alias("positives"),
        F.count(F.when(of("positive") & (F.col("rate") >= power), 1)).alias("powered"),
        F.count(F.when(of("size") & (F.col("rate") > size), 1)).alias("oversized"),
        F.max(F.when(of("alert"), F.col("rate"))).alias("alert_rate"),
    )
    return g.withColumn("passed", (F.col("powered") >= required) & (F.col("oversized") == 0))


def permutation_summary(gains: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median gain over cells against the medians of permutations that all cells share, and the share of cells beyond their own permutations.

    gains: by, cell, draw (0 is the data), gain. The share is of cells whose
    gain is over the 95th percentile of their own draws; its p holds each draw
    against the percentile of the cell's other draws. A cell's draws are a
    bounded array (the number of permutations).
    """
    null = gains.where("draw > 0")
    w = Window.partitionBy(*by, "cell").orderBy("gain", "draw")
    sorted_draws = null.groupBy(*by, "cell").agg(F.sort_array(F.collect_list("gain")).alias("_g"))
    placed = null.withColumn("_i", F.row_number().over(w) - 1).join(sorted_draws, [*by, "cell"])
    # the percentile of the others: the sorted draws without the one at _i
    without = F.expr("filter(_g, (v, j) -> j <> _i)")
    over = placed.withColumn("_o", without).withColumn("_q", _interpolated("_o", 0.95)).withColumn("beyond", F.when(F.col("gain") > F.col("_q"), 1.0).otherwise(0.0))
    seen = gains.where("draw = 0").join(sorted_draws, [*by, "cell"], "left").withColumn("beyond", F.when(F.col("gain") > _interpolated("_g", 0.95), 1.0).otherwise(0.0))
    per = lambda df: df.groupBy(*by, "draw").agg(F.round(F.percentile("gain", 0.5), 9).alias("median"), F.round(F.avg("beyond"), 9).alias("share"))
    data = per(seen).drop("draw").withColumnsRenamed({"median": "gain_median", "share": "cells_beyond"}).join(seen.groupBy(*by).agg(F.count(F.lit(1)).alias("cells")), by)
    joined = data.join(per(over), by, "left")
    n = F.count("median")
    return joined.groupBy(*by, "cells", "gain_median", "cells_beyond").agg(
        F.percentile("median", 0.5).alias("null_median"),
        ((1 + F.count(F.when(F.col("median") >= F.col("gain_median"), 1))) / (n + 1)).alias("p"),
        ((1 + F.count(F.when(F.col("share") >= F.col("cells_beyond"), 1))) / (n + 1)).alias("p_beyond"),
    )


def _interpolated(array: str, q: float) -> Column:
    """The quantile of a sorted array, between its two nearest values."""
    at = f"({q} * (size({array}) - 1))"
    return F.expr(f"case when size({array}) > 0 then {array}[int(floor({at}))] + ({at} - floor({at})) * ({array}[int(ceil({at}))] - {array}[int(floor({at}))]) end")


def against_base(rows: DataFrame, by: Sequence[str], base: str, alpha: float) -> DataFrame:
    """Each variant beside the base in the same cells: share rejected, median z, rank correlation with the base, rank correlation with the exposure given a control.

    rows: by, variant, cell, z, p, exposure, control.
    """
    ref = rows.where(F.col("variant") == base).select(*by, "cell", F.col("z").alias("base_z"))
    t = rows.join(ref, [*by, "cell"])
    keys = [*by, "variant"]
    shares = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.avg(F.when(F.col("p") <= alpha, 1.0).otherwise(0.0)).alias("rejects"), F.percentile("z", 0.5).alias("z_median"))
    rho = I.spearman(t, keys, "z", "base_z").select(*keys, F.col("rho").alias("rho_base"))
    partial = I.partial_spearman(t, keys, "exposure", "z", "control").select(*keys, "partial")
    return shares.join(rho, keys, "left").join(partial, keys, "left")


def trend_field(rows: DataFrame, by: Sequence[str], cell: str, t: str, x: str, q: float, least: int = 8) -> DataFrame:
    """Slope by ten steps of t of each cell, p of Mann-Kendall with ties and autocorrelation, p adjusted over the cells of a field, and whether it is under q.

    Cells with fewer than `least` values stay, without slope, p and mark.
    """
    s = I.autocorrelated_trend(rows, [*by, cell], t, x)
    enough = F.col("n") >= least
    z = F.when(enough & (F.col("variance") > 0), (F.col("s") - F.signum("s")) / F.sqrt(F.col("variance") * F.col("ratio")))
    tested = s.withColumn("z", z).withColumn("p", F.when(F.col("z").isNotNull(), F.round(F.expr(two_sided_normal_sql("z")), 6)))
    marked = I.adjusted(tested, by, "p").withColumn("marked", F.coalesce(F.col("bh") < q, F.lit(False)))
    return marked.select(*by, cell, "n", F.when(enough, 10 * F.col("slope")).alias("slope"), "ratio", "p", F.col("bh").alias("q"), "marked")
