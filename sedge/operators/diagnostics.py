"""Diagnostics of stationarity as windows and aggregates over each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.summaries import two_sided_normal_sql


def kolmogorov_sql(x: str) -> str:
    """The chance that the greatest distance of a Brownian bridge from 0 is over x, as SQL of both engines."""
    terms = " ".join(f"{'+' if k % 2 else '-'} exp(-2 * {k * k} * {x} * {x})" for k in range(1, 21))
    return f"(CASE WHEN {x} < 0.2 THEN 1.0 ELSE least(1.0, 2 * (0 {terms})) END)"


def block_diagnostics(series: DataFrame, cell: Sequence[str], order: str, x: str, blocks: int = 4, lags: int = 14) -> DataFrame:
    """Total linear change of each series with its p under autocorrelated errors, the p of a shift of the mean, and how far successive blocks differ.

    The change's error weighs `lags` autocovariances by 1 - l / (lags + 1); the
    shift is judged by the greatest partial sum of deviations. Blocks are as
    equal as can be, the first ones longer: ratio of their greatest to their
    least deviation, range of their means in deviations of the whole, range of
    their lag-one autocorrelations. alerts counts p or ranges beyond 0.05,
    1.5, 0.5 and 0.25; the shift has none. Missing values are left out; a
    constant series has nulls. A series is one ordered window, of bounded length.
    """
    whole, w = Window.partitionBy(*cell), Window.partitionBy(*cell).orderBy(order)
    rows = series.where(F.col(x).isNotNull()).select(*cell, order, F.col(x).alias("_x"))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_t", (F.row_number().over(w) - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).withColumn("_block", F.ntile(blocks).over(w))
    d = rows.withColumn("_d", F.col("_x") - F.avg("_x").over(whole)).withColumn("_c", F.col("_t") - F.avg("_t").over(whole))
    d = d.withColumn("_tt", F.sum(F.col("_c") * F.col("_c")).over(whole)).withColumn("_b", F.sum(F.col("_c") * F.col("_d")).over(whole) / F.col("_tt"))
    d = d.withColumn("_s", F.col("_c") * (F.col("_d") - F.col("_b") * F.col("_c"))).withColumn("_sum", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    weighed = sum(((1 - i / (lags + 1)) * F.coalesce(F.lag("_s", i).over(w), F.lit(0.0)) for i in range(1, lags + 1)), F.lit(0.0))
    d = d.withColumn("_lagged", weighed)
    squares = F.sum(F.col("_d") * F.col("_d"))
    trend = d.groupBy(*cell).agg(
        F.max("_n").alias("n"), F.max("_b").alias("change"), (F.sqrt(F.sum(F.col("_s") * (F.col("_s") + 2 * F.col("_lagged")))) / F.max("_tt")).alias("_se"),
        F.when(squares > 0, F.max(F.abs("_sum")) / F.sqrt(squares * F.count(F.lit(1)) / (F.count(F.lit(1)) - 1))).alias("_shift"), F.stddev_pop("_x").alias("_sd"),
    )
    trend = trend.withColumn("_z", F.when((F.col("_se") > 0) & (F.col("_sd") > 0), F.col("change") / F.col("_se")))
    inside = Window.partitionBy(*cell, "_block")
    b = rows.withColumn("_e", F.col("_x") - F.avg("_x").over(inside)).withColumn("_e1", F.lag("_e").over(inside.orderBy(order)))
    left = F.sum(F.col("_e") * F.col("_e"))
    b = b.groupBy(*cell, "_block").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("sd"), F.when(left > 0, F.sum(F.col("_e") * F.col("_e1")) / left).alias("r"))
    b = b.groupBy(*cell).agg((F.max("sd") / F.greatest(F.min("sd"), F.lit(1e-15))).alias("deviation_ratio"), (F.max("m") - F.min("m")).alias("_range"), (F.max("r") - F.min("r")).alias("acf_range"))
    out = trend.join(b, list(cell)).withColumn("change_p", F.expr(f"CASE WHEN _z IS NOT NULL THEN {two_sided_normal_sql('_z')} END")).withColumn("shift_p", F.expr(f"CASE WHEN _shift IS NOT NULL THEN {kolmogorov_sql('_shift')} END"))
    out = out.withColumn("mean_range", F.when(F.col("_sd") > 0, F.col("_range") / F.col("_sd"))).withColumn("deviation_ratio", F.when(F.col("_sd") > 0, F.col("deviation_ratio")))
    alerts = sum(F.coalesce(c.cast("int"), F.lit(0)) for c in (F.col("change_p") < 0.05, F.col("deviation_ratio") > 1.5, F.col("mean_range") > 0.5, F.col("acf_range") > 0.25))
    return out.select(*cell, "n", "change", "change_p", "shift_p", "deviation_ratio", "mean_range", "acf_range", alerts.alias("alerts"))
