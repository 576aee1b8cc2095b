"""Operators on daily series per cell: totals, spines, windows, runs, gaps, anomalies.

Every window is partitioned by the cell columns, so a series is the unit that
one task orders; cells spread over the cluster. A window of n rows with a
missing one is null, as far as not said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_totals(rows: DataFrame, cell: Sequence[str], day: Column, x: str, per_day: int) -> DataFrame:
    """Daily mean, least, greatest and sum of x, null where fewer than per_day samples are there; n counts them."""
    g = rows.groupBy(*cell, day.alias("day")).agg(F.count(x).alias("n"), F.avg(x).alias("x_mean"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.sum(x).alias("x_sum"))
    return g.select(*cell, "day", "n", *(F.when(F.col("n") >= per_day, F.col(c)).alias(c) for c in ("x_mean", "x_min", "x_max", "x_sum")))


def spine(series: DataFrame, cell: Sequence[str], day: str = "day") -> DataFrame:
    """All cells on all days between the first and the last day of all; values are null where there was no row.

    The days are one bounded sequence and the cells a distinct list, so the
    product is as large as the dense result and nothing else.
    """
    days = series.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(day))
    return series.select(*cell).distinct().crossJoin(F.broadcast(days)).join(series, [*cell, day], "left")


def _over(cell: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*cell).orderBy(order)


def rolling(x: Column, cell: Sequence[str], order: str, first: int, last: int, how: str = "avg", least: int | None = None) -> Column:
    """avg, sum, var_samp... of rows first..last around the row, null if fewer than `least` (all, if not given) are there."""
    w = _over(cell, order).rowsBetween(first, last)
    return F.when(F.count(x).over(w) >= F.lit(least if least is not None else last - first + 1), getattr(F, how)(x).over(w))


def run_length(flag: Column, cell: Sequence[str], order: str) -> Column:
    """How many rows in a row, up to this one, have the flag; null breaks a run."""
    on = F.coalesce(flag, F.lit(False))
    w = _over(cell, order)
    last_off = F.max(F.when(~on, F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(on, F.col("_row") - F.coalesce(last_off, F.lit(0))).otherwise(F.lit(0)).cast("long")


def with_run_length(series: DataFrame, flag: Column, cell: Sequence[str], order: str, name: str) -> DataFrame:
    return series.withColumn("_row", F.row_number().over(_over(cell, order))).withColumn(name, run_length(flag, cell, order)).drop("_row")


def episode_starts(event: Column, cell: Sequence[str], order: str, quiet: int) -> Column:
    """An event with none in the `quiet` rows before, all of which must be there."""
    before = rolling(F.when(event, 1).otherwise(0), cell, order, -quiet, -1, "sum")
    return F.coalesce(event & (before == 0), F.lit(False))


def mean_square_anomaly(series: DataFrame, cell: Sequence[str], base: Column, x: str, half: int) -> DataFrame:
    """Anomaly and standardised anomaly of x against a day-of-year climatology of the base period.

    Means by day of year on a spine of 366 days, gaps filled between
    neighbours (around New Year too), smoothed over 2 * half + 1 days around
    the circle, subtracted; then divided by the root of the equally smoothed
    mean square of what is left in the base period.
    """
    clim = smooth_year(series.where(base).groupBy(*cell, F.dayofyear("day").alias("doy")).agg(F.avg(x).alias("v")), cell, half).withColumnRenamed("v", "normal")
    rows = series.withColumn("doy", F.dayofyear("day")).join(clim, [*cell, "doy"], "left").withColumn("anomaly", F.col(x) - F.col("normal"))
    square = smooth_year(rows.where(base).groupBy(*cell, "doy").agg(F.avg(F.col("anomaly") * F.col("anomaly")).alias("v")), cell, half).withColumnRenamed("v", "square")
    return rows.join(square, [*cell, "doy"], "left").withColumn("z", F.when(F.col("square") > 0, F.col("anomaly") / F.sqrt("square")))


def smooth_year(by_doy: DataFrame, cell: Sequence[str], half: int) -> DataFrame:
    """by_doy (cell, doy, v) on 366 days, gaps interpolated around the circle, smoothed by a centred circular mean."""
    days = by_doy.select(*cell).distinct().withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    dense = days.join(by_doy, [*cell, "doy"], "left")
    # three turns, so that windows see across New Year
    turns = dense.withColumn("turn", F.explode(F.array(F.lit(-366), F.lit(0), F.lit(366)))).withColumn("at", F.col("doy") + F.col("turn"))
    w = Window.partitionBy(*cell).orderBy("at")
    known = F.when(F.col("v").isNotNull(), F.struct("at", "v"))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, True).over(Window.partitionBy(*cell).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))  # runs on from the end, where a frame to the end would start anew at each row
    share = (F.col("at") - F.col("_b.at")) / (F.col("_a.at") - F.col("_b.at"))
    filled = turns.withColumn("_b", before).withColumn("_a", after).withColumn("v", F.coalesce("v", F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share, "_b.v", "_a.v"))
    smooth = filled.withColumn("v", F.avg("v").over(w.rowsBetween(-half, half)))
    return smooth.where("turn = 0").select(*cell, "doy", "v")


def slot_scores(series: DataFrame, cell: Sequence[str], slot: str, x: str, name: str, fit: Column | None = None) -> DataFrame:
    """x against the mean and sample deviation of its cell and slot (of the rows of fit); null where that deviation is 0 or unknown."""
    w = Window.partitionBy(*cell, slot)
    v = F.col(x) if fit is None else F.when(fit, F.col(x))
    sd = F.stddev_samp(v).over(w)
    return series.withColumn(name, F.when(sd > 0, (F.col(x) - F.avg(v).over(w)) / sd))


def fill_forward(x: Column, cell: Sequence[str], order: str, limit: int, otherwise: float) -> Column:
    """The last value of at most `limit` rows before, else a constant: what is known at the time."""
    held = F.last(x, True).over(_over(cell, order).rowsBetween(-limit, 0))
    return F.coalesce(held, F.lit(otherwise))


def fill_short_gaps(series: DataFrame, cell: Sequence[str], order: str, x: str, longest: int, otherwise: float, name: str) -> DataFrame:
    """Interior gaps of at most `longest` rows between their neighbours in a line, all other missing values a constant."""
    w = Window.partitionBy(*cell).orderBy(order)
    rows = series.withColumn("_row", F.row_number().over(w))
    known = F.when(F.col(x).isNotNull(), F.struct(F.col("_row").alias("r"), F.col(x).alias("v")))
    rows = rows.withColumn("_b", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.last(known, True).over(Window.partitionBy(*cell).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_row") - F.col("_b.r")) / (F.col("_a.r") - F.col("_b.r"))
    short = F.col("_a.r") - F.col("_b.r") - 1 <= longest
    return rows.withColumn(name, F.coalesce(F.col(x), F.when(short, line), F.lit(otherwise))).drop("_row", "_a", "_b")


def lag_embedding(series: DataFrame, cell: Sequence[str], order: str, x: str, dims: int, delay: int) -> DataFrame:
    """Columns e0.. of x and its values 1..dims-1 delays later; only whole vectors."""
    w = _over(cell, order)
    out = series.select("*", *(F.lead(x, i * delay).over(w).alias(f"e{i}") for i in range(dims)))
    return out.where(" and ".join(f"e{i} is not null" for i in range(dims)))


def mean_of_next(x: Column, cell: Sequence[str], order: str, h: int) -> Column:
    """Mean of the next h rows if at least half of them, rounded up, are there."""
    return rolling(x, cell, order, 1, h, "avg", (h + 1) // 2)


def percent_rank_average(x: Column, *by: Column | str) -> Column:
    """Average rank as a share of the group's values."""
    w = Window.partitionBy(*by)
    same = Window.partitionBy(*by, x)
    return (F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(same) - 1) / 2) / F.count(x).over(w)


def decayed_maximum(series: DataFrame, cell: Sequence[str], order: str, x: str, decay: float, name: str) -> DataFrame:
    """b_k = max(x_k, decay * b_{k-1}): the greatest of what is left of all values before.

    In logarithms it is a running maximum of ln x_i - i ln decay, so one window does it.
    """
    w = _over(cell, order)
    rows = series.withColumn("_row", F.row_number().over(w))
    lifted = F.max(F.when(F.col(x) > 0, F.log(x) - F.col("_row") * F.log(F.lit(decay)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(F.exp(lifted + F.col("_row") * F.log(F.lit(decay))), F.lit(0.0))).drop("_row")


def latest(rows: DataFrame, series: DataFrame, cell: Sequence[str], at: str, x: str) -> DataFrame:
    """rows with x of the series at their time or the last before it, null if there is none. series: cell, at and x, one row each.

    Both are one table in order of time within buckets of a cell and a month; a
    bucket's first rows take the last value of the cell's buckets before.
    """
    bucket = F.trunc(at, "MM").alias("_bucket")
    points = series.where(F.col(x).isNotNull()).select(*cell, at, F.struct(F.col(x).alias("v")).alias("_p"), F.lit(0).alias("_kind"))
    asked = rows.select(*cell, at, F.struct(*rows.columns).alias("_row"), F.lit(1).alias("_kind"))
    both = points.unionByName(asked, allowMissingColumns=True).select("*", bucket)
    ends = both.groupBy(*cell, "_bucket").agg(F.max_by(F.col("_p.v"), F.when(F.col("_kind") == 0, F.col(at))).alias("_last"))
    before = Window.partitionBy(*cell).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*cell, "_bucket", F.last("_last", True).over(before).alias("_carried"))
    w = Window.partitionBy(*cell, "_bucket").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_v", F.last("_p.v", True).over(w)).where("_kind = 1").join(carried, [*cell, "_bucket"])
    return got.select("_row.*", F.coalesce("_v", "_carried").alias(x))
