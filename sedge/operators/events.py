"""Event studies: matched dates, before and after, curves by event time, transitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.calendar import same_date


#: Units or controls of a block, about, and pairs of them that one step of a task meets.
BLOCK, STEP = 4096, 1 << 17


def nearest(units: DataFrame, controls: DataFrame, by: str, key: str, x: Sequence[str], count: int) -> DataFrame:
    """(unit, control, d, place): the `count` controls of the same `by` nearest to each unit in x; distances equal to nine digits go by the control's key, null ones come last.

    units, controls: by, key (long) and x. Blocks of units meet blocks of
    controls and each unit keeps its best of every block, so that a task holds
    two blocks and what is ranked is `count` rows a unit and block.
    """
    blocks = lambda df, name: df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    counts = blocks(units, "_is").join(blocks(controls, "_js"), by)
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    shape = lambda df, i, j, unit: df.join(counts, by).select(F.col(by).alias("_by"), i.alias("_i"), j.alias("_j"), F.lit(unit).alias("_unit"), F.col(key).cast("long").alias("_key"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(x)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_key")  # so that the first of equal ones has the least key
        is_unit, keys = t["_unit"].to_numpy(), t["_key"].to_numpy()
        at = np.column_stack([t[f"_x{k}"].to_numpy() for k in range(len(x))])
        a, b = np.flatnonzero(is_unit), np.flatnonzero(~is_unit)
        found = []
        step = max(1, STEP // max(1, len(b)))
        for lo in range(0, len(a) if len(b) else 0, step):
            part = a[lo : lo + step]
            d = np.sqrt(sum((at[part, None, k] - at[b, k]) ** 2 for k in range(len(x))))
            rank = np.where(np.isnan(d), 1e300, np.floor(d * 1e9 + 0.5))
            for _ in range(min(count, len(b))):
                best = rank.argmin(1)
                rows = np.arange(len(part))
                found.append((keys[part], keys[b[best]], d[rows, best]))
                rank[rows, best] = np.inf
        unit, control, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"unit": unit, "control": control, "d": pa.array(d, mask=np.isnan(d))})

    met = shape(units, own("_is"), every("_js"), True).unionAll(shape(controls, every("_is"), own("_js"), False))
    best = met.groupBy("_by", "_i", "_j").applyInArrow(run, "unit long, control long, d double")
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.col("d").isNull(), F.round("d", 9), "control"))
    return best.withColumn("place", place).where(F.col("place") <= count)


def matched_dates(events: DataFrame, day: str, years: Sequence[int], reach: int) -> DataFrame:
    """Each event with the dates within `reach` days of the same date in the other years.

    Years and reach are fixed by the caller, so an event makes a bounded number
    of rows; they join the series on (cell, day).
    """
    other = F.explode(F.array(*(F.lit(y) for y in years))).alias("_year")
    rows = events.select("*", other).where(F.col("_year") != F.year(day))
    middle = same_date(F.col(day), F.col("_year"))
    return rows.withColumn("control_day", F.explode(F.sequence(F.date_sub(middle, reach), F.date_add(middle, reach)))).drop("_year")


def mid_rank(values: DataFrame, event: Sequence[str], value: Column, control: Column) -> DataFrame:
    """Share of an event's controls below its value, ties half; and the number of controls."""
    known = F.count(control)
    below = F.sum(F.when(control < value, 1.0).when(control == value, 0.5).when(control.isNotNull() & value.isNotNull(), 0.0))
    return values.groupBy(*event).agg(known.alias("controls"), F.avg(control).alias("control_mean"), F.when(known > 0, below / known).alias("percentile"))


def deltas(panel: DataFrame, unit: Sequence[str], k: str, treated: str, control: str, before: int) -> DataFrame:
    """(treated - its mean before) - (control - its mean before) for every k but 0; before is k in [-before, -1]."""
    w = Window.partitionBy(*unit)
    pre = lambda c: F.avg(F.when(F.col(k).between(-before, -1), F.col(c))).over(w)
    return panel.withColumn("delta", (F.col(treated) - pre(treated)) - (F.col(control) - pre(control))).where(F.col(k) != 0)


def against_baseline(panel: DataFrame, unit: Sequence[str], k: str, day: str, x: str, before: int) -> DataFrame:
    """x less its mean before the event, and less the mean before of the same calendar month (null where that has none)."""
    pre = F.when(F.col(k).between(-before, -1), F.col(x))
    return panel.withColumn("change", F.col(x) - F.avg(pre).over(Window.partitionBy(*unit))).withColumn("seasonal_change", F.col(x) - F.avg(pre).over(Window.partitionBy(*unit, F.month(day))))


def memory(panel: DataFrame, unit: Sequence[str], k: str, x: str, first_year: int, last: int, step_years: float) -> DataFrame:
    """Accumulated deficit, net and of the first year, and what remains after it, of curves with 30 % of their steps."""
    v = F.col(x)
    after, first = F.col(k).between(1, last), F.col(k).between(1, first_year)
    late = F.col(k).between(first_year + 1, last)
    rate = lambda rows, n, sign: F.when(F.count(F.when(rows, v)) >= 0.3 * n, sign)
    return panel.groupBy(*unit).agg(
        rate(after, last, F.sum(F.when(after, F.greatest(-v, F.lit(0.0)))) * step_years).alias("deficit"),
        rate(after, last, -F.sum(F.when(after, v)) * step_years).alias("net_deficit"),
        rate(first, first_year, F.sum(F.when(first, F.greatest(-v, F.lit(0.0)))) * step_years).alias("first_deficit"),
        rate(late, last - first_year, F.avg(F.when(late, v))).alias("residual"),
    )


def window_means(panel: DataFrame, unit: Sequence[str], k: str, x: str, windows: Sequence[tuple[str, int, int]], least: float = 0.5) -> DataFrame:
    """Mean of x in named windows of k, null below the share `least` of its steps; fixed: whether the unit has all of them."""
    cols = []
    for name, lo, hi in windows:
        inside = F.when(F.col(k).between(lo, hi), F.col(x))
        cols.append(F.when(F.count(inside) >= least * (hi - lo + 1), F.avg(inside)).alias(name))
    out = panel.groupBy(*unit).agg(*cols)
    whole = F.lit(True)
    for name, _, _ in windows:
        whole &= F.col(name).isNotNull()
    return out.withColumn("fixed", whole)


def transitions(panel: DataFrame, unit: Sequence[str], k: str, x: str) -> DataFrame:
    """Rows with the next state, only where k goes on by one and does not cross the event."""
    w = Window.partitionBy(*unit).orderBy(k)
    rows = panel.withColumn("next_k", F.lead(k).over(w)).withColumn("next_x", F.lead(x).over(w))
    return rows.where((F.col("next_k") == F.col(k) + 1) & (F.signum(k) == F.signum("next_k"))).drop("next_k")


def first_lasting(curve: DataFrame, unit: Sequence[str], k: str, flag: Column, steps: int) -> DataFrame:
    """The first k from which the flag holds for `steps` rows in a row, null if never."""
    w = Window.partitionBy(*unit).orderBy(k).rowsBetween(0, steps - 1)
    held = (F.sum(F.when(flag, 1).otherwise(0)).over(w) == steps) & (F.count(F.lit(1)).over(w) == steps)
    return curve.withColumn("_held", held).groupBy(*unit).agg(F.min(F.when(F.col("_held"), F.col(k))).alias("recovery"))


def lookback_mean(events: DataFrame, series: DataFrame, cell: Sequence[str], at: str, day: str, x: str, days: int, key: Sequence[str]) -> DataFrame:
    """Mean of a series in the `days` days before each event, the day itself not included.

    The range becomes an equality: both sides carry blocks of `days` days, an
    event looks into two of them, and the exact range is checked after that.
    """
    epoch = F.lit("1970-01-01").cast("date")
    left = events.withColumn("_block", F.explode(F.array(*(F.floor(F.datediff(at, epoch) / days) - i for i in (0, 1)))))
    right = series.withColumn("_block", F.floor(F.datediff(day, epoch) / days))
    near = left.join(right, [*cell, "_block"]).where((F.col(day) < F.col(at)) & (F.col(day) >= F.date_sub(at, days)))
    return near.groupBy(*key).agg(F.avg(x).alias("before_mean"), F.count(x).alias("before_n"))
