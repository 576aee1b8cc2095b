"""Descriptors of series as expressions: ordinal patterns, words, information, asymmetry, correlation sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinal_patterns(series: DataFrame, cell: Sequence[str], order: str, x: str, dims: int, delay: int = 1) -> DataFrame:
    """Counts of ordinal patterns: which place of a delay vector is least, next, ...; ties in order of time."""
    w = Window.partitionBy(*cell).orderBy(order)
    lags = [F.struct(F.lead(x, i * delay).over(w).alias("v"), F.lit(i).alias("i")) for i in range(dims)]
    rows = series.withColumn("_e", F.array(*lags)).where(F.forall("_e", lambda s: s["v"].isNotNull()))
    pattern = F.array_join(F.transform(F.array_sort("_e"), lambda s: s["i"].cast("string")), "")
    return rows.groupBy(*cell, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def entropy_complexity(patterns: DataFrame, cell: Sequence[str], dims: int) -> DataFrame:
    """Normalised permutation entropy and Jensen-Shannon complexity; patterns that never occur count too."""
    states = math.factorial(dims)
    w = Window.partitionBy(*cell)
    p = patterns.withColumn("p", F.col("n") / F.sum("n").over(w))
    half = 0.5 / states
    # the mixture with the uniform distribution, of the states that occur and those that don't
    q = F.col("p") / 2 + half
    g = p.groupBy(*cell).agg((-F.sum(F.col("p") * F.log("p"))).alias("s"), (-F.sum(q * F.log(q))).alias("m"), F.count(F.lit(1)).alias("seen"), F.sum("n").alias("n"))
    mixed = F.col("m") - (states - F.col("seen")) * (half * math.log(half))
    top = -0.5 * ((states + 1) / states * math.log(states + 1) - 2 * math.log(2 * states) + math.log(states))
    h = F.col("s") / math.log(states)
    return g.select(*cell, "n", h.alias("entropy"), ((mixed - F.col("s") / 2 - math.log(states) / 2) / top * h).alias("complexity"))


def word_entropy(series: DataFrame, cell: Sequence[str], order: str, flag: str, length: int) -> DataFrame:
    """Bits a letter of words of a binary series."""
    w = Window.partitionBy(*cell).orderBy(order)
    letters = [F.lead(F.col(flag).cast("int"), i).over(w) for i in range(length)]
    rows = series.withColumn("_w", F.concat(*(c.cast("string") for c in letters))).where("_w is not null")
    counts = rows.groupBy(*cell, "_w").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*cell))
    return counts.withColumn("p", p).groupBy(*cell).agg((-F.sum(F.col("p") * F.log2("p")) / length).alias("bits"))


def reversal_asymmetry(series: DataFrame, cell: Sequence[str], order: str, x: str, lag: int) -> DataFrame:
    """Mean cube of lagged differences of the series in population standard deviations."""
    d = F.lead(x, lag).over(Window.partitionBy(*cell).orderBy(order)) - F.col(x)
    sd = series.groupBy(*cell).agg(F.stddev_pop(x).alias("_sd"))
    return series.withColumn("_d", d).join(F.broadcast(sd), list(cell)).groupBy(*cell).agg(F.avg(F.pow(F.col("_d") / F.col("_sd"), 3)).alias("asymmetry"))


def mutual_information(series: DataFrame, cell: Sequence[str], order: str, x: str, bins: int, lags: Sequence[int]) -> DataFrame:
    """Average mutual information in nats of equally filled bins of the series and of itself some lags later."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy(*cell)), F.row_number().over(Window.partitionBy(*cell).orderBy(x, order))
    b = series.withColumn("_b", F.floor((r - 1) * bins / n))
    w = Window.partitionBy(*cell).orderBy(order)
    ahead = b.select(*cell, F.col("_b").alias("i"), *(F.lead("_b", k).over(w).alias(f"_l{k}") for k in lags))
    pairs = ahead.select(*cell, "i", F.posexplode(F.array(*(F.col(f"_l{k}") for k in lags))).alias("_k", "j")).where("j is not null")
    joint = pairs.groupBy(*cell, "_k", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    per = lambda *c: F.sum("n").over(Window.partitionBy(*cell, "_k", *c))
    m = joint.withColumn("_m", F.col("n") / per() * F.log(F.col("n") * per() / (per("i") * per("j"))))
    lag = F.element_at(F.array(*(F.lit(k) for k in lags)), (F.col("_k") + 1).cast("int"))
    return m.groupBy(*cell, lag.alias("lag")).agg(F.sum("_m").alias("ami"))


def run_entropy(runs: DataFrame, cell: Sequence[str], length: str) -> DataFrame:
    """Entropy in nats of how long runs are, and their mean length."""
    c = runs.groupBy(*cell, length).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*cell))
    return c.withColumn("p", p).groupBy(*cell).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), (F.sum(F.col(length) * F.col("n")) / F.sum("n")).alias("mean_length"), F.sum("n").alias("runs"))
