"""Ranks, correlations, families of tests, resampling p values, trends; as windows and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(x: Column | str, *by: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation in groups, over rows where both are known."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("_rx", average_rank(x, *by)).withColumn("_ry", average_rank(y, *by))
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Rank correlation of x and y given the rank of z: the closed form of one control."""
    r = rows.where(" and ".join(f"{c} is not null" for c in (x, y, z)))
    for c in (x, y, z):
        r = r.withColumn(f"_r_{c}", average_rank(c, *by))
    g = r.groupBy(*by).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("xy"), F.corr(f"_r_{x}", f"_r_{z}").alias("xz"), F.corr(f"_r_{y}", f"_r_{z}").alias("yz"), F.count(F.lit(1)).alias("n"))
    left = (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)  # nothing is left where the control explains all
    return g.select(*by, F.col("xy").alias("rho"), F.when(left > 1e-12, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left)).alias("partial"), "n")


def adjusted(rows: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """Columns bh and holm of the p values of each family; a null p stays null and counts for nothing."""
    known = rows.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    up = w.orderBy(p)
    # ties share a value whatever their order: the last rank of a tie for bh, the first for holm
    rank, n = F.rank().over(up), F.count(F.lit(1)).over(w)
    last = rank + F.count(F.lit(1)).over(Window.partitionBy(*family, p)) - 1
    bh = F.least(F.min(F.col(p) * F.col("_n") / F.col("_last")).over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    holm = F.least(F.max(F.col(p) * (F.col("_n") - F.col("_rank") + 1)).over(up.rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    out = known.withColumn("_rank", rank).withColumn("_n", n).withColumn("_last", last).withColumn("bh", bh).withColumn("holm", holm).drop("_rank", "_n", "_last")
    return out.unionByName(rows.where(F.col(p).isNull()).withColumn("bh", F.lit(None).cast("double")).withColumn("holm", F.lit(None).cast("double")))


def monte_carlo(draws: DataFrame, by: Sequence[str], observed: str, null: str) -> DataFrame:
    """Inclusive resampling p values: greater, less, absolute, and two sided."""
    o, d, n = F.col(observed), F.col(null), F.count(null)
    up, down = (1 + F.count(F.when(d >= o, 1))) / (n + 1), (1 + F.count(F.when(d <= o, 1))) / (n + 1)
    return draws.groupBy(*by).agg(up.alias("greater"), down.alias("less"), ((1 + F.count(F.when(F.abs(d) >= F.abs(o), 1))) / (n + 1)).alias("absolute"), F.least(2 * F.least(up, down), F.lit(1.0)).alias("two_sided"), n.alias("n"))


def bootstrap_p(v: Column) -> Column:
    """Two-sided p of bootstrap draws around 0."""
    n = F.count(v)
    return F.least(2 * (F.least(F.count(F.when(v <= 0, 1)), F.count(F.when(v >= 0, 1))) + 1) / (n + 1), F.lit(1.0))


def quantile_bin(x: Column | str, q: int, *by: str, tie: str) -> Column:
    """Bins of equal counts by first rank, as quantile edges of the ranks cut them: 1 to q."""
    r, n = F.row_number().over(Window.partitionBy(*by).orderBy(x, tie)), F.count(F.lit(1)).over(Window.partitionBy(*by))
    if q == 3:
        return F.least(F.lit(3), F.floor((r - 1) * 3 / F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    return F.greatest(F.lit(1), F.ceil((r - 1) * q / F.greatest(n - 1, F.lit(1)))).cast("int")


def pair_slopes(rows: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    """Median of the slopes of all pairs of points, and Mann-Kendall's S with its tie-corrected variance.

    Series are short (years, months), so a series' points are one bounded array
    and its pairs an expression on it.
    """
    pts = rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x")))).alias("p"))
    pairs = F.expr("flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> named_struct('s', (b.x - a.x) / (b.t - a.t), 'g', signum(b.x - a.x)))))")
    g = pts.withColumn("_pairs", pairs).withColumn("_s", F.expr("aggregate(_pairs, 0D, (a, q) -> a + q.g)")).withColumn("n", F.size("p"))
    g = g.withColumn("_sl", F.expr("array_sort(transform(_pairs, q -> q.s))"))
    mid = F.expr("case when size(_sl) = 0 then null when size(_sl) % 2 = 1 then _sl[int(size(_sl) / 2)] else (_sl[int(size(_sl) / 2) - 1] + _sl[int(size(_sl) / 2)]) / 2 end")
    ties = F.expr("aggregate(array_distinct(transform(p, a -> a.x)), 0D, (s, v) -> s + size(filter(p, a -> a.x = v)) * (size(filter(p, a -> a.x = v)) - 1) * (2 * size(filter(p, a -> a.x = v)) + 5))")
    n = F.col("n")
    return g.select(*by, "n", mid.alias("slope"), F.col("_s").alias("s"), ((n * (n - 1) * (2 * n + 5) - ties) / 18).alias("variance"))


#: A standard normal value is farther from 0 with a chance of 5 %.
Z95 = 1.959963984540054


def autocorrelated_trend(rows: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    """pair_slopes() and the factor by which autocorrelation widens the variance of S, after Hamed and Rao (1998).

    The ranks of what the median slope leaves are correlated with themselves
    at lags of 1 to n - 3; only lags beyond 1.96 / sqrt(n) count. Series are
    short, as there, so the lags are an expression on one bounded array.
    """
    slopes = pair_slopes(rows, by, t, x)
    left = rows.where(F.col(x).isNotNull()).join(slopes.select(*by, "slope"), list(by)).withColumn("_r", F.round(F.col(x) - F.coalesce("slope", F.lit(0.0)) * F.col(t), 9))
    ranked = left.withColumn("_c", average_rank("_r", *by)).groupBy(*by).agg(F.expr(f"transform(sort_array(collect_list(struct({t}, _c))), v -> v._c - (count(1) + 1) / 2D)").alias("_c"))
    n = F.expr("size(_c)")
    product = "aggregate(sequence(0, size(_c) - 1 - k), 0D, (a, i) -> a + _c[i] * _c[i + k]) / _square"
    counts = f"aggregate(sequence(1, size(_c) - 3), 0D, (s, k) -> s + case when abs({product}) > {Z95} / sqrt(size(_c)) then (size(_c) - k) * (size(_c) - k - 1) * (size(_c) - k - 2) * {product} else 0D end)"
    squared = ranked.withColumn("_square", F.expr("aggregate(_c, 0D, (a, v) -> a + v * v)"))
    total = F.when((n >= 4) & (F.col("_square") > 0), F.expr(counts)).otherwise(0.0)
    ratio = F.when(n >= 3, F.greatest(1 + 2 * total / (n * (n - 1) * (n - 2)), F.lit(1e-6))).otherwise(1.0)
    return slopes.join(squared.select(*by, ratio.alias("ratio")), list(by))
