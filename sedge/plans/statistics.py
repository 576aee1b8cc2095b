"""Spatial statistics and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions.numbers import rounded
from sedge.operators import inference as I
from sedge.operators import spatial as P
from sedge.plans.base import DENSE, dense, r6
from sedge.plans.registry import query
from sedge.sources.tables import read

# Suppliers on a grid of ten columns, a quarter degree apart.
_GRID = "g AS (SELECT s_suppkey AS k, (s_suppkey // 10) * 0.25 AS lat, (s_suppkey % 10) * 0.25 AS lon, s_acctbal AS x FROM supplier)"


def _grid(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("k"), (F.floor(k / 10) * 0.25).alias("lat"), ((k % 10) * 0.25).alias("lon"), F.col("s_acctbal").alias("x"))


@query("grid_keys_and_point_counts", f"""WITH {_GRID} SELECT CAST(floor(lat / 0.5) AS BIGINT) AS i, CAST(floor(lon / 0.5) AS BIGINT) AS j, count(*) AS points, count(*) FILTER (WHERE x > 0) AS positive, printf('CELL_%+07.2f_%+08.2f', floor(lat / 0.5) * 0.5, floor(lon / 0.5) * 0.5) AS id FROM g GROUP BY 1, 2, 5""")
def grid_keys_and_point_counts(spark, sf_dir):
    """Points counted by the cell they fall in."""
    g = _grid(spark, sf_dir).withColumn("i", F.floor(F.col("lat") / 0.5)).withColumn("j", F.floor(F.col("lon") / 0.5))
    return g.groupBy("i", "j").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(F.col("x") > 0, 1)).alias("positive")).withColumn("id", P.cell_id(F.col("i") * 0.5, F.col("j") * 0.5))


@query("clipped_grid", f"""WITH {_GRID}, b AS (SELECT min(lat) - 0.3 AS south, max(lat) + 0.2 AS north, min(lon) - 0.3 AS west, max(lon) + 0.2 AS east FROM g),
    a AS (SELECT *, unnest(generate_series(CAST(ceil(south / 0.25 - 0.5) AS BIGINT), CAST(floor(north / 0.25 + 0.5) AS BIGINT))) * 0.25 AS lat FROM b), o AS (SELECT unnest(generate_series(CAST(ceil(west / 0.25 - 0.5) AS BIGINT), CAST(floor(east / 0.25 + 0.5) AS BIGINT))) * 0.25 AS lon FROM b),
    c AS (SELECT lat, lon, greatest(lat - 0.125, south) AS south, least(lat + 0.125, north) AS north, greatest(lon - 0.125, west) AS west, least(lon + 0.125, east) AS east FROM a CROSS JOIN o) SELECT lat, lon, round((north - south) * (east - west) / 0.0625, 6) + 0.0 AS share FROM c WHERE north > south AND east > west""")  # fmt: skip
def clipped_grid(spark, sf_dir):
    """Cells over the box that the suppliers span, clipped to it."""
    box = _grid(spark, sf_dir).agg((F.min("lat") - 0.3).alias("south"), (F.max("lat") + 0.2).alias("north"), (F.min("lon") - 0.3).alias("west"), (F.max("lon") + 0.2).alias("east"))
    return P.grid(box, 0.25).select("lat", "lon", r6("share", "share"))


_ZONE = "(sin(radians({x})) / (1 - 8.18191908426215e-2 * 8.18191908426215e-2 * sin(radians({x})) * sin(radians({x}))) + ln((1 + 8.18191908426215e-2 * sin(radians({x}))) / (1 - 8.18191908426215e-2 * sin(radians({x})))) / (2 * 8.18191908426215e-2)) * (6.378137e3 * 6.378137e3 * (1 - 8.18191908426215e-2 * 8.18191908426215e-2) / 2) * (pi() / 180)"


@query("ellipsoid_pixel_area", f"WITH {_GRID} SELECT k, round(({_ZONE.format(x='(lat + 0.25)')} - {_ZONE.format(x='lat')}) * 0.25, 5) + 0.0 AS km2 FROM g")
def ellipsoid_pixel_area(spark, sf_dir):
    """Exact areas of latitude bands."""
    area = P.box_area(F.col("lat"), F.col("lat") + 0.25, F.lit(0.25))
    return _grid(spark, sf_dir).select("k", (F.round(area, 5) + F.lit(0.0)).alias("km2"))


@query("overlap_weighted_cell_mean", f"""WITH {_GRID}, e AS (SELECT *, unnest(generate_series(CAST(floor((lat + 1e-9) / 0.6) AS BIGINT), CAST(floor((lat + 0.25 - 1e-9) / 0.6) AS BIGINT))) AS i FROM g),
    c AS (SELECT *, unnest(generate_series(CAST(floor((lon + 1e-9) / 0.6) AS BIGINT), CAST(floor((lon + 0.25 - 1e-9) / 0.6) AS BIGINT))) AS j FROM e),
    w AS (SELECT i, j, x, greatest(least(i * 0.6 + 0.6, lat + 0.25) - greatest(i * 0.6, lat), 0) * greatest(least(j * 0.6 + 0.6, lon + 0.25) - greatest(j * 0.6, lon), 0) * cos(radians(lat)) AS w FROM c)
    SELECT round(i * 0.6, 6) + 0.0 AS south, round(j * 0.6, 6) + 0.0 AS west, round(sum(w * x) / sum(w), 5) + 0.0 AS mean FROM w WHERE w > 1e-12 GROUP BY i, j""")  # fmt: skip
def overlap_weighted_cell_mean(spark, sf_dir):
    """Means of pixels over cells, by the area they share.

    A pixel knows the cells it can meet (its own and the next ones), so pixels
    are exploded by a bounded number and joined on nothing.
    """
    lo = lambda c: F.floor((F.col(c) + 1e-9) / 0.6)
    hi = lambda c: F.floor((F.col(c) + 0.25 - 1e-9) / 0.6)
    p = _grid(spark, sf_dir).withColumn("i", F.explode(F.sequence(lo("lat"), hi("lat")))).withColumn("j", F.explode(F.sequence(lo("lon"), hi("lon"))))
    south, west = F.col("i") * 0.6, F.col("j") * 0.6
    w = P.overlap(south, south + 0.6, F.col("lat"), F.col("lat") + 0.25) * P.overlap(west, west + 0.6, F.col("lon"), F.col("lon") + 0.25) * F.cos(F.radians("lat"))
    return p.withColumn("w", w).where("w > 1e-12").groupBy("i", "j").agg((F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 5) + F.lit(0.0)).alias("mean")).select(r6(F.col("i") * 0.6, "south"), r6(F.col("j") * 0.6, "west"), "mean")


@query("moran_rook", f"WITH {_GRID}, s AS (SELECT avg(x) AS m, count(x) AS n FROM g), q AS (SELECT sum((x - m) * (x - m)) AS sq FROM g, s) SELECT count(*) AS pairs, round(any_value(s.n) / CAST(count(*) AS DOUBLE) * sum((a.x - s.m) * (b.x - s.m)) / any_value(q.sq), 6) + 0.0 AS moran FROM g a JOIN g b ON a.k <> b.k AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 0.26 CROSS JOIN s CROSS JOIN q")
def moran_rook(spark, sf_dir):
    """Moran's I of neighbours within a radius."""
    g = _grid(spark, sf_dir)
    return P.moran(g, P.neighbours(g, "k", "lat", "lon", 0.26), "k", "x").select("pairs", r6("moran", "moran"))


@query("spatial_correlogram", f"""WITH {_GRID}, s AS (SELECT avg(x) AS m, count(x) AS n FROM g), q AS (SELECT sum((x - m) * (x - m)) AS sq FROM g, s),
    p AS (SELECT a.x AS xa, b.x AS xb, CAST(ceil(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) / 0.3) AS BIGINT) AS class FROM g a JOIN g b ON a.k <> b.k AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 1.2)
    SELECT class, count(*) AS pairs, round(any_value(s.n) / CAST(count(*) AS DOUBLE) * sum((xa - s.m) * (xb - s.m)) / any_value(q.sq), 6) + 0.0 AS moran FROM p CROSS JOIN s CROSS JOIN q GROUP BY 1""")
def spatial_correlogram(spark, sf_dir):
    """Moran's I by class of distance."""
    g = _grid(spark, sf_dir)
    pairs = P.neighbours(g, "k", "lat", "lon", 1.2).withColumn("class", F.ceil(F.col("distance") / 0.3))
    return P.moran(g, pairs, "k", "x", "class").select("class", "pairs", r6("moran", "moran"))


@query("effective_n_of_mean", f"""WITH {_GRID}, s AS (SELECT avg(x) AS m, count(x) AS n FROM g), q AS (SELECT sum((x - m) * (x - m)) AS sq FROM g, s),
    p AS (SELECT a.x AS xa, b.x AS xb, CAST(ceil(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) / 0.3) AS BIGINT) AS class FROM g a JOIN g b ON a.k <> b.k AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 1.2),
    c AS (SELECT class, count(*) AS pairs, any_value(s.n) / CAST(count(*) AS DOUBLE) * sum((xa - s.m) * (xb - s.m)) / any_value(q.sq) AS r FROM p CROSS JOIN s CROSS JOIN q GROUP BY 1),
    f AS (SELECT *, min(CASE WHEN r <= 0 THEN class END) OVER () AS stop FROM c) SELECT round((SELECT n FROM s) / (1 + coalesce(sum(pairs * r) FILTER (WHERE class < coalesce(stop, 99)), 0) / (SELECT n FROM s)), 5) + 0.0 AS n_eff FROM f""")
def effective_n_of_mean(spark, sf_dir):
    """How many independent values a mean over correlated cells is worth."""
    g = _grid(spark, sf_dir)
    c = P.moran(g, P.neighbours(g, "k", "lat", "lon", 1.2).withColumn("class", F.ceil(F.col("distance") / 0.3)), "k", "x", "class")
    stop = c.agg(F.coalesce(F.min(F.when(F.col("moran") <= 0, F.col("class"))), F.lit(99)).alias("stop"))
    n = g.agg(F.count("x").alias("n"))
    summed = c.crossJoin(F.broadcast(stop)).agg(F.coalesce(F.sum(F.when(F.col("class") < F.col("stop"), F.col("pairs") * F.col("moran"))), F.lit(0.0)).alias("t"))
    return summed.crossJoin(n).select((F.round(F.col("n") / (1 + F.col("t") / F.col("n")), 5) + F.lit(0.0)).alias("n_eff"))


_SUPP = "s AS (SELECT s_suppkey, s_nationkey % 3 AS grp, s_acctbal AS bal, count(*) AS n, round(avg(l_quantity), 3) AS q, round(avg(l_discount), 4) AS d FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"


def _supp(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity", "l_discount"]).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 3).alias("q"), F.round(F.avg("l_discount"), 4).alias("d"))
    return read(spark, sf_dir, "supplier").join(a, "s_suppkey").select("s_suppkey", (F.col("s_nationkey") % 3).alias("grp"), F.col("s_acctbal").alias("bal"), "n", "q", "d")


_RANK = "rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0"


@query("average_rank_spearman", f"WITH {_SUPP}, r AS (SELECT grp, {_RANK.format(c='n')} AS a, {_RANK.format(c='q')} AS b FROM s) SELECT grp, round(corr(a, b), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY 1")
def average_rank_spearman(spark, sf_dir):
    """Rank correlation with ties at their mean."""
    return I.spearman(_supp(spark, sf_dir), ["grp"], "n", "q").select("grp", r6("rho", "rho"), "n")


@query("partial_spearman_one_control", f"WITH {_SUPP}, r AS (SELECT grp, {_RANK.format(c='n')} AS a, {_RANK.format(c='q')} AS b, {_RANK.format(c='d')} AS c FROM s), k AS (SELECT grp, corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz, count(*) AS n FROM r GROUP BY 1) SELECT grp, round(xy, 6) + 0.0 AS rho, round(CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) + 0.0 AS partial, n FROM k")
def partial_spearman_one_control(spark, sf_dir):
    """Rank correlation given a control."""
    return I.partial_spearman(_supp(spark, sf_dir), ["grp"], "n", "q", "d").select("grp", r6("rho", "rho"), r6("partial", "partial"), "n")


@query("tertiles_and_binned_means", f"""WITH {_SUPP}, b AS (SELECT *, CAST(least(3, floor((row_number() OVER (ORDER BY bal, s_suppkey) - 1) * 3.0 / (count(*) OVER () - 1)) + 1) AS INTEGER) AS tertile, CAST(greatest(1, ceil((row_number() OVER (ORDER BY n, s_suppkey) - 1) * 5.0 / (count(*) OVER () - 1))) AS INTEGER) AS fifth FROM s)
    SELECT tertile, fifth, count(*) AS n, round(avg(q), 6) + 0.0 AS mean, round(stddev_samp(q) / sqrt(count(*)), 6) + 0.0 AS error FROM b GROUP BY 1, 2""")
def tertiles_and_binned_means(spark, sf_dir):
    """Bins of equal counts and their means."""
    s = _supp(spark, sf_dir)
    b = s.withColumn("tertile", I.quantile_bin("bal", 3, tie="s_suppkey")).withColumn("fifth", I.quantile_bin("n", 5, tie="s_suppkey"))
    return b.groupBy("tertile", "fifth").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("q"), "mean"), r6(F.stddev_samp("q") / F.sqrt(F.count(F.lit(1))), "error"))


@query("bh_and_holm_families", f"""WITH {_SUPP}, p AS (SELECT s_suppkey, grp, CASE WHEN s_suppkey % 17 <> 0 THEN round(percent_rank() OVER (PARTITION BY grp ORDER BY q), 2) END AS p FROM s), k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY p) AS r, count(*) OVER (PARTITION BY grp) AS n, rank() OVER (PARTITION BY grp ORDER BY p) + count(*) OVER (PARTITION BY grp, p) - 1 AS l FROM p WHERE p IS NOT NULL)
    SELECT s_suppkey, p, round(least(min(p * n / l) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) + 0.0 AS bh, round(least(max(p * (n - r + 1)) OVER (PARTITION BY grp ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) + 0.0 AS holm FROM k UNION ALL SELECT s_suppkey, p, NULL, NULL FROM p WHERE p IS NULL""")
def bh_and_holm_families(spark, sf_dir):
    """Adjusted p values in families, missing ones passed through."""
    p = F.when(F.col("s_suppkey") % 17 != 0, F.round(F.percent_rank().over(Window.partitionBy("grp").orderBy("q")), 2))
    rows = _supp(spark, sf_dir).select("s_suppkey", "grp", p.alias("p"))
    return I.adjusted(rows, ["grp"], "p").select("s_suppkey", "p", r6("bh", "bh"), r6("holm", "holm"))


@query("monte_carlo_pvalues", """WITH d AS (SELECT o_orderpriority AS test, o_totalprice / 1000 - 150 AS null_, CASE o_orderpriority WHEN '1-URGENT' THEN 90.0 WHEN '2-HIGH' THEN -120.0 ELSE 10.0 END AS obs FROM orders), g AS (SELECT test, count(*) AS n, count(*) FILTER (WHERE null_ >= obs) AS u, count(*) FILTER (WHERE null_ <= obs) AS l, count(*) FILTER (WHERE abs(null_) >= abs(obs)) AS a FROM d GROUP BY 1)
    SELECT test, n, round((1 + u) / (n + 1.0), 6) + 0.0 AS greater, round((1 + l) / (n + 1.0), 6) + 0.0 AS less, round((1 + a) / (n + 1.0), 6) + 0.0 AS absolute, round(least(2 * least((1 + u) / (n + 1.0), (1 + l) / (n + 1.0)), 1), 6) + 0.0 AS two_sided FROM g""")
def monte_carlo_pvalues(spark, sf_dir):
    """Inclusive p values of draws."""
    obs = F.when(F.col("o_orderpriority") == "1-URGENT", 90.0).when(F.col("o_orderpriority") == "2-HIGH", -120.0).otherwise(10.0)
    d = read(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]).select(F.col("o_orderpriority").alias("test"), (F.col("o_totalprice") / 1000 - 150).alias("d"), obs.alias("o"))
    return I.monte_carlo(d, ["test"], "o", "d").select("test", "n", *(r6(c, c) for c in ("greater", "less", "absolute", "two_sided")))


@query("bootstrap_pvalue_and_interval", """SELECT l_returnflag AS test, round(least(2 * (least(count(*) FILTER (WHERE l_quantity - 20 <= 0), count(*) FILTER (WHERE l_quantity - 20 >= 0)) + 1) / (count(*) + 1.0), 1), 6) + 0.0 AS p, round(quantile_cont(l_quantity - 20, 0.025), 6) + 0.0 AS lo, round(quantile_cont(l_quantity - 20, 0.975), 6) + 0.0 AS hi FROM lineitem GROUP BY 1""")
def bootstrap_pvalue_and_interval(spark, sf_dir):
    """P and percentile interval of bootstrap draws."""
    v = F.col("l_quantity") - 20
    g = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity"]).groupBy(F.col("l_returnflag").alias("test")).agg(I.bootstrap_p(v).alias("p"), F.percentile(v, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select("test", r6("p", "p"), r6(F.col("q")[0], "lo"), r6(F.col("q")[1], "hi"))


@query("theil_sen_mann_kendall", """WITH y AS (SELECT l_suppkey AS unit, year(l_shipdate) AS t, round(avg(l_quantity), 1) AS x FROM lineitem GROUP BY 1, 2),
    p AS (SELECT a.unit, (b.x - a.x) / (b.t - a.t) AS s, sign(b.x - a.x) AS g FROM y a JOIN y b ON b.unit = a.unit AND b.t > a.t), k AS (SELECT unit, median(s) AS slope, sum(g) AS s FROM p GROUP BY 1), t AS (SELECT unit, sum(c * (c - 1) * (2 * c + 5)) AS ties, sum(c) AS n FROM (SELECT unit, x, count(*) AS c FROM y GROUP BY 1, 2) GROUP BY 1)
    SELECT k.unit, CAST(n AS INTEGER) AS n, round(slope, 6) + 0.0 AS slope, CAST(s AS DOUBLE) AS s, round((n * (n - 1) * (2 * n + 5) - ties) / 18.0, 6) + 0.0 AS variance FROM k JOIN t ON t.unit = k.unit""")
def theil_sen_mann_kendall(spark, sf_dir):
    """Median pairwise slope, Mann-Kendall's S and its variance."""
    y = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("t")).agg(F.round(F.avg("l_quantity"), 1).alias("x"))
    return I.pair_slopes(y, ["unit"], "t", "x").select("unit", "n", r6("slope", "slope"), "s", r6("variance", "variance"))


@query("within_demean", "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 9) + 0.0 AS x, round(l_discount - avg(l_discount) OVER (PARTITION BY l_suppkey), 9) + 0.0 AS d FROM lineitem")
def within_demean(spark, sf_dir):
    """Deviations from the unit's own mean, from a small joined table of means so that hot units stay spread."""
    rows = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount"])
    m = rows.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mq"), F.avg("l_discount").alias("md"))
    return rows.join(m, "l_suppkey").select("l_orderkey", "l_linenumber", rounded(F.col("l_quantity") - F.col("mq"), 9).alias("x"), rounded(F.col("l_discount") - F.col("md"), 9).alias("d"))


@query("fixed_effects_slope", """WITH w AS (SELECT l_suppkey AS u, l_extendedprice / 1000 - avg(l_extendedprice / 1000) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM w), c AS (SELECT u, sum(x * (y - b.b * x)) AS s FROM w CROSS JOIN b GROUP BY 1)
    SELECT round((SELECT b FROM b), 6) + 0.0 AS slope, round(sqrt(sum(s * s) * count(*) / (count(*) - 1.0)) / (SELECT xx FROM b), 6) + 0.0 AS error, count(*) AS units FROM c""")
def fixed_effects_slope(spark, sf_dir):
    """Slope within units and its cluster-robust error, from sums alone."""
    rows = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_extendedprice", "l_quantity"]).select(F.col("l_suppkey").alias("u"), (F.col("l_extendedprice") / 1000).alias("y0"), F.col("l_quantity").alias("x0"))
    m = rows.groupBy("u").agg(F.avg("y0").alias("my"), F.avg("x0").alias("mx"))
    w = rows.join(m, "u").select("u", (F.col("y0") - F.col("my")).alias("y"), (F.col("x0") - F.col("mx")).alias("x"))
    per = w.groupBy("u").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    b = per.agg((F.sum("xy") / F.sum("xx")).alias("b"), F.sum("xx").alias("sxx"))
    s = per.crossJoin(F.broadcast(b)).withColumn("s", F.col("xy") - F.col("b") * F.col("xx"))
    g = s.agg(F.max("b").alias("b"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.count(F.lit(1)).alias("units"), F.max("sxx").alias("sxx"))
    return g.select(r6("b", "slope"), r6(F.sqrt(F.col("ss") * F.col("units") / (F.col("units") - 1)) / F.col("sxx"), "error"), "units")


@query("diebold_mariano", f"""WITH {DENSE}, f AS (SELECT cell, day, pow(x - lag(x) OVER w, 2) - pow(x - lag(x, 7) OVER w, 2) AS d FROM dense WINDOW w AS (PARTITION BY cell ORDER BY day)), m AS (SELECT cell, avg(d) AS m, count(d) AS n FROM f WHERE d IS NOT NULL GROUP BY 1),
    l AS (SELECT f.cell, f.d - m.m AS e, lag(f.d - m.m) OVER (PARTITION BY f.cell ORDER BY day) AS e1, m.m, m.n FROM f JOIN m ON m.cell = f.cell WHERE f.d IS NOT NULL) SELECT cell, any_value(n) AS n, round(any_value(m) / sqrt((sum(e * e) / any_value(n) + 2 * 0.5 * sum(e * e1) / any_value(n)) / any_value(n)), 5) + 0.0 AS dm FROM l GROUP BY 1""")
def diebold_mariano(spark, sf_dir):
    """Test statistic of two forecasts' squared errors, with one autocovariance."""
    w = Window.partitionBy("cell").orderBy("day")
    f = dense(spark, sf_dir).withColumn("d", F.pow(F.col("x") - F.lag("x").over(w), 2) - F.pow(F.col("x") - F.lag("x", 7).over(w), 2)).where("d is not null")
    m = f.groupBy("cell").agg(F.avg("d").alias("m"), F.count("d").alias("n"))
    e = f.join(F.broadcast(m), "cell").withColumn("e", F.col("d") - F.col("m")).withColumn("e1", F.lag("e").over(w))
    n = F.max("n")
    return e.groupBy("cell").agg(n.alias("n"), (F.round(F.max("m") / F.sqrt((F.sum(F.col("e") * F.col("e")) / n + F.sum(F.col("e") * F.col("e1")) / n) / n), 5) + F.lit(0.0)).alias("dm"))
