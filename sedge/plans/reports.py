"""Named result tables: bundles, matrices, shares, contrasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.operators import inference as I
from sedge.plans.base import DENSE, dense, r6
from sedge.plans.registry import query
from sedge.sources.tables import read


@query("monthly_bundle_mixed", f"WITH {DENSE} SELECT cell, CAST(date_trunc('month', day) AS DATE) AS month, CASE WHEN count(x) >= 1 THEN round(sum(x), 6) + 0.0 END AS total, round(avg(x), 6) + 0.0 AS mean, count(*) FILTER (WHERE coalesce(x, 0) < 80) AS dry FROM dense GROUP BY 1, 2")
def monthly_bundle_mixed(spark, sf_dir):
    """Monthly table, sums for totals (null without a value) and means for the rest."""
    g = dense(spark, sf_dir).groupBy("cell", F.trunc("day", "MM").cast("date").alias("month"))
    return g.agg(F.when(F.count("x") >= 1, r6(F.sum("x"), "t")).alias("total"), r6(F.avg("x"), "mean"), F.count(F.when(F.coalesce("x", F.lit(0.0)) < 80, 1)).alias("dry"))


_MONTH = f"WITH {DENSE}, m AS (SELECT cell, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, avg(x) AS v FROM dense GROUP BY 1, 2, 3), b AS (SELECT cell, month, avg(v) AS normal FROM m WHERE year <= 1998 GROUP BY 1, 2)"


@query("monthly_anomaly_matrix", _MONTH + " SELECT m.cell, m.year, m.month, round(v - normal, 6) + 0.0 AS anomaly, round(100 * (v / normal - 1), 6) + 0.0 AS percent FROM m JOIN b ON b.cell = m.cell AND b.month = m.month")
def monthly_anomaly_matrix(spark, sf_dir):
    """Months against their normal, absolute and in percent."""
    m = dense(spark, sf_dir).groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("x").alias("v"))
    b = m.where("year <= 1998").groupBy("cell", "month").agg(F.avg("v").alias("normal"))
    return m.join(F.broadcast(b), ["cell", "month"]).select("cell", "year", "month", r6(F.col("v") - F.col("normal"), "anomaly"), r6(100 * (F.col("v") / F.col("normal") - 1), "percent"))


@query("monthly_normals_by_cell", _MONTH + " SELECT cell, round(sum(normal), 6) + 0.0 AS annual, count(*) FILTER (WHERE normal < 105) AS low_months, round(max(normal), 6) + 0.0 AS highest, CAST(arg_max(month, normal) AS INTEGER) AS peak FROM b GROUP BY 1")
def monthly_normals_by_cell(spark, sf_dir):
    """Normals reduced over the months: sum, months below a level, the peak month."""
    m = dense(spark, sf_dir).groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("x").alias("v"))
    b = m.where("year <= 1998").groupBy("cell", "month").agg(F.avg("v").alias("normal"))
    return b.groupBy("cell").agg(r6(F.sum("normal"), "annual"), F.count(F.when(F.col("normal") < 105, 1)).alias("low_months"), r6(F.max("normal"), "highest"), F.max_by("month", "normal").alias("peak"))


@query("lagged_rank_groups", f"""WITH {DENSE}, m AS (SELECT cell, CAST(date_trunc('month', day) AS DATE) AS month, count(x) AS n, sum(x) AS v, count(*) AS days FROM dense GROUP BY 1, 2), c AS (SELECT * FROM m WHERE n = days),
    r AS (SELECT cell, month, v, (rank() OVER (PARTITION BY cell, month(month) ORDER BY v) + (count(*) OVER (PARTITION BY cell, month(month), v) - 1) / 2.0) / count(*) OVER (PARTITION BY cell, month(month)) AS rank FROM c),
    l AS (SELECT a.cell, a.month, b.rank FROM r a JOIN r b ON b.cell = a.cell AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)), f AS (SELECT CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_returnflag END AS cell, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) FILTER (WHERE l_quantity >= 50) AS fires FROM lineitem GROUP BY 1, 2)
    SELECT CASE WHEN rank <= 1.0 / 3 THEN 'dry' WHEN rank <= 2.0 / 3 THEN 'middle' ELSE 'wet' END AS grp, count(*) AS months, count(*) FILTER (WHERE fires > 10) AS with_fire, round(avg(fires), 6) + 0.0 AS mean FROM l JOIN f ON f.cell = l.cell AND f.month = l.month GROUP BY 1""")
def lagged_rank_groups(spark, sf_dir):
    """Complete months ranked within their calendar month, the rank a month before cut in three, against counts."""
    d = dense(spark, sf_dir)
    month = F.trunc("day", "MM").cast("date")
    c = d.groupBy("cell", month.alias("month")).agg(F.count("x").alias("n"), F.sum("x").alias("v"), F.count(F.lit(1)).alias("days")).where("n = days").withColumn("m", F.month("month"))
    rank = (F.rank().over(Window.partitionBy("cell", "m").orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("cell", "m", "v")) - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy("cell", "m"))
    r = c.withColumn("rank", rank)
    before = r.select("cell", F.add_months("month", 1).alias("month"), "rank")
    fires = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_shipdate", "l_quantity"]).groupBy(F.col("l_returnflag").alias("cell"), F.trunc("l_shipdate", "MM").cast("date").alias("month")).agg(F.count(F.when(F.col("l_quantity") >= 50, 1)).alias("fires"))
    grp = F.when(F.col("rank") <= 1 / 3, "dry").when(F.col("rank") <= 2 / 3, "middle").otherwise("wet")
    return r.select("cell", "month").join(before, ["cell", "month"]).join(fires, ["cell", "month"]).groupBy(grp.alias("grp")).agg(F.count(F.lit(1)).alias("months"), F.count(F.when(F.col("fires") > 10, 1)).alias("with_fire"), r6(F.avg("fires"), "mean"))


@query("window_comparison_share", """WITH s AS (SELECT l_suppkey AS unit, l_returnflag AS variable, avg(l_quantity) FILTER (WHERE year(l_shipdate) <= 1997) AS one, avg(l_quantity) FILTER (WHERE year(l_shipdate) > 1997) AS two FROM lineitem GROUP BY 1, 2)
    SELECT variable, count(*) AS n, round(avg(CASE WHEN two > one THEN 1.0 ELSE 0 END), 6) + 0.0 AS higher, round(quantile_cont(two - one, 0.01), 6) + 0.0 AS p01, round(quantile_cont(two - one, 0.99), 6) + 0.0 AS p99 FROM s WHERE one IS NOT NULL AND two IS NOT NULL GROUP BY 1""")
def window_comparison_share(spark, sf_dir):
    """Share of units that grew between two windows, and the tails of the change."""
    early = F.year("l_shipdate") <= 1997
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.col("l_returnflag").alias("variable")).agg(F.avg(F.when(early, F.col("l_quantity"))).alias("one"), F.avg(F.when(~early, F.col("l_quantity"))).alias("two")).where("one is not null and two is not null")
    d = F.col("two") - F.col("one")
    g = s.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(d > 0, 1.0).otherwise(0.0)).alias("h"), F.percentile(d, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return g.select("variable", "n", r6("h", "higher"), r6(F.col("q")[0], "p01"), r6(F.col("q")[1], "p99"))


@query("top_minus_bottom", """WITH s AS (SELECT s_suppkey, s_acctbal, avg(l_quantity) AS q FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2), b AS (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) * 5.0 / (count(*) OVER () - 1))) AS bin FROM s)
    SELECT round(avg(q) FILTER (WHERE bin = 5) - avg(q) FILTER (WHERE bin = 1), 6) + 0.0 AS contrast, count(*) FILTER (WHERE bin = 5) AS n_top FROM b""")
def top_minus_bottom(spark, sf_dir):
    """Contrast of the outer bins."""
    q = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity"]).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q"))
    b = read(spark, sf_dir, "supplier").join(q, "s_suppkey").withColumn("bin", I.quantile_bin("s_acctbal", 5, tie="s_suppkey"))
    return b.agg(r6(F.avg(F.when(F.col("bin") == 5, F.col("q"))) - F.avg(F.when(F.col("bin") == 1, F.col("q"))), "contrast"), F.count(F.when(F.col("bin") == 5, 1)).alias("n_top"))


@query("latitude_bands", "SELECT floor(s_suppkey / 20) + 0.5 AS band, s_nationkey % 2 = 0 AS protected, round(median(s_acctbal), 6) + 0.0 AS mid, count(*) AS n FROM supplier GROUP BY 1, 2")
def latitude_bands(spark, sf_dir):
    """Medians by band and group."""
    s = read(spark, sf_dir, "supplier")
    return s.groupBy((F.floor(F.col("s_suppkey") / 20) + 0.5).alias("band"), (F.col("s_nationkey") % 2 == 0).alias("protected")).agg(r6(F.percentile("s_acctbal", 0.5), "mid"), F.count(F.lit(1)).alias("n"))


@query("nearest_to_centroid", "WITH m AS (SELECT avg(s_acctbal) AS a, avg(s_nationkey) AS b FROM supplier) SELECT arg_min(s_suppkey, round(sqrt(pow((s_acctbal - a) / 1000, 2) + pow(s_nationkey - b, 2)), 9)) AS unit FROM supplier CROSS JOIN m")
def nearest_to_centroid(spark, sf_dir):
    """The unit nearest to the means."""
    s = read(spark, sf_dir, "supplier")
    m = s.agg(F.avg("s_acctbal").alias("a"), F.avg("s_nationkey").alias("b"))
    d = F.round(F.hypot((F.col("s_acctbal") - F.col("a")) / 1000, F.col("s_nationkey") - F.col("b")), 9)
    return s.crossJoin(F.broadcast(m)).agg(F.min_by("s_suppkey", d).alias("unit"))


@query("ar1_innovations", f"""WITH {DENSE}, p AS (SELECT cell, day, x, lag(x) OVER (PARTITION BY cell ORDER BY day) AS y FROM dense), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), f AS (SELECT cell, regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM q GROUP BY 1)
    SELECT q.cell, q.day, round(x - a - b * y, 5) + 0.0 AS innovation FROM q JOIN f ON f.cell = q.cell""")
def ar1_innovations(spark, sf_dir):
    """What a first-order autoregression leaves."""
    q = dense(spark, sf_dir).withColumn("y", F.lag("x").over(Window.partitionBy("cell").orderBy("day"))).where("x is not null and y is not null")
    f = q.groupBy("cell").agg(F.regr_slope("x", "y").alias("b"), F.regr_intercept("x", "y").alias("a"))
    return q.join(F.broadcast(f), "cell").select("cell", "day", (F.round(F.col("x") - F.col("a") - F.col("b") * F.col("y"), 5) + F.lit(0.0)).alias("innovation"))


@query("seasonality_descriptors", _MONTH + " SELECT cell, round(stddev_pop(normal) / avg(normal), 6) + 0.0 AS amplitude, round((SELECT var_pop(v) FROM m m2 WHERE m2.cell = b.cell), 5) + 0.0 AS variance, round(max(normal) - min(normal), 6) + 0.0 AS range FROM b GROUP BY cell")
def seasonality_descriptors(spark, sf_dir):
    """Amplitude of the cycle, its range, variance of the months."""
    m = dense(spark, sf_dir).groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("x").alias("v"))
    b = m.where("year <= 1998").groupBy("cell", "month").agg(F.avg("v").alias("normal")).groupBy("cell").agg(r6(F.stddev_pop("normal") / F.avg("normal"), "amplitude"), r6(F.max("normal") - F.min("normal"), "range"))
    v = m.groupBy("cell").agg((F.round(F.var_pop("v"), 5) + F.lit(0.0)).alias("variance"))
    return b.join(v, "cell")


@query("hour_interpolation", """WITH h AS (SELECT event_type AS cell, date_trunc('hour', ts) AS t, avg(value) AS x FROM events GROUP BY 1, 2), p AS (SELECT cell, CAST(t AS DATE) AS day, avg(x) FILTER (WHERE hour(t) = 13) AS lo, avg(x) FILTER (WHERE hour(t) = 14) AS hi FROM h GROUP BY 1, 2)
    SELECT cell, day, round(lo + 0.4 * (hi - lo), 6) + 0.0 AS x FROM p WHERE lo IS NOT NULL AND hi IS NOT NULL""")
def hour_interpolation(spark, sf_dir):
    """A passing hour between two whole hours."""
    h = read(spark, sf_dir, "events").where(F.hour("ts").isin(13, 14)).groupBy(F.col("event_type").alias("cell"), F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("x"))
    at = lambda k: F.avg(F.when(F.hour("t") == k, F.col("x")))
    p = h.groupBy("cell", F.to_date("t").alias("day")).agg(at(13).alias("lo"), at(14).alias("hi")).where("lo is not null and hi is not null")
    return p.select("cell", "day", r6(F.col("lo") + 0.4 * (F.col("hi") - F.col("lo")), "x"))


@query("history_any_in_window", f"""WITH {DENSE}, m AS (SELECT cell, CAST(date_trunc('month', day) AS DATE) AS month, max(x) > 200 AS burnt FROM dense GROUP BY 1, 2), k AS (SELECT cell, month, coalesce(burnt, false) AS burnt FROM m)
    SELECT cell, month, burnt, coalesce(bool_or(burnt) OVER (PARTITION BY cell ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), false) AS before, coalesce(bool_or(burnt) OVER (PARTITION BY cell ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), false) AS after FROM k""")
def history_any_in_window(spark, sf_dir):
    """Whether anything happened in the months before and after."""
    k = dense(spark, sf_dir).groupBy("cell", F.trunc("day", "MM").cast("date").alias("month")).agg(F.coalesce(F.max("x") > 200, F.lit(False)).alias("burnt"))
    w = Window.partitionBy("cell").orderBy("month")
    return k.select("cell", "month", "burnt", F.coalesce(F.bool_or("burnt").over(w.rowsBetween(-6, -1)), F.lit(False)).alias("before"), F.coalesce(F.bool_or("burnt").over(w.rowsBetween(1, 9)), F.lit(False)).alias("after"))


@query("stratified_first_rows", """WITH s AS (SELECT c_custkey, c_nationkey % 3 AS a, c_mktsegment AS b, row_number() OVER (PARTITION BY c_nationkey % 3, c_mktsegment ORDER BY (c_custkey * 2654435761) % 4294967296, c_custkey) AS n FROM customer) SELECT c_custkey, a, b FROM s WHERE n <= 4""")
def stratified_first_rows(spark, sf_dir):
    """a few of each stratum in an order of hashed keys; the cap is the operator."""
    s = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("a"), F.col("c_mktsegment").alias("b"))
    n = F.row_number().over(Window.partitionBy("a", "b").orderBy((F.col("c_custkey") * 2654435761) % 4294967296, "c_custkey"))
    return s.withColumn("n", n).where("n <= 4").drop("n")


@query("territory_weighted_means", """SELECT CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'both' WHEN c_nationkey % 3 = 0 THEN 'first' WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'other' END AS label, round(sum(c_acctbal * (1 + c_custkey % 4)) / sum(1 + c_custkey % 4), 5) + 0.0 AS mean, count(*) AS n FROM customer GROUP BY 1""")
def territory_weighted_means(spark, sf_dir):
    """Labels by priority and weighted means by label."""
    a, b, w = F.col("c_nationkey") % 3 == 0, F.col("c_custkey") % 2 == 0, 1 + F.col("c_custkey") % 4
    label = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("other")
    return read(spark, sf_dir, "customer").groupBy(label.alias("label")).agg((F.round(F.sum(F.col("c_acctbal") * w) / F.sum(w), 5) + F.lit(0.0)).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("frequency_and_recency", """WITH y AS (SELECT l_suppkey AS cell, year(l_shipdate) AS year, count(*) FILTER (WHERE l_quantity >= 45) AS n FROM lineitem GROUP BY 1, 2) SELECT cell, CAST(sum(n) AS BIGINT) AS burnt, round(sum(n * ((SELECT max(year) FROM y) + 1 - year)) / sum(n), 6) + 0.0 AS since, round(sum(n) / count(*), 6) + 0.0 AS frequency FROM y GROUP BY 1 HAVING sum(n) > 0""")
def frequency_and_recency(spark, sf_dir):
    """How often, and how long ago on average, seen from the year after the table's last."""
    y = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.count(F.when(F.col("l_quantity") >= 45, 1)).alias("n"))
    y = y.crossJoin(F.broadcast(y.agg((F.max("year") + 1).alias("now"))))  # one row
    return y.groupBy("cell").agg(F.sum("n").alias("burnt"), r6(F.sum(F.col("n") * (F.col("now") - F.col("year"))) / F.sum("n"), "since"), r6(F.sum("n") / F.count(F.lit(1)), "frequency")).where("burnt > 0")


@query("regression_design", """WITH s AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer) SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS z, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS machinery FROM s""")
def regression_design(spark, sf_dir):
    """Centred and scaled covariates with dummies; the two moments are one row joined to all."""
    c = read(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    dummy = lambda v: F.when(F.col("c_mktsegment") == v, 1).otherwise(0)
    return c.crossJoin(F.broadcast(m)).select("c_custkey", r6((F.col("c_acctbal") - F.col("m")) / F.col("s"), "z"), dummy("BUILDING").alias("building"), dummy("MACHINERY").alias("machinery"))
