"""Tables that jobs read and publish: clips, masks, profiles, assemblies, result summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions.numbers import seed_of
from sedge.operators import inference as I
from sedge.plans.base import DENSE, dense, r6
from sedge.plans.registry import query
from sedge.plans.statistics import _GRID, _grid
from sedge.sources.tables import read


@query("clipped_scan", f"WITH {_GRID} SELECT round(lat, 4) + 0.0 AS lat, round(lon, 4) + 0.0 AS lon, CASE WHEN x >= 0 THEN x END AS x FROM g WHERE lat BETWEEN 0.55 AND 2.05 AND lon BETWEEN 0.35 AND 1.65")
def clipped_scan(spark, sf_dir):
    """Rows within a box snapped outwards to a raster, coordinates rounded, negative values missing."""
    low, high = (lambda v: float(np.floor(round(v / 0.05, 6)) * 0.05 - 0.05)), (lambda v: float(np.ceil(round(v / 0.05, 6)) * 0.05 + 0.05))
    g = _grid(spark, sf_dir).where(F.col("lat").between(low(0.6), high(2.0)) & F.col("lon").between(low(0.4), high(1.6)))
    return g.select((F.round("lat", 4) + F.lit(0.0)).alias("lat"), (F.round("lon", 4) + F.lit(0.0)).alias("lon"), F.when(F.col("x") >= 0, F.col("x")).alias("x"))


@query("nearest_snapshot", "SELECT event_type AS cell, arg_min(event_id, abs(epoch(ts) - epoch(TIMESTAMP '2024-01-10')) * 1000000 + event_id / 1e9) AS event_id, count(*) AS n FROM events GROUP BY 1")
def nearest_snapshot(spark, sf_dir):
    """The row nearest to an instant."""
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.lit("2024-01-10").cast("timestamp")) / 1e6) * 1000000 + F.col("event_id") / 1e9
    return read(spark, sf_dir, "events", ["event_id", "ts", "event_type"]).groupBy(F.col("event_type").alias("cell")).agg(F.min_by("event_id", gap).alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("merged_parts", "SELECT o_orderkey, o_totalprice, n_items FROM orders JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem WHERE year(l_shipdate) <= 1997 GROUP BY 1 UNION ALL SELECT l_orderkey, count(*) FROM lineitem WHERE year(l_shipdate) > 1997 GROUP BY 1) ON l_orderkey = o_orderkey")
def merged_parts(spark, sf_dir):
    """Parts of a period one after the other, groups of variables side by side."""
    c = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    early = F.year("l_shipdate") <= 1997
    part = lambda p: c.where(p).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    return read(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).join(part(early).unionByName(part(~early)), "o_orderkey")


@query("year_contract", "SELECT CAST(y AS INTEGER) AS year, (SELECT count(*) FROM orders WHERE year(o_orderdate) = y) AS n FROM (SELECT unnest(range(1994, 2003)) AS y)")
def year_contract(spark, sf_dir):
    """How many rows each required year has, 0 if it is missing."""
    y = spark.range(1994, 2003).select(F.col("id").cast("int").alias("year"))
    n = read(spark, sf_dir, "orders", ["o_orderdate"]).groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return y.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


@query("json_requests", """SELECT r_regionkey, '{"task":"' || lower(r_name) || '","year":' || CAST(2001 + r_regionkey AS VARCHAR) || '}' AS body FROM region""")
def json_requests(spark, sf_dir):
    """Request bodies and addresses from rows."""
    r = read(spark, sf_dir, "region")
    return r.select("r_regionkey", F.to_json(F.struct(F.lower("r_name").alias("task"), (F.lit(2001) + F.col("r_regionkey")).alias("year"))).alias("body"))


@query("only_named_region", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def only_named_region(spark, sf_dir):
    """Exactly one row of a key, or the query fails."""
    r = read(spark, sf_dir, "region").where("r_regionkey = 2")
    one = r.agg(F.count(F.lit(1)).alias("n")).where("assert_true(n = 1, 'not exactly one row') is null")
    return r.crossJoin(F.broadcast(one)).select("r_regionkey", "r_name")


@query("solar_hour_and_eligibility", f"WITH {_GRID} SELECT k, round(10.5 - lon / 15, 6) + 0.0 AS hour, coalesce(x / 10000 >= 0.5 AND lat >= 1, false) AS eligible, x IS NOT NULL AND isfinite(x) AS finite FROM g")
def solar_hour_and_eligibility(spark, sf_dir):
    """Passing hours, eligible rows, finite values."""
    x = F.col("x")
    from sedge.functions.meteorology import solar_passage_hour

    return _grid(spark, sf_dir).select("k", r6(solar_passage_hour(10.5, F.col("lon")), "hour"), F.coalesce((x / 10000 >= 0.5) & (F.col("lat") >= 1), F.lit(False)).alias("eligible"), (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("composite_keys", "SELECT split_part(k, '|', 1) AS class, CAST(split_part(k, '|', 2) AS INTEGER) AS year, n FROM (SELECT o_orderstatus || '|' || CAST(year(o_orderdate) AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1)")
def composite_keys(spark, sf_dir):
    """Keys of two parts taken apart."""
    k = F.concat_ws("|", "o_orderstatus", F.year("o_orderdate").cast("string"))
    g = read(spark, sf_dir, "orders", ["o_orderstatus", "o_orderdate"]).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.split_part("k", F.lit("|"), F.lit(1)).alias("class"), F.split_part("k", F.lit("|"), F.lit(2)).cast("int").alias("year"), "n")


@query("span_fraction", "SELECT s_nationkey AS cell, round(sum(l_quantity) FILTER (WHERE year(l_shipdate) BETWEEN 1995 AND 1997) / sum(l_quantity), 6) + 0.0 AS early, round(sum(l_quantity) FILTER (WHERE year(l_shipdate) BETWEEN 1998 AND 2001) / sum(l_quantity), 6) + 0.0 AS late FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def span_fraction(spark, sf_dir):
    """Shares of spans of years that are never split."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cell"))
    r = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).join(s, "l_suppkey")
    span = lambda a, b: F.sum(F.when(F.year("l_shipdate").between(a, b), F.col("l_quantity"))) / F.sum("l_quantity")
    return r.groupBy("cell").agg(r6(span(1995, 1997), "early"), r6(span(1998, 2001), "late"))


@query("suffix_stacked_points", "SELECT s_suppkey AS id, 'acctbal' AS variable, s_acctbal AS value FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 4 <> 0")
def suffix_stacked_points(spark, sf_dir):
    """The first column that ends in a layer's name, quality filtered, layers stacked."""
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 4 != 0")
    parts = [s.select(F.col("s_suppkey").alias("id"), F.lit(end).alias("variable"), F.col(next(c for c in s.columns if c.endswith(end))).cast("string").try_cast("double").alias("value")) for end in ("acctbal", "nationkey")]
    return parts[0].unionByName(parts[1])


@query("latitude_profile", f"WITH {_GRID} SELECT lat, round(sum(x * (1 + k % 3)) / sum(1 + k % 3), 5) + 0.0 AS mean FROM g GROUP BY 1")
def latitude_profile(spark, sf_dir):
    """Weighted means along latitudes."""
    w = 1 + F.col("k") % 3
    return _grid(spark, sf_dir).groupBy("lat").agg((F.round(F.sum(F.col("x") * w) / F.sum(w), 5) + F.lit(0.0)).alias("mean"))


@query("monthly_percentiles", f"WITH {DENSE}, m AS (SELECT cell, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, avg(x) AS v FROM dense GROUP BY 1, 2, 3) SELECT cell, month, round(avg(v), 6) + 0.0 AS mean, round(quantile_cont(v, 0.1), 6) + 0.0 AS p10, round(quantile_cont(v, 0.9), 6) + 0.0 AS p90 FROM m GROUP BY 1, 2")
def monthly_percentiles(spark, sf_dir):
    """Normals of months with their tenths."""
    m = dense(spark, sf_dir).groupBy("cell", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.avg("x").alias("v"))
    g = m.groupBy("cell", "month").agg(F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return g.select("cell", "month", r6("mean", "mean"), r6(F.col("q")[0], "p10"), r6(F.col("q")[1], "p90"))


@query("days_over_base_p90", f"WITH {DENSE}, q AS (SELECT cell, quantile_cont(x, 0.9) AS p FROM dense WHERE year(day) <= 1998 GROUP BY 1) SELECT d.cell, CAST(year(day) AS INTEGER) AS year, count(*) FILTER (WHERE x > p) AS days FROM dense d JOIN q ON q.cell = d.cell GROUP BY 1, 2")
def days_over_base_p90(spark, sf_dir):
    """Days over the base period's 90th percentile, by year."""
    d = dense(spark, sf_dir)
    q = d.where("year(day) <= 1998").groupBy("cell").agg(F.percentile("x", 0.9).alias("p"))
    return d.join(F.broadcast(q), "cell").groupBy("cell", F.year("day").alias("year")).agg(F.count(F.when(F.col("x") > F.col("p"), 1)).alias("days"))


@query("driest_quarter", f"WITH {DENSE}, m AS (SELECT cell, month(day) AS m, sum(coalesce(x, 0)) AS v FROM dense GROUP BY 1, 2), w AS (SELECT cell, m + o AS m, m AS own, v, o FROM m CROSS JOIN (VALUES (0), (12)) t(o)), s AS (SELECT cell, own, o, sum(v) OVER (PARTITION BY cell ORDER BY m ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS q FROM w) SELECT cell, CAST(arg_min(own, q) AS INTEGER) AS driest, CAST(arg_max(own, q) AS INTEGER) AS wettest FROM s WHERE o = 0 GROUP BY 1")
def driest_quarter(spark, sf_dir):
    """The first month of the driest and wettest three, around the year."""
    m = dense(spark, sf_dir).groupBy("cell", F.month("day").alias("own")).agg(F.sum(F.coalesce("x", F.lit(0.0))).alias("v"))
    w = m.withColumn("o", F.explode(F.array(F.lit(0), F.lit(12)))).withColumn("m", F.col("own") + F.col("o"))
    s = w.withColumn("q", F.sum("v").over(Window.partitionBy("cell").orderBy("m").rowsBetween(0, 2))).where("o = 0")
    return s.groupBy("cell").agg(F.min_by("own", "q").alias("driest"), F.max_by("own", "q").alias("wettest"))


@query("ever_and_persistent", "WITH y AS (SELECT l_suppkey AS cell, year(l_shipdate) AS y, max(l_quantity) >= 50 AS burnt, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END) AS share FROM lineitem GROUP BY 1, 2) SELECT cell, bool_or(burnt) AS ever, coalesce(bool_and(share >= 0.3) FILTER (WHERE y IN (1995, 2000)), false) AS persistent FROM y GROUP BY 1")
def ever_and_persistent(spark, sf_dir):
    """Anything over time; a share held in the first and the last year."""
    y = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.year("l_shipdate").alias("y")).agg((F.max("l_quantity") >= 50).alias("burnt"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("share"))
    return y.groupBy("cell").agg(F.bool_or("burnt").alias("ever"), F.coalesce(F.bool_and(F.when(F.col("y").isin(1995, 2000), F.col("share") >= 0.3)), F.lit(False)).alias("persistent"))


@query("composite_means", "SELECT l_suppkey AS cell, CAST(year(l_shipdate) * 46 + least(floor((dayofyear(l_shipdate) - 1) / 8), 45) AS INTEGER) AS step, CASE WHEN count(*) FILTER (WHERE l_linenumber <= 5) >= 0.5 * count(*) THEN round(avg(l_quantity) FILTER (WHERE l_linenumber <= 5), 6) + 0.0 END AS mean, count(*) FILTER (WHERE l_linenumber <= 5) AS valid, count(*) AS mask, round(median(dayofyear(l_shipdate)), 3) + 0.0 AS observed FROM lineitem GROUP BY 1, 2")
def composite_means(spark, sf_dir):
    """Means of valid pixels by cell and composite, with how many there were."""
    from sedge.functions.calendar import slot_ordinal

    ok = F.col("l_linenumber") <= 5
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), slot_ordinal(F.col("l_shipdate")).alias("step")).agg(F.avg(F.when(ok, F.col("l_quantity"))).alias("m"), F.count(F.when(ok, 1)).alias("valid"), F.count(F.lit(1)).alias("mask"), F.percentile(F.dayofyear("l_shipdate"), 0.5).alias("o"))
    return g.select("cell", "step", F.when(F.col("valid") >= 0.5 * F.col("mask"), r6("m", "m")).alias("mean"), "valid", "mask", (F.round("o", 3) + F.lit(0.0)).alias("observed"))


@query("zone_climate_coverage", f"WITH {DENSE}, m AS (SELECT cell, CAST(date_trunc('month', day) AS DATE) AS month, count(x) AS n, count(*) AS days, avg(x) AS v FROM dense GROUP BY 1, 2) SELECT month, CASE WHEN sum(CASE WHEN n >= 0.9 * days THEN w ELSE 0 END) >= 0.9 * sum(w) THEN round(sum(CASE WHEN n >= 0.9 * days THEN w * v END) / sum(CASE WHEN n >= 0.9 * days THEN w END), 6) + 0.0 END AS mean FROM m JOIN (VALUES ('A', 1.0), ('N', 2.0), ('R', 3.0)) t(c, w) ON c = cell GROUP BY 1")
def zone_climate_coverage(spark, sf_dir):
    """Means over a zone where nine tenths of days and of the area are there."""
    w = F.when(F.col("cell") == "A", 1.0).when(F.col("cell") == "N", 2.0).otherwise(3.0)
    m = dense(spark, sf_dir).groupBy("cell", F.trunc("day", "MM").cast("date").alias("month")).agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("days"), F.avg("x").alias("v")).withColumn("w", w)
    ok = F.col("n") >= 0.9 * F.col("days")
    g = m.groupBy("month").agg(F.sum(F.when(ok, F.col("w")).otherwise(0.0)).alias("have"), F.sum("w").alias("all"), F.sum(F.when(ok, F.col("w") * F.col("v"))).alias("s"))
    return g.select("month", F.when(F.col("have") >= 0.9 * F.col("all"), r6(F.col("s") / F.col("have"), "m")).alias("mean"))


@query("stabilisation_index", "WITH g AS (SELECT l_suppkey AS cell, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT cell, k, abs(lead(v) OVER w / v - 1) AS r FROM g WINDOW w AS (PARTITION BY cell ORDER BY k)) SELECT cell, CAST(coalesce(max(CASE WHEN r >= 0.25 THEN k END) + 1, 1) AS INTEGER) AS k FROM c GROUP BY 1")
def stabilisation_index(spark, sf_dir):
    """The least grid point after which all changes are small."""
    g = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_linenumber", "l_quantity"]).groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("v"))
    r = F.abs(F.lead("v").over(Window.partitionBy("cell").orderBy("k")) / F.col("v") - 1)
    return g.withColumn("r", r).groupBy("cell").agg(F.coalesce(F.max(F.when(F.col("r") >= 0.25, F.col("k"))) + 1, F.lit(1)).cast("int").alias("k"))


@query("assembled_cell_table", "SELECT coalesce(c.k, o.k) AS k, c.bal, o.n FROM (SELECT c_nationkey AS k, round(sum(c_acctbal), 2) + 0.0 AS bal FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) o ON o.k = c.k")
def assembled_cell_table(spark, sf_dir):
    """Columns of several sources side by side on one key, whichever has it."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.round(F.sum("c_acctbal"), 2) + F.lit(0.0)).alias("bal"))
    return c.join(read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "full")


@query("rejection_summary", """WITH t AS (SELECT l_returnflag AS variable, l_linenumber AS descriptor, l_suppkey AS cell, percent_rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY avg(l_extendedprice)) AS p, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
    SELECT variable, descriptor, round(avg(CASE WHEN p <= 0.05 + 1e-9 THEN 1.0 ELSE 0 END), 6) + 0.0 AS rejected, round(median(v), 6) + 0.0 AS mid, arg_max(cell, round(v, 9) * 1000000 - cell) AS top FROM t GROUP BY 1, 2""")
def rejection_summary(spark, sf_dir):
    """Shares rejected with a tolerance, medians, the leading cell."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("descriptor"), F.col("l_suppkey").alias("cell")).agg(F.avg("l_extendedprice").alias("e"), F.avg("l_quantity").alias("v"))
    t = g.withColumn("p", F.percent_rank().over(Window.partitionBy("variable", "descriptor").orderBy("e")))
    return t.groupBy("variable", "descriptor").agg(r6(F.avg(F.when(F.col("p") <= 0.05 + 1e-9, 1.0).otherwise(0.0)), "rejected"), r6(F.percentile("v", 0.5), "mid"), F.max_by("cell", F.round("v", 9) * 1000000 - F.col("cell")).alias("top"))


@query("holm_of_tests", """WITH t AS (SELECT l_returnflag AS region, l_linestatus AS method, round(avg(l_discount) * 10 - 0.3, 3) AS p FROM lineitem GROUP BY 1, 2), k AS (SELECT *, rank() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM t)
    SELECT region, method, p, round(least(max(p * (n - r + 1)) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) + 0.0 AS holm FROM k""")
def holm_of_tests(spark, sf_dir):
    """A family of a few tests adjusted."""
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("method")).agg(F.round(F.avg("l_discount") * 10 - 0.3, 3).alias("p")).withColumn("f", F.lit(1))
    return I.adjusted(t, ["f"], "p").select("region", "method", "p", r6("holm", "holm"))


@query("task_grid_with_seeds", "WITH g AS (SELECT kind, n, rep FROM (SELECT DISTINCT p_type AS kind FROM part) a CROSS JOIN (VALUES (512), (1024)) b(n) CROSS JOIN (SELECT unnest(range(0, 3)) AS rep) c), h AS (SELECT *, sha256('gate|' || kind || '|' || CAST(n AS VARCHAR) || '|' || CAST(rep AS VARCHAR)) AS h FROM g) SELECT kind, CAST(n AS INTEGER) AS n, CAST(rep AS INTEGER) AS rep, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) AS seed FROM h")
def task_grid_with_seeds(spark, sf_dir):
    """A grid of tasks over the kinds that the parts table holds, each with the seed of its parts."""
    g = read(spark, sf_dir, "part", ["p_type"]).select(F.col("p_type").alias("kind")).distinct().withColumn("n", F.explode(F.array(F.lit(512), F.lit(1024)))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return g.withColumn("seed", seed_of(F.lit("gate"), F.col("kind"), F.col("n").cast("string"), F.col("rep").cast("string")))


@query("gap_shares_and_density", f"WITH {DENSE} SELECT cell, CAST(year(day) AS INTEGER) AS year, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END), 6) + 0.0 AS gaps, round(100.0 * count(*) FILTER (WHERE x > 150) / (10 + ascii(cell)), 6) + 0.0 AS density FROM dense GROUP BY 1, 2")
def gap_shares_and_density(spark, sf_dir):
    """Missing shares and densities, rounded for reading."""
    g = dense(spark, sf_dir).groupBy("cell", F.year("day").alias("year"))
    return g.agg(r6(F.avg(F.when(F.col("x").isNull(), 1.0).otherwise(0.0)), "gaps"), r6(100.0 * F.count(F.when(F.col("x") > 150, 1)) / F.max(F.lit(10) + F.ascii("cell")), "density"))


@query("events_enriched", f"WITH {_GRID}, t AS (SELECT *, CAST(least(3, floor((row_number() OVER (ORDER BY x, k) - 1) * 3.0 / (count(*) OVER () - 1)) + 1) AS INTEGER) AS tertile FROM g) SELECT o_orderkey, t.tertile, CAST(floor(t.lat) AS BIGINT) || '_' || CAST(floor(t.lon) AS BIGINT) AS block, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'dry' ELSE 'wet' END AS season FROM orders JOIN t ON t.k = o_custkey % 100 + 1")
def events_enriched(spark, sf_dir):
    """Events with the attributes of their cell, a block and a season."""
    t = _grid(spark, sf_dir).withColumn("tertile", I.quantile_bin("x", 3, tie="k")).select(F.col("k").alias("cell"), "lat", "lon", "tertile")
    o = read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).withColumn("cell", F.col("o_custkey") % 100 + 1)
    return o.join(t, "cell").select("o_orderkey", "tertile", F.concat_ws("_", F.floor("lat").cast("string"), F.floor("lon").cast("string")).alias("block"), F.when(F.month("o_orderdate").between(6, 9), "dry").otherwise("wet").alias("season"))
