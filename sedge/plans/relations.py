"""Aggregations, joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.operators import series as S
from sedge.plans.base import r6
from sedge.plans.registry import query
from sedge.sources.tables import first_of, read


@query("weighted_regional_mean", """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, n_regionkey AS region, round(sum(l_quantity * s_acctbal) FILTER (WHERE s_acctbal > 0) / sum(s_acctbal) FILTER (WHERE s_acctbal > 0), 6) + 0.0 AS mean
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def weighted_regional_mean(spark, sf_dir):
    """Weighted mean over cells per time; cells without weight don't count."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_acctbal", F.col("n_regionkey").alias("region"))
    rows = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).join(s.where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.trunc("l_shipdate", "MM").cast("date").alias("month"), "region").agg(r6(F.sum(F.col("l_quantity") * F.col("s_acctbal")) / F.sum("s_acctbal"), "mean"))


@query("yearly_counts_censored", """WITH y AS (SELECT l_suppkey AS unit, year(l_shipdate) AS year, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1, 2)
    SELECT s_suppkey AS unit, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, round(100.0 * coalesce(sum(n), 0) / (s_acctbal + 2000) / 7, 6) + 0.0 AS density, count(*) FILTER (WHERE n > 30) AS years_with, CAST(max(CASE WHEN n > 30 THEN year END) AS INTEGER) AS last_year, max(CASE WHEN n > 30 THEN year END) IS NULL AS censored
    FROM supplier LEFT JOIN y ON y.unit = s_suppkey GROUP BY s_suppkey, s_acctbal""")
def yearly_counts_censored(spark, sf_dir):
    """Counts by year to totals, density, years with events, the last one; never seen is null and flagged, not 0."""
    y = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag"]).groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n"))
    g = y.groupBy("unit").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") > 30, 1)).alias("years_with"), F.max(F.when(F.col("n") > 30, F.col("year"))).alias("last_year"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), "s_acctbal")
    total = F.coalesce("total", F.lit(0))
    return s.join(g, "unit", "left").select("unit", total.alias("total"), r6(100.0 * total / (F.col("s_acctbal") + 2000) / 7, "density"), F.coalesce("years_with", F.lit(0)).alias("years_with"), "last_year", F.col("last_year").isNull().alias("censored"))


@query("class_area_fractions", """WITH a AS (SELECT p_brand AS cell, CASE WHEN p_size <= 10 THEN 'forest' WHEN p_size <= 30 THEN 'pasture' WHEN p_size <= 45 THEN 'water' ELSE 'unobserved' END AS class, sum(p_retailprice) AS area FROM part GROUP BY 1, 2),
    w AS (SELECT cell, coalesce(sum(area) FILTER (WHERE class = 'forest'), 0) AS forest, coalesce(sum(area) FILTER (WHERE class = 'pasture'), 0) AS pasture, coalesce(sum(area) FILTER (WHERE class = 'water'), 0) AS water, coalesce(sum(area) FILTER (WHERE class = 'unobserved'), 0) AS unobserved FROM a GROUP BY 1)
    SELECT cell, round(forest + pasture, 2) + 0.0 AS land, round(forest / (forest + pasture), 6) + 0.0 AS forest_share, round(water / (forest + pasture + water + unobserved), 6) + 0.0 AS water_share FROM w""")
def class_area_fractions(spark, sf_dir):
    """Class areas by cell; shares of land, which excludes water and what was not observed."""
    size = F.col("p_size")
    kind = F.when(size <= 10, "forest").when(size <= 30, "pasture").when(size <= 45, "water").otherwise("unobserved")
    w = read(spark, sf_dir, "part").select(F.col("p_brand").alias("cell"), kind.alias("class"), "p_retailprice").groupBy("cell").pivot("class", ["forest", "pasture", "water", "unobserved"]).agg(F.sum("p_retailprice")).na.fill(0.0)
    land = F.col("forest") + F.col("pasture")
    return w.select("cell", (F.round(land, 2) + F.lit(0.0)).alias("land"), r6(F.col("forest") / land, "forest_share"), r6(F.col("water") / (land + F.col("water") + F.col("unobserved")), "water_share"))


@query("pivot_halves_difference", """WITH s AS (SELECT l_suppkey AS cell, l_returnflag AS variable, CASE WHEN year(l_shipdate) <= 1997 THEN 'first' ELSE 'second' END AS half, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)
    SELECT cell, variable, round(max(CASE WHEN half = 'first' THEN v END), 4) + 0.0 AS first, round(max(CASE WHEN half = 'second' THEN v END), 4) + 0.0 AS second, round(max(CASE WHEN half = 'second' THEN v END) - max(CASE WHEN half = 'first' THEN v END), 4) + 0.0 AS difference FROM s GROUP BY 1, 2""")
def pivot_halves_difference(spark, sf_dir):
    """Windows as columns and their difference, whatever the order of rows."""
    half = F.when(F.year("l_shipdate") <= 1997, "first").otherwise("second")
    p = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("variable"), half.alias("half"), "l_extendedprice").groupBy("cell", "variable").pivot("half", ["first", "second"]).agg(F.avg("l_extendedprice"))
    r4 = lambda x, n: (F.round(x, 4) + F.lit(0.0)).alias(n)
    return p.select("cell", "variable", r4(F.col("first"), "first"), r4(F.col("second"), "second"), r4(F.col("second") - F.col("first"), "difference"))


@query("unpivot_roundtrip", """SELECT s_suppkey AS cell, 'balance' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def unpivot_roundtrip(spark, sf_dir):
    """Columns as rows."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("cell", ["balance", "nation"], "variable", "value")


@query("transpose_grouped", """SELECT 'F' AS status, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) + 0.0 AS total FROM orders UNION ALL SELECT 'O', sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) + 0.0 FROM orders""")
def transpose_grouped(spark, sf_dir):
    """Grouping along the columns, by rows."""
    g = read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_orderstatus").alias("status"))
    return g.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("o_totalprice"), 2) + F.lit(0.0)).alias("total"))


@query("grouping_sets_rates", """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 250000) AS k, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END), 6) + 0.0 AS rate
    FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())""")
def grouping_sets_rates(spark, sf_dir):
    """Rates of all and by groups in one pass."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), (F.col("o_totalprice") > 250000).alias("hit"))
    g = rows.rollup("p", "s").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("k"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("rate"), F.grouping("p").alias("gp"), F.grouping("s").alias("gs"))
    return g.select(F.when(F.col("gp") == 1, "all").otherwise(F.col("p")).alias("priority"), F.when(F.col("gs") == 1, "all").otherwise(F.col("s")).alias("status"), "total", "k", r6("rate", "rate"))


@query("distinct_first_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_first_row(spark, sf_dir):
    """The first row of each key in a stated order."""
    return first_of(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("set_difference_and_intersection", """SELECT c_custkey, 'without' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def set_difference_and_intersection(spark, sf_dir):
    """Anti and semi joins, unioned."""
    c, o = read(spark, sf_dir, "customer", ["c_custkey"]), read(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"])
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_anti").withColumn("kind", F.lit("without")).unionByName(c.join(o.where("o_orderpriority = '1-URGENT'"), on, "left_semi").withColumn("kind", F.lit("urgent")))


@query("missing_from_spine", """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)""")
def missing_from_spine(spark, sf_dir):
    """Days of a period that a table lacks."""
    from sedge.sources.tables import missing_days

    return missing_days(read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")), "day", "1995-01-01", "2001-12-31")


@query("validated_many_to_one_join", """SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def validated_many_to_one_join(spark, sf_dir):
    """Left joins that fail where the right side's key repeats."""
    from sedge.sources.tables import many_to_one

    o = read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_custkey", "c_custkey")
    c = read(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"]).withColumnRenamed("c_nationkey", "n_nationkey")
    n = read(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return many_to_one(many_to_one(o, c, ["c_custkey"]), n, ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("self_join_base_grid", """WITH g AS (SELECT l_suppkey AS cell, l_returnflag AS variable, l_linenumber AS tau, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT a.cell, a.variable, a.tau, round(a.v - b.v, 6) + 0.0 AS change, a.v > b.v AS higher FROM g a JOIN g b ON b.cell = a.cell AND b.variable = a.variable AND b.tau = 1 WHERE a.tau > 1""")
def self_join_base_grid(spark, sf_dir):
    """Each grid point against its base."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("tau")).agg(F.avg("l_quantity").alias("v"))
    b = g.where("tau = 1").select("cell", "variable", F.col("v").alias("base"))
    return g.where("tau > 1").join(b, ["cell", "variable"]).select("cell", "variable", "tau", r6(F.col("v") - F.col("base"), "change"), (F.col("v") > F.col("base")).alias("higher"))


@query("asof_fallback_join", """WITH o AS (SELECT o_orderkey, o_custkey % 100 + 1 AS cell, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS seen, CAST(o_orderdate AS DATE) - 2 AS composite FROM orders),
    k AS (SELECT o_orderkey, cell, coalesce(seen, composite + 4) AS at FROM o), d AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2) SELECT k.o_orderkey, k.cell, k.at, d.x FROM k ASOF LEFT JOIN d ON d.cell = k.cell AND k.at >= d.day""")
def asof_fallback_join(spark, sf_dir):
    """The latest value of a cell at an instant, the instant falling back where it is missing."""
    day = F.to_date("o_orderdate")
    k = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("cell"), F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, day), F.date_add(F.date_sub(day, 2), 4)).alias("at"))
    d = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).groupBy(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("at")).agg(F.sum("l_quantity").alias("x"))
    return S.latest(k, d, ["cell"], "at", "x").select("o_orderkey", "cell", "at", "x")


@query("summary_quantiles", """SELECT s_nationkey AS zone, count(*) AS n, count(DISTINCT l_suppkey) AS cells, round(min(l_quantity), 6) + 0.0 AS low, round(quantile_cont(l_quantity, 0.1), 6) + 0.0 AS p10, round(median(l_quantity), 6) + 0.0 AS mid, round(quantile_cont(l_quantity, 0.9), 6) + 0.0 AS p90, round(avg(l_quantity), 6) + 0.0 AS mean FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def summary_quantiles(spark, sf_dir):
    """Counts, distinct cells and interpolated quantiles."""
    rows = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity"]).join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone")), "l_suppkey")
    q = F.percentile("l_quantity", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("cells"), F.min("l_quantity").alias("low"), q.alias("q"), F.avg("l_quantity").alias("mean"))
    return g.select("zone", "n", "cells", r6("low", "low"), r6(F.col("q")[0], "p10"), r6(F.col("q")[1], "mid"), r6(F.col("q")[2], "p90"), r6("mean", "mean"))


@query("common_support_overlap", """WITH g AS (SELECT c_mktsegment AS seg, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1), p AS (SELECT a.seg AS one, b.seg AS two, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM g a JOIN g b ON a.seg < b.seg)
    SELECT one, two, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, round(avg(CASE WHEN c_acctbal BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) + 0.0 AS share FROM p JOIN customer ON c_mktsegment IN (one, two) GROUP BY 1, 2, 3, 4""")
def common_support_overlap(spark, sf_dir):
    """What ranges groups share, pairwise, and the share of rows inside."""
    c = read(spark, sf_dir, "customer", ["c_mktsegment", "c_acctbal"])
    g = c.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    p = g.select(F.col("seg").alias("one"), F.col("lo").alias("l1"), F.col("hi").alias("h1")).join(g.select(F.col("seg").alias("two"), F.col("lo").alias("l2"), F.col("hi").alias("h2")), F.col("one") < F.col("two"))
    p = p.select("one", "two", F.greatest("l1", "l2").alias("lo"), F.least("h1", "h2").alias("hi"))
    sides = p.withColumn("c_mktsegment", F.explode(F.array("one", "two")))
    hit = F.when(F.col("c_acctbal").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)
    return c.join(F.broadcast(sides), "c_mktsegment").groupBy("one", "two", "lo", "hi").agg(r6(F.avg(hit), "share")).select("one", "two", r6("lo", "lo"), r6("hi", "hi"), "share")


@query("selection_funnel", """SELECT count(*) AS found, count(*) FILTER (WHERE l_returnflag <> 'R') AS not_reburnt, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity > 20) AS eligible, count(DISTINCT CASE WHEN l_returnflag <> 'R' AND l_quantity > 20 THEN l_suppkey END) AS cells FROM lineitem""")
def selection_funnel(spark, sf_dir):
    """How many rows each step of a selection keeps, in one pass."""
    a = F.col("l_returnflag") != "R"
    b = a & (F.col("l_quantity") > 20)
    return read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("found"), F.count(F.when(a, 1)).alias("not_reburnt"), F.count(F.when(b, 1)).alias("eligible"), F.countDistinct(F.when(b, F.col("l_suppkey"))).alias("cells"))


@query("before_after_windows", """WITH y AS (SELECT s_nationkey AS zone, year(l_shipdate) AS year, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), w(width) AS (VALUES (1), (2), (3))
    SELECT zone, width, round(avg(CASE WHEN year BETWEEN 1998 - width AND 1997 THEN n END), 6) + 0.0 AS before, round(avg(CASE WHEN year BETWEEN 1999 AND 1998 + width THEN n END), 6) + 0.0 AS after FROM y CROSS JOIN w GROUP BY 1, 2""")
def before_after_windows(spark, sf_dir):
    """Symmetric windows around a year that is left out, for several widths."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    y = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate"]).join(s, "l_suppkey").groupBy("zone", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    y = y.withColumn("width", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return y.groupBy("zone", "width").agg(r6(F.avg(F.when(F.col("year").between(1998 - F.col("width"), 1997), F.col("n"))), "before"), r6(F.avg(F.when(F.col("year").between(1999, 1998 + F.col("width")), F.col("n"))), "after"))


@query("two_source_reconciliation", """WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT o_orderstatus AS variable, count(*) AS n, count(*) FILTER (WHERE abs(v - o_totalprice) < 1e-9) AS same, round(max(abs(v - o_totalprice)), 2) + 0.0 AS max_abs, round(avg(v - o_totalprice), 3) + 0.0 AS bias, bool_and(abs(v - o_totalprice) <= 0.01 + 0.1 * abs(o_totalprice)) AS within FROM orders JOIN a ON k = o_orderkey GROUP BY 1""")
def two_source_reconciliation(spark, sf_dir):
    """Agreement of two sources of the same quantity."""
    a = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    d = F.col("v") - F.col("o_totalprice")
    g = read(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).join(a, "o_orderkey").groupBy(F.col("o_orderstatus").alias("variable"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(d) < 1e-9, 1)).alias("same"), (F.round(F.max(F.abs(d)), 2) + F.lit(0.0)).alias("max_abs"), (F.round(F.avg(d), 3) + F.lit(0.0)).alias("bias"), F.bool_and(F.abs(d) <= 0.01 + 0.1 * F.abs("o_totalprice")).alias("within"))


@query("request_plan", """WITH d AS (SELECT date_trunc('month', o_orderdate) AS m FROM orders), m AS (SELECT unnest(generate_series(CAST(min(m) AS TIMESTAMP), CAST(max(m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM d) SELECT CAST(m AS DATE) AS month, g AS part, CAST(dayofmonth(last_day(m)) AS INTEGER) AS days, substr(sha256(strftime(m, '%Y-%m') || '|' || g), 1, 20) AS key FROM m CROSS JOIN (VALUES ('instant'), ('total')) v(g)""")
def request_plan(spark, sf_dir):
    """A request for each month of the orders' span and group of variables, with a key of its content."""
    span = read(spark, sf_dir, "orders", ["o_orderdate"]).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    m = span.select(F.explode(F.sequence(F.to_date(F.date_trunc("month", "a")), F.to_date(F.date_trunc("month", "b")), F.expr("interval 1 month"))).alias("month"))
    rows = m.withColumn("part", F.explode(F.array(F.lit("instant"), F.lit("total"))))
    return rows.select("month", "part", F.dayofmonth(F.last_day("month")).alias("days"), F.substring(F.sha2(F.concat_ws("|", F.date_format("month", "yyyy-MM"), "part"), 256), 1, 20).alias("key"))


@query("covering_request", """WITH r AS (SELECT o_custkey AS k, list_sort(list(DISTINCT CAST(month(o_orderdate) AS INTEGER))) AS have FROM orders GROUP BY 1) SELECT k, len(have)::INTEGER AS n, list_has_all(have, [3, 6]) AS covers FROM r""")
def covering_request(spark, sf_dir):
    """Whether what is at hand covers what is asked for."""
    g = read(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.month("o_orderdate")).alias("have"))
    return g.select("k", F.size("have").alias("n"), (F.size(F.array_except(F.array(F.lit(3), F.lit(6)), "have")) == 0).alias("covers"))


@query("bounded_grouping", """WITH RECURSIVE y AS (SELECT year(o_orderdate) AS year, count(*) AS n, row_number() OVER (ORDER BY year(o_orderdate)) AS i FROM orders GROUP BY 1), b AS (SELECT max(n) * 2 AS most FROM y),
    g AS (SELECT i, year, n, n AS held, 0 AS part FROM y WHERE i = 1 UNION ALL SELECT y.i, y.year, y.n, CASE WHEN g.held + y.n > b.most THEN y.n ELSE g.held + y.n END, CASE WHEN g.held + y.n > b.most THEN g.part + 1 ELSE g.part END FROM g JOIN y ON y.i = g.i + 1 CROSS JOIN b)
    SELECT CAST(year AS INTEGER) AS year, n, CAST(part AS INTEGER) AS part FROM g""")
def bounded_grouping(spark, sf_dir):
    """consecutive years packed into requests under a size budget; years are few, the fold is one expression."""
    y = read(spark, sf_dir, "orders", ["o_orderdate"]).groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    a = y.agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("y"), (F.max("n") * 2).alias("most"))
    start = F.expr("named_struct('held', 0L, 'part', 0, 'out', cast(array() as array<struct<year:int,n:bigint,part:int>>))")

    def step(acc, v):
        more = acc["held"] + v["n"] > F.col("most")
        part = F.when(more & (F.size(acc["out"]) > 0), acc["part"] + 1).otherwise(acc["part"])
        held = F.when(more, v["n"]).otherwise(acc["held"] + v["n"])
        return F.struct(held.alias("held"), part.alias("part"), F.concat(acc["out"], F.array(F.struct(v["year"].alias("year"), v["n"].alias("n"), part.alias("part")))).alias("out"))

    return a.select(F.explode(F.aggregate("y", start, step)["out"]).alias("e")).select("e.*")


@query("text_functions", """SELECT s_suppkey, printf('ERA_%+07.2f_%+08.2f', floor(s_acctbal) / 4.0, CAST(s_nationkey AS DOUBLE)) AS id, contains(lower(s_name), 'supp') AS has, split_part(s_name, '#', 2) AS part, regexp_extract(s_name, '([0-9]+)', 1) AS digits, upper(substr(s_name, 1, 4)) AS head, replace(replace(replace(format('{:,.2f}', s_acctbal), ',', '_'), '.', ','), '_', '.') AS number FROM supplier""")
def text_functions(spark, sf_dir):
    """Formatted ids, parts, prefixes, extracts, numbers in another notation."""
    c = F.col
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("ERA_%+07.2f_%+08.2f", F.floor("s_acctbal") / 4.0, c("s_nationkey").cast("double")).alias("id"), F.contains(F.lower("s_name"), F.lit("supp")).alias("has"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("part"), F.regexp_extract("s_name", "([0-9]+)", 1).alias("digits"), F.upper(F.substring("s_name", 1, 4)).alias("head"), F.translate(F.format_number("s_acctbal", 2), ",.", ".,").alias("number"))


@query("interval_text_parsing", """WITH t AS (SELECT s_suppkey, 'rho ' || printf('%.2f', s_acctbal / 10000) || ' [' || printf('%.2f', s_acctbal / 10000 - 0.1) || '; ' || printf('%.2f', s_acctbal / 10000 + 0.1) || ']' AS txt FROM supplier), e AS (SELECT s_suppkey, regexp_extract_all(txt, '-?[0-9]+\\.[0-9]+') AS v FROM t) SELECT s_suppkey, CAST(v[1] AS DOUBLE) AS rho, CAST(v[2] AS DOUBLE) AS lo, CAST(v[3] AS DOUBLE) AS hi FROM e""".replace("\\\\", "\\"))
def interval_text_parsing(spark, sf_dir):
    """Numbers read back from a published text column."""
    a = F.col("s_acctbal") / 10000
    text = F.format_string("rho %.2f [%.2f; %.2f]", a, a - 0.1, a + 0.1)
    v = F.regexp_extract_all(text, F.lit(r"-?[0-9]+\.[0-9]+"), F.lit(0))
    return read(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", *(F.get("v", i).try_cast("double").alias(n) for i, n in enumerate(("rho", "lo", "hi"))))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has FROM events")
def json_properties(spark, sf_dir):
    """H rows on JSON and maps: a typed field of a JSON column."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events", ["event_id", "props"]).select("event_id", k.alias("k"), k.isNotNull().alias("has"))
