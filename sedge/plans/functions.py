"""Scalar, array, map and text functions that the other queries build on, each by its row id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.plans.base import r6
from sedge.plans.registry import query
from sedge.sources.tables import read


@query("number_functions", """WITH s AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y, s_nationkey AS i, CAST(s_suppkey AS BIGINT) AS b FROM supplier)
    SELECT k, round(exp(x / 10), 6) + 0.0 AS e, round(ln(y + 1), 6) + 0.0 AS ln1, round(log2(y + 1), 6) + 0.0 AS lb, round(sqrt(abs(x)), 6) + 0.0 AS root, round(sqrt(x * x + y * y), 6) + 0.0 AS hyp, round(pow(x, 3), 6) + 0.0 AS cube,
    round(sin(radians(y)), 6) + 0.0 AS s, round(cos(radians(y)), 6) + 0.0 AS c, round(atan2(x, y + 1), 6) + 0.0 AS angle, round(acos(cos(radians(y))), 6) + 0.0 AS arc, CAST(sign(x) AS DOUBLE) AS sgn,
    CAST(floor(x) AS BIGINT) AS lo, CAST(ceil(x) AS BIGINT) AS hi, CAST(round_even(y / 2, 0) AS DOUBLE) AS even, least(greatest(x, 0.0), 5.0) AS clipped, CASE WHEN x IS NOT NULL AND i % 5 <> 0 THEN least(greatest(x, 0.0), 5.0) END AS clipped_known,
    least(abs(k * 37 % 366 - i * 11 % 366), 366 - abs(k * 37 % 366 - i * 11 % 366)) AS circle, i IN (1, 3, 5) AS listed, x BETWEEN 1 AND 4 AS between_both, CASE WHEN x < 0 THEN 'debt' WHEN x < 5 THEN 'some' ELSE 'much' END AS label, (b >> 2) & 3 AS bits, CAST(factorial(CAST(i % 8 AS INT)) AS BIGINT) AS fact FROM s""")
def number_functions(spark, sf_dir):
    """Exponentials, roots, angles, signs, rounding (half to even too), clipping that keeps nulls, circular distance, membership, choices, bits, factorials."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.col("s_nationkey").alias("i"))
    x, y, i, k = (F.col(c) for c in "xyik")
    clipped = F.least(F.greatest(x, F.lit(0.0)), F.lit(5.0))
    apart = F.abs(k * 37 % 366 - i * 11 % 366)
    return s.select(
        "k", r6(F.exp(x / 10), "e"), r6(F.log(y + 1), "ln1"), r6(F.log2(y + 1), "lb"), r6(F.sqrt(F.abs(x)), "root"), r6(F.hypot(x, y), "hyp"), r6(F.pow(x, 3), "cube"),
        r6(F.sin(F.radians(y)), "s"), r6(F.cos(F.radians(y)), "c"), r6(F.atan2(x, y + 1), "angle"), r6(F.acos(F.cos(F.radians(y))), "arc"), F.signum(x).alias("sgn"),
        F.floor(x).alias("lo"), F.ceil(x).alias("hi"), F.bround(y / 2, 0).alias("even"), clipped.alias("clipped"), F.when(x.isNotNull() & (i % 5 != 0), clipped).alias("clipped_known"),
        F.least(apart, 366 - apart).alias("circle"), i.isin(1, 3, 5).alias("listed"), x.between(1, 4).alias("between_both"), F.when(x < 0, "debt").when(x < 5, "some").otherwise("much").alias("label"), F.shiftright(k, 2).bitwiseAND(F.lit(3)).alias("bits"), F.factorial((i % 8).cast("int")).alias("fact"),
    )


_EDGES = (-500.0, 0.0, 2500.0, 5000.0, 7500.0)


@query("array_functions", f"""WITH n AS (SELECT s_nationkey AS nation, list(s_acctbal ORDER BY s_suppkey) AS v, list(s_suppkey ORDER BY s_acctbal, s_suppkey) AS sorted_keys, list_sort(list(s_acctbal)) AS sorted FROM supplier GROUP BY 1)
    SELECT nation, array_to_string(sorted_keys, ',') AS sorted_keys, CAST(list_sum(list_transform(v, lambda a: len(list_filter([{', '.join(map(str, _EDGES))}], lambda e: e <= a)))) AS BIGINT) AS bins, len(v || sorted) AS joined, round(list_sum(list_transform(range(0, 5), lambda j: 1 + (10 - 1) * j / 4.0)), 6) + 0.0 AS even_steps,
    round(list_sum(list_transform(range(0, 5), lambda j: pow(10, 2 * j / 4.0))), 6) + 0.0 AS even_ratios, len(list_filter(list_transform(range(1, CAST(len(v) AS BIGINT)), lambda j: v[j + 1] - v[j]), lambda d: d > 0)) AS rises FROM n""")
def array_functions(spark, sf_dir):
    """Stable order of keys, places among edges, joined arrays, even steps and ratios."""
    pair = F.struct("s_suppkey", "s_acctbal")
    n = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sort_array(F.collect_list(pair)).alias("p"))
    v = F.transform("p", lambda s: s["s_acctbal"])
    order = F.transform(F.array_sort(F.transform("p", lambda s: F.struct(s["s_acctbal"].alias("v"), s["s_suppkey"].alias("k")))), lambda s: s["k"])
    edges = F.array(*map(F.lit, _EDGES))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    places = F.aggregate(F.transform(v, lambda a: F.size(F.filter(edges, lambda e: e <= a))), F.lit(0).cast("long"), lambda s, e: s + e)
    steps = F.sequence(F.lit(0), F.lit(4))
    rises = F.size(F.filter(F.transform("p", lambda s, i: F.when(i > 0, s["s_acctbal"] - F.get(F.transform("p", lambda q: q["s_acctbal"]), i - 1))), lambda d: d > 0))
    return n.select("nation", F.array_join(order, ",").alias("sorted_keys"), places.alias("bins"), F.size(F.concat(v, F.sort_array(v))).cast("long").alias("joined"), r6(total(F.transform(steps, lambda j: 1 + 9 * j / 4)), "even_steps"), r6(total(F.transform(steps, lambda j: F.pow(F.lit(10.0), 2 * j / 4))), "even_ratios"), rises.cast("long").alias("rises"))


@query("counts_and_weights", """SELECT l_returnflag AS flag, l_linenumber AS line, count(*) AS n, round(sum(l_quantity * l_discount), 4) + 0.0 AS weight FROM lineitem GROUP BY 1, 2""")
def counts_and_weights(spark, sf_dir):
    """Unique values with their counts and weighted counts."""
    rows = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_linenumber", "l_quantity", "l_discount"])
    return rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 4) + F.lit(0.0)).alias("weight"))


@query("index_checks", """WITH o AS (SELECT o_custkey AS k, o_orderdate AS ts, o_orderkey AS id, o_totalprice AS x, lag(o_orderdate) OVER w AS before, o_totalprice - lag(o_totalprice) OVER w AS step, [o_totalprice, lead(o_totalprice, 1) OVER w, lead(o_totalprice, 2) OVER w] AS win, ntile(3) OVER w AS block FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT k, count(*) AS n, count(CASE WHEN ts < before THEN 1 END) = 0 AS rising, count(CASE WHEN ts = before THEN 1 END) AS repeats, round(sum(abs(step)), 4) + 0.0 AS moved, count(CASE WHEN win[3] IS NOT NULL THEN 1 END) AS windows, count(CASE WHEN block = 1 THEN 1 END) AS first_block FROM o GROUP BY 1""")
def index_checks(spark, sf_dir):
    """Whether an index rises and repeats, differences, sliding windows, even blocks."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"])
    o = o.withColumns({"before": F.lag("o_orderdate").over(w), "step": F.col("o_totalprice") - F.lag("o_totalprice").over(w), "win": F.array(*(F.lead("o_totalprice", k).over(w) for k in range(3))), "block": F.ntile(3).over(w)})
    some = lambda c: F.count(F.when(c, 1))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), (some(F.col("o_orderdate") < F.col("before")) == 0).alias("rising"), some(F.col("o_orderdate") == F.col("before")).alias("repeats"), (F.round(F.sum(F.abs("step")), 4) + F.lit(0.0)).alias("moved"), some(F.get("win", 2).isNotNull()).alias("windows"), some(F.col("block") == 1).alias("first_block"))


@query("pairs_and_products", """SELECT a.r_regionkey AS a, b.r_regionkey AS b, a.r_name || '/' || b.r_name AS names, a.r_regionkey * b.r_regionkey AS product FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey""")
def pairs_and_products(spark, sf_dir):
    """All pairs of a table of fixed size, the upper triangle only."""
    r = read(spark, sf_dir, "region")
    a, b = r.select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("na")), r.select(F.col("r_regionkey").alias("b"), F.col("r_name").alias("nb"))
    return F.broadcast(a).join(b, F.col("a") < F.col("b")).select("a", "b", F.concat_ws("/", "na", "nb").alias("names"), (F.col("a") * F.col("b")).alias("product"))


@query("missing_aware_statistics", """WITH p AS (SELECT p_brand AS brand, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS x, CAST(p_size AS DOUBLE) AS t FROM part)
    SELECT brand, count(*) AS n, count(x) AS known, round(avg(x), 7) + 0.0 AS mean, round(quantile_cont(x, 0.9), 5) + 0.0 AS q90, round(sum(coalesce(x, 0)), 4) + 0.0 AS filled, round(regr_slope(x, t), 6) + 0.0 AS slope, round(regr_intercept(x, t), 5) + 0.0 AS intercept FROM p GROUP BY 1""")
def missing_aware_statistics(spark, sf_dir):
    """Means, quantiles, sums and straight lines that leave missing values out or count them as 0."""
    p = read(spark, sf_dir, "part", ["p_brand", "p_size", "p_retailprice"]).select(F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("x"), F.col("p_size").cast("double").alias("t"))
    r5 = lambda c, name: (F.round(c, 5) + F.lit(0.0)).alias(name)
    return p.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("known"), (F.round(F.avg("x"), 7) + F.lit(0.0)).alias("mean"), r5(F.percentile("x", 0.9), "q90"), (F.round(F.sum(F.coalesce("x", F.lit(0.0))), 4) + F.lit(0.0)).alias("filled"), r6(F.regr_slope("x", "t"), "slope"), r5(F.regr_intercept("x", "t"), "intercept"))


_REGIONS = {0: "a", 1: "b", 2: "b"}


@query("maps_and_json", """WITH n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation), m AS (SELECT k, name, r, map_concat(map {'r': CAST(r AS VARCHAR), 'x': '0'}, map {'x': name}) AS m FROM n)
    SELECT k, coalesce((map {0: 'a', 1: 'b', 2: 'b'})[r], 'none') AS looked_up, m['x'] AS merged, m['r'] AS kept, CAST(to_json({'k': k, 'name': name}) AS VARCHAR) AS written, CAST(json_extract_string('{"v": [' || k || ', 7]}', '$.v[0]') AS BIGINT) AS back, CAST('0x' || substr(sha256(name), 1, 8) AS BIGINT) AS number, CAST(strptime('2004-0' || (1 + r) || '-15', '%Y-%m-%d') AS DATE) AS at FROM m""")
def maps_and_json(spark, sf_dir):
    """Times from text, lookups and merges of maps, JSON written and read, numbers from a SHA-256."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    known = F.create_map(*(F.lit(v) for kv in _REGIONS.items() for v in kv))
    first, second = F.create_map(F.lit("r"), F.col("r").cast("string"), F.lit("x"), F.lit("0")), F.create_map(F.lit("x"), F.col("name"))
    # the second map's entries win
    merged = F.map_concat(F.map_filter(first, lambda key, _: ~F.map_contains_key(second, key)), second)
    back = F.from_json(F.format_string('{"v": [%d, 7]}', F.col("k")), "v array<bigint>")["v"][0]
    return n.select(
        "k", F.coalesce(F.try_element_at(known, F.col("r").cast("int")), F.lit("none")).alias("looked_up"), merged["x"].alias("merged"), merged["r"].alias("kept"), F.to_json(F.struct("k", "name")).alias("written"), back.alias("back"),
        F.conv(F.substring(F.sha2("name", 256), 1, 8), 16, 10).cast("long").alias("number"), F.to_date(F.to_timestamp(F.format_string("2004-0%d-15", 1 + F.col("r")), "yyyy-MM-dd")).alias("at"),
    )


@query("codes_and_dummies", """WITH c AS (SELECT c_custkey AS k, dense_rank() OVER (PARTITION BY 0 ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS seg FROM customer) SELECT k, code, CAST(seg = 'BUILDING' AS INT) AS building, CAST(seg = 'MACHINERY' AS INT) AS machinery FROM c""")
def codes_and_dummies(spark, sf_dir):
    """Categories as codes in order of their names, and as dummies; categories are few, so their table is broadcast."""
    c = read(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    names = c.select("c_mktsegment").distinct().select("c_mktsegment", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long").alias("code"))
    dummy = lambda v: (F.col("c_mktsegment") == v).cast("int").alias(v.lower())
    return c.join(F.broadcast(names), "c_mktsegment").select(F.col("c_custkey").alias("k"), "code", dummy("BUILDING"), dummy("MACHINERY"))


_MONTHS = "m AS (SELECT l_returnflag AS cell, month(l_shipdate) - 1 AS t, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2)"


@query("amplitudes_of_the_year", f"""WITH {_MONTHS}, f AS (SELECT cell, k, sum(x * cos(-2 * pi() * k * t / 12)) AS re, sum(x * sin(-2 * pi() * k * t / 12)) AS im FROM m CROSS JOIN (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2),
    b AS (SELECT m.cell, m.t, sum(CASE WHEN k IN (0, 6) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * m.t / 12) - im * sin(2 * pi() * k * m.t / 12))) / 12 AS back FROM m JOIN f ON f.cell = m.cell GROUP BY 1, 2),
    e AS (SELECT m.cell, max(abs(m.x - b.back)) < 1e-9 AS inverse FROM m JOIN b ON b.cell = m.cell AND b.t = m.t GROUP BY 1)
    SELECT f.cell, k, round(sqrt(re * re + im * im), 5) + 0.0 AS amplitude, inverse FROM f JOIN e ON e.cell = f.cell""")
def amplitudes_of_the_year(spark, sf_dir):
    """Fourier sums of the twelve months and their inverse; longer series are transformed in the surrogates' kernels."""
    m = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_shipdate", "l_quantity"]).groupBy(F.col("l_returnflag").alias("cell"), (F.month("l_shipdate") - 1).alias("t")).agg(F.avg("l_quantity").alias("x"))
    turn = lambda k, t: 2 * F.pi() * k * t / 12
    k, t = F.col("k"), F.col("t")
    f = m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy("cell", "k").agg(F.sum(F.col("x") * F.cos(-turn(k, t))).alias("re"), F.sum(F.col("x") * F.sin(-turn(k, t))).alias("im"))
    twice = F.when(k.isin(0, 6), 1).otherwise(2)
    b = m.join(f, "cell").groupBy("cell", "t").agg(F.max("x").alias("x"), (F.sum(twice * (F.col("re") * F.cos(turn(k, t)) - F.col("im") * F.sin(turn(k, t)))) / 12).alias("back"))
    e = b.groupBy("cell").agg((F.max(F.abs(F.col("x") - F.col("back"))) < 1e-9).alias("inverse"))
    return f.join(e, "cell").select("cell", F.col("k").cast("long").alias("k"), (F.round(F.hypot("re", "im"), 5) + F.lit(0.0)).alias("amplitude"), "inverse")


@query("climatology_without_leap_days", """WITH d AS (SELECT l_returnflag AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), k AS (SELECT cell, dayofyear(day) - CASE WHEN dayofyear(make_date(year(day), 12, 31)) = 366 AND month(day) > 2 THEN 1 ELSE 0 END AS doy, x FROM d WHERE NOT (month(day) = 2 AND day(day) = 29)),
    c AS (SELECT cell, doy, avg(x) AS x FROM k GROUP BY 1, 2), w AS (SELECT a.cell, a.doy, round(avg(b.x), 5) + 0.0 AS smooth FROM c a JOIN c b ON b.cell = a.cell AND least(abs(a.doy - b.doy), 365 - abs(a.doy - b.doy)) <= 15 GROUP BY 1, 2) SELECT * FROM w""")
def climatology_without_leap_days(spark, sf_dir):
    """The mean of each of 365 days, smoothed over 31 days across New Year."""
    from sedge.functions.calendar import leap

    day = F.to_date("l_shipdate")
    d = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_shipdate", "l_quantity"]).groupBy(F.col("l_returnflag").alias("cell"), day.alias("day")).agg(F.sum("l_quantity").alias("x"))
    d = d.where(~((F.month("day") == 2) & (F.dayofmonth("day") == 29)))
    doy = F.dayofyear("day") - F.when(leap(F.year("day")) & (F.month("day") > 2), 1).otherwise(0)
    c = d.groupBy("cell", doy.alias("doy")).agg(F.avg("x").alias("x"))
    # each day of the year goes to the 31 that it smooths: a bounded explode
    reach = c.withColumn("at", F.explode(F.sequence(F.col("doy") - 15, F.col("doy") + 15))).select("cell", (F.pmod(F.col("at") - 1, F.lit(365)) + 1).alias("doy"), "x")
    return reach.groupBy("cell", "doy").agg((F.round(F.avg("x"), 5) + F.lit(0.0)).alias("smooth")).join(c.select("cell", "doy"), ["cell", "doy"]).select("cell", F.col("doy").cast("long").alias("doy"), "smooth")


@query("permissive_null_and_summary", """WITH r AS (SELECT c_mktsegment AS variable, c_nationkey AS kind, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM customer GROUP BY 1, 2),
    h AS (SELECT *, (rate + 1.92 / n + 1.96 * sqrt(rate * (1 - rate) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS high FROM r), m AS (SELECT variable, max(high) AS high FROM h GROUP BY 1)
    SELECT h.variable, min(kind) AS kind, round(any_value(m.high), 6) + 0.0 AS high FROM h JOIN m ON m.variable = h.variable AND abs(h.high - m.high) < 1e-12 GROUP BY 1""")
def permissive_null_and_summary(spark, sf_dir):
    """Of each group the null whose rate's upper bound is greatest; of ties the first."""
    n, rate = F.col("n"), F.col("rate")
    r = read(spark, sf_dir, "customer", ["c_mktsegment", "c_nationkey", "c_acctbal"]).groupBy(F.col("c_mktsegment").alias("variable"), F.col("c_nationkey").alias("kind")).agg(F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0)).alias("rate"), F.count(F.lit(1)).alias("n"))
    high = (rate + 1.92 / n + 1.96 * F.sqrt(rate * (1 - rate) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)
    best = r.withColumn("high", F.round(high, 12)).groupBy("variable").agg(F.max_by(F.struct("kind", "high"), F.struct("high", -F.col("kind"))).alias("b"))
    return best.select("variable", "b.kind", r6("b.high", "high"))
