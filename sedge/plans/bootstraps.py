"""Intervals by resampling years, cells and blocks, and a permutation test, each with its SQL twin: draws are hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.operators import inference as I
from sedge.operators import resampling as B
from sedge.operators import spatial as P
from sedge.plans.base import r6
from sedge.plans.registry import query
from sedge.plans.statistics import _GRID, _SUPP, _grid, _supp
from sedge.sources.tables import read

DRAWS = 999


def _ends(df, *by):
    """interval()'s columns, rounded."""
    return df.select(*by, *(r6(c, c) for c in ("estimate", "lo", "hi", "p")), "draws")


_YEARS = "y AS (SELECT o_orderpriority AS grp, year(o_orderdate) AS yr, count(*) AS n, sum(o_totalprice / 1000) AS s FROM orders GROUP BY 1, 2)"


@query("year_bootstrap_summary", f"""WITH {_YEARS}, {B.picks_sql('p', 'y', 'yr', DRAWS, 'years', 'grp')},
    d AS (SELECT b AS grp, draw, sum(s * times) / sum(n * times) AS x FROM p JOIN y ON y.grp = p.b AND y.yr = p.yr GROUP BY 1, 2 UNION ALL SELECT grp, -1, sum(s) / sum(n) FROM y GROUP BY 1) {B.interval_sql('d', 'grp', 'x')}""")
def year_bootstrap_summary(spark, sf_dir):
    """Means by group with intervals by drawing whole years."""
    o = read(spark, sf_dir, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice"])
    sums = o.groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") / 1000).alias("s"))
    d = B.resampled(sums, "yr", ["n", "s"], DRAWS, "years", ["grp"]).withColumn("x", F.col("s") / F.col("n"))
    return _ends(B.interval(d, ["grp"], "x"), "grp")


_CELLS = "c AS (SELECT c_mktsegment AS grp, c_nationkey AS cell, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1, 2)"
LEAST_CELLS = 5


@query("cluster_mean_interval", f"""WITH {_CELLS}, {B.picks_sql('p', 'c', 'cell', DRAWS, 'cells', 'grp')},
    d AS (SELECT b AS grp, draw, sum(s * times) / sum(n * times) AS x FROM p JOIN c ON c.grp = p.b AND c.cell = p.cell GROUP BY 1, 2 UNION ALL SELECT grp, -1, sum(s) / sum(n) FROM c GROUP BY 1),
    e AS ({B.interval_sql('d', 'grp', 'x')}), k AS (SELECT grp, count(*) AS cells FROM c GROUP BY 1)
    SELECT grp, cells, estimate, CASE WHEN cells >= {LEAST_CELLS} THEN lo END AS lo, CASE WHEN cells >= {LEAST_CELLS} THEN hi END AS hi, CASE WHEN cells >= {LEAST_CELLS} THEN p END AS p, draws FROM e JOIN k USING (grp)""")
def cluster_mean_interval(spark, sf_dir):
    """Means weighted by row, with intervals by drawing whole cells; none with fewer than five cells."""
    sums = read(spark, sf_dir, "customer", ["c_mktsegment", "c_nationkey", "c_acctbal"]).groupBy(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    d = B.resampled(sums, "cell", ["n", "s"], DRAWS, "cells", ["grp"]).withColumn("x", F.col("s") / F.col("n"))
    out = _ends(B.interval(d, ["grp"], "x"), "grp").join(sums.groupBy("grp").agg(F.count(F.lit(1)).alias("cells")), "grp")
    enough = F.col("cells") >= LEAST_CELLS
    return out.select("grp", "cells", "estimate", *(F.when(enough, F.col(c)).alias(c) for c in ("lo", "hi", "p")), "draws")


_CROSSED = "x AS (SELECT year(o_orderdate) AS yr, o_custkey % 25 AS block, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS n1, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 1000 ELSE 0 END) AS s1, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS n2, sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice / 1000 ELSE 0 END) AS s2 FROM orders GROUP BY 1, 2)"


@query("paired_year_block_contrast", f"""WITH {_CROSSED}, {B.picks_sql('p', '(SELECT DISTINCT yr FROM x)', 'yr', DRAWS, 'y')}, {B.picks_sql('q', '(SELECT DISTINCT block FROM x)', 'block', DRAWS, 'b')},
    d AS (SELECT p.draw, sum(s1 * p.times * q.times) / sum(n1 * p.times * q.times) - sum(s2 * p.times * q.times) / sum(n2 * p.times * q.times) AS v FROM x JOIN p ON p.yr = x.yr JOIN q ON q.block = x.block AND q.draw = p.draw GROUP BY 1
    UNION ALL SELECT -1, sum(s1) / sum(n1) - sum(s2) / sum(n2) FROM x) {B.interval_sql('d', '', 'v')}""")
def paired_year_block_contrast(spark, sf_dir):
    """Difference of two groups in the same drawn years, crossed with drawn blocks."""
    o = read(spark, sf_dir, "orders", ["o_orderpriority", "o_orderdate", "o_totalprice", "o_custkey"])
    first, second = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    price = F.col("o_totalprice") / 1000
    x = o.groupBy(F.year("o_orderdate").alias("yr"), (F.col("o_custkey") % 25).alias("block")).agg(F.count(F.when(first, 1)).alias("n1"), F.sum(F.when(first, price).otherwise(0.0)).alias("s1"), F.count(F.when(second, 1)).alias("n2"), F.sum(F.when(second, price).otherwise(0.0)).alias("s2"))
    years = B.picks(x.select("yr").distinct(), "yr", DRAWS, "y")
    blocks = B.picks(x.select("block").distinct(), "block", DRAWS, "b").withColumnRenamed("times", "again")
    rows = x.join(years, "yr").join(blocks, ["block", "draw"]).withColumn("w", F.col("times") * F.col("again"))
    v = lambda w: F.sum(F.col("s1") * w) / F.sum(F.col("n1") * w) - F.sum(F.col("s2") * w) / F.sum(F.col("n2") * w)
    d = rows.groupBy("draw").agg(v(F.col("w")).alias("v")).unionAll(x.agg(v(F.lit(1)).alias("v")).select(F.lit(-1).alias("draw"), "v"))
    return _ends(B.interval(d, [], "v"))


@query("two_group_contrast", f"""WITH {_CELLS}, g AS (SELECT * FROM c WHERE grp IN ('BUILDING', 'MACHINERY')), {B.picks_sql('p', 'g', 'cell', DRAWS, 'two', 'grp')},
    m AS (SELECT b AS grp, draw, sum(s * times) / sum(n * times) AS x FROM p JOIN g ON g.grp = p.b AND g.cell = p.cell GROUP BY 1, 2 UNION ALL SELECT grp, -1, sum(s) / sum(n) FROM g GROUP BY 1),
    d AS (SELECT draw, max(CASE WHEN grp = 'BUILDING' THEN x END) - max(CASE WHEN grp = 'MACHINERY' THEN x END) AS v FROM m GROUP BY 1) {B.interval_sql('d', '', 'v')}""")
def two_group_contrast(spark, sf_dir):
    """Difference of the means of two groups, the cells of each drawn by themselves."""
    sums = read(spark, sf_dir, "customer", ["c_mktsegment", "c_nationkey", "c_acctbal"]).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    m = B.resampled(sums, "cell", ["n", "s"], DRAWS, "two", ["grp"]).withColumn("x", F.col("s") / F.col("n"))
    d = m.groupBy("draw").agg((F.max(F.when(F.col("grp") == "BUILDING", F.col("x"))) - F.max(F.when(F.col("grp") == "MACHINERY", F.col("x")))).alias("v"))
    return _ends(B.interval(d, [], "v"))


@query("global_rejection_fraction", f"""WITH c AS (SELECT c_nationkey AS cell, count(*) AS n, count(CASE WHEN (c_acctbal + 1000) / 11000 <= 0.05 THEN 1 END) AS s FROM customer GROUP BY 1), {B.picks_sql('p', 'c', 'cell', DRAWS, 'reject')},
    d AS (SELECT draw, sum(s * times) / CAST(sum(n * times) AS DOUBLE) AS x FROM p JOIN c ON c.cell = p.cell GROUP BY 1 UNION ALL SELECT -1, sum(s) / CAST(sum(n) AS DOUBLE) FROM c) {B.interval_sql('d', '', 'x')}""")
def global_rejection_fraction(spark, sf_dir):
    """Share of tests with p of at most 0.05, with an interval by drawing whole blocks."""
    p = (F.col("c_acctbal") + 1000) / 11000
    sums = read(spark, sf_dir, "customer", ["c_nationkey", "c_acctbal"]).groupBy(F.col("c_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(p <= 0.05, 1)).alias("s"))
    d = B.resampled(sums, "cell", ["n", "s"], DRAWS, "reject").withColumn("x", F.col("s") / F.col("n"))
    return _ends(B.interval(d, [], "x"))


# y on standardised x with a dummy for each category: sums by category are all that the slope needs
_SLOPE = "CASE WHEN sum(sxx - sx * sx / n) > 1e-9 THEN sum(sxy - sx * sy / n) / sum(sxx - sx * sx / n) END"
_FE = f"{_SUPP}, z AS (SELECT s_suppkey % 7 AS cell, grp, bal AS y, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS x FROM s), c AS (SELECT cell, grp, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM z GROUP BY 1, 2)"


@query("fixed_effects_slope_interval", f"""WITH {_FE}, {B.picks_sql('p', '(SELECT DISTINCT cell FROM c)', 'cell', 499, 'slope')},
    t AS (SELECT draw, grp, sum(n * times) AS n, sum(sx * times) AS sx, sum(sy * times) AS sy, sum(sxx * times) AS sxx, sum(sxy * times) AS sxy FROM p JOIN c ON c.cell = p.cell GROUP BY 1, 2
    UNION ALL SELECT -1, grp, sum(n), sum(sx), sum(sy), sum(sxx), sum(sxy) FROM c GROUP BY 2), d AS (SELECT draw, {_SLOPE} AS v FROM t GROUP BY 1) {B.interval_sql('d', '', 'v', 4)}""")
def fixed_effects_slope_interval(spark, sf_dir):
    """Slope on a standardised exposure with category dummies, cells drawn whole; a draw without variation has none, a category without rows no column."""
    s = _supp(spark, sf_dir)
    stats = s.agg(F.avg("q").alias("m"), F.stddev_samp("q").alias("sd"))
    z = s.crossJoin(F.broadcast(stats)).select((F.col("s_suppkey") % 7).alias("cell"), "grp", F.col("bal").alias("y"), ((F.col("q") - F.col("m")) / F.col("sd")).alias("x"))
    x, y = F.col("x"), F.col("y")
    sums = z.groupBy("cell", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    t = B.resampled(sums, "cell", ["n", "sx", "sy", "sxx", "sxy"], 499, "slope", within=["grp"])
    d = t.groupBy("draw").agg(F.expr(_SLOPE).alias("v"))
    return B.interval(d, [], "v").select(*((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("estimate", "lo", "hi", "p")), "draws")


_COLUMNS = ["n", "t", "z", "y", "tz", "zz", "ty", "zy"]
_PAIRED = f"{_SUPP}, r AS (SELECT s_suppkey % 9 AS cell, grp, CASE WHEN d > 0.05 THEN 1.0 ELSE 0.0 END AS t, CASE WHEN n % 6 = 0 THEN NULL ELSE q END AS z, bal AS y FROM s)"
_CONTEXT = _PAIRED + """, k AS (SELECT 'raw' AS kind, cell, 0 AS grp, t, 0.0 AS z, y FROM r UNION ALL SELECT 'raw_complete', cell, 0, t, 0.0, y FROM r WHERE z IS NOT NULL UNION ALL SELECT 'adjusted', cell, grp, t, z, y FROM r WHERE z IS NOT NULL),
    c AS (SELECT kind, cell, grp, count(*) AS n, sum(t) AS t, sum(z) AS z, sum(y) AS y, sum(t * z) AS tz, sum(z * z) AS zz, sum(t * y) AS ty, sum(z * y) AS zy FROM k GROUP BY 1, 2, 3)"""
_TT, _TZ, _ZZ, _TY, _ZY = "sum(t - t * t / n)", "sum(tz - t * z / n)", "sum(zz - z * z / n)", "sum(ty - t * y / n)", "sum(zy - z * y / n)"
_EFFECT = f"CASE WHEN {_TT} <= 1e-9 THEN NULL WHEN {_ZZ} <= 1e-9 THEN {_TY} / {_TT} WHEN {_TT} * {_ZZ} - {_TZ} * {_TZ} > 1e-9 * {_TT} * {_ZZ} THEN ({_TY} * {_ZZ} - {_ZY} * {_TZ}) / ({_TT} * {_ZZ} - {_TZ} * {_TZ}) END"


@query("adjusted_context_comparison", f"""WITH {_CONTEXT}, {B.picks_sql('p', '(SELECT DISTINCT kind, cell FROM c)', 'cell', DRAWS, 'context', 'kind')},
    w AS (SELECT c.kind, draw, grp, {', '.join(f'sum({x} * times) AS {x}' for x in _COLUMNS)} FROM p JOIN c ON c.kind = p.b AND c.cell = p.cell GROUP BY 1, 2, 3 UNION ALL SELECT kind, -1, grp, {', '.join(f'sum({x})' for x in _COLUMNS)} FROM c GROUP BY 1, 3),
    d AS (SELECT kind, draw, {_EFFECT} AS v FROM w GROUP BY 1, 2) {B.interval_sql('d', 'kind', 'v', 4)}""")
def adjusted_context_comparison(spark, sf_dir):
    """Difference between two contexts: raw, raw on complete rows, and adjusted for a category and a covariate; cells drawn whole, singular draws have no value."""
    s = _supp(spark, sf_dir)
    r = s.select((F.col("s_suppkey") % 9).alias("cell"), "grp", F.when(F.col("d") > 0.05, 1.0).otherwise(0.0).alias("t"), F.when(F.col("n") % 6 != 0, F.col("q")).alias("z"), F.col("bal").alias("y"))
    plain = lambda df, kind: df.select(F.lit(kind).alias("kind"), "cell", F.lit(0).cast("long").alias("grp"), "t", F.lit(0.0).alias("z"), "y")
    whole = r.where("z is not null")
    k = plain(r, "raw").unionAll(plain(whole, "raw_complete")).unionAll(whole.select(F.lit("adjusted").alias("kind"), "cell", F.col("grp").cast("long"), "t", "z", "y"))
    t, z, y = F.col("t"), F.col("z"), F.col("y")
    sums = k.groupBy("kind", "cell", "grp").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(name) for name, v in (("t", t), ("z", z), ("y", y), ("tz", t * z), ("zz", z * z), ("ty", t * y), ("zy", z * y))))
    d = B.resampled(sums, "cell", _COLUMNS, DRAWS, "context", ["kind"], ["grp"]).groupBy("kind", "draw").agg(F.expr(_EFFECT).alias("v"))
    return B.interval(d, ["kind"], "v").select("kind", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("estimate", "lo", "hi", "p")), "draws")


_RANKED = f"{_GRID}, h AS (SELECT k, lat, lon, x, lat + lon AS y FROM g), ranked AS (SELECT lat, lon, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM h)"
_BLOCKS = _RANKED + ", c AS (SELECT size, CAST(floor(lat / size) AS BIGINT) * 1000 + CAST(floor(lon / size) AS BIGINT) AS block, count(*) AS n, sum(rx) AS a, sum(ry) AS b2, sum(rx * rx) AS aa, sum(ry * ry) AS bb, sum(rx * ry) AS ab FROM ranked CROSS JOIN (VALUES (1.0), (2.0)) v(size) GROUP BY 1, 2)"
_RHO = "CASE WHEN (n * aa - a * a) * (n * bb - b2 * b2) > 1e-9 THEN (n * ab - a * b2) / sqrt((n * aa - a * a) * (n * bb - b2 * b2)) END"
_MOMENTS = ["n", "a", "b2", "aa", "bb", "ab"]


@query("block_bootstrap_association", f"""WITH {_BLOCKS}, {B.picks_sql('p', 'c', 'block', DRAWS, 'blocks', 'size')},
    w AS (SELECT c.size, draw, {', '.join(f'CAST(sum({x} * times) AS DOUBLE) AS {x}' for x in _MOMENTS)} FROM p JOIN c ON c.size = p.b AND c.block = p.block GROUP BY 1, 2 UNION ALL SELECT size, -1, {', '.join(f'CAST(sum({x}) AS DOUBLE)' for x in _MOMENTS)} FROM c GROUP BY 1),
    d AS (SELECT CAST(size AS DOUBLE) AS size, draw, {_RHO} AS v FROM w) {B.interval_sql('d', 'size', 'v')}""")
def block_bootstrap_association(spark, sf_dir):
    """Rank association with intervals by drawing whole spatial blocks, of two sizes."""
    g = _grid(spark, sf_dir).withColumn("y", F.col("lat") + F.col("lon"))
    ranked = g.withColumn("rx", I.average_rank("x")).withColumn("ry", I.average_rank("y")).withColumn("size", F.explode(F.array(F.lit(1.0), F.lit(2.0))))
    block = F.floor(F.col("lat") / F.col("size")) * 1000 + F.floor(F.col("lon") / F.col("size"))
    rx, ry = F.col("rx"), F.col("ry")
    sums = ranked.groupBy("size", block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum(rx).alias("a"), F.sum(ry).alias("b2"), F.sum(rx * rx).alias("aa"), F.sum(ry * ry).alias("bb"), F.sum(rx * ry).alias("ab"))
    d = B.resampled(sums, "block", _MOMENTS, DRAWS, "blocks", ["size"]).withColumn("v", F.expr(_RHO))
    return _ends(B.interval(d, ["size"], "v"), "size")


@query("moran_permutation_test", f"""WITH {_GRID}, v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, x - avg(x) OVER () AS d FROM g),
    o AS (SELECT draw, k, row_number() OVER (PARTITION BY draw ORDER BY md5('moran|' || draw || '|' || k), k) - 1 AS i FROM v CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
    r AS (SELECT o.draw, o.k, v.d FROM o JOIN v ON v.i = o.i UNION ALL SELECT -1, k, d FROM v),
    e AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.k <> b.k AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= 0.26),
    m AS (SELECT x.draw, round(sum(x.d * y.d) * (SELECT count(*) FROM v) / (SELECT count(*) FROM e) / (SELECT sum(d * d) FROM v), 9) AS i FROM e JOIN r x ON x.k = e.a JOIN r y ON y.k = e.b AND y.draw = x.draw GROUP BY 1),
    s AS (SELECT i AS seen FROM m WHERE draw = -1)
    SELECT round(max(seen), 6) + 0.0 AS moran, count(*) AS draws, round((1 + count(CASE WHEN i >= seen THEN 1 END)) / CAST(count(*) + 1 AS DOUBLE), 6) AS p FROM m CROSS JOIN s WHERE draw >= 0""")
def moran_permutation_test(spark, sf_dir):
    """Moran's I against values dealt anew to the cells."""
    g = _grid(spark, sf_dir)
    stats = g.agg(F.avg("x").alias("m"), F.count("x").alias("n"), (F.var_pop("x") * F.count("x")).alias("square"))
    pairs = P.neighbours(g, "k", "lat", "lon", 0.26).select("a", "b")
    dev = g.crossJoin(F.broadcast(stats.select("m"))).select("k", (F.col("x") - F.col("m")).alias("d"))
    r = B.permuted(dev, "k", "d", DRAWS, "moran")
    # both ends of a pair in one draw: the pairs are bounded by the cells, the rows by cells times draws
    x = pairs.join(r.select(F.col("k").alias("a"), "draw", F.col("d").alias("da")), "a").join(r.select(F.col("k").alias("b"), "draw", F.col("d").alias("db")), ["b", "draw"])
    m = x.groupBy("draw").agg(F.sum(F.col("da") * F.col("db")).alias("t"), F.count(F.lit(1)).alias("w")).crossJoin(F.broadcast(stats))
    m = m.select("draw", F.round(F.col("t") * F.col("n") / F.col("w") / F.col("square"), 9).alias("i"))
    seen = m.where("draw = -1").select(F.col("i").alias("seen"))
    out = m.where("draw >= 0").crossJoin(F.broadcast(seen)).agg(F.max("seen").alias("seen"), F.count(F.lit(1)).alias("draws"), F.count(F.when(F.col("i") >= F.col("seen"), 1)).alias("k"))
    return out.select(r6("seen", "moran"), "draws", F.round((1 + F.col("k")) / (F.col("draws") + 1), 6).alias("p"))
