"""Verdicts and summaries of tests over cells, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions import calendar
from sedge.operators import diagnostics as G
from sedge.operators import events as E
from sedge.operators import forecasts as P
from sedge.operators import inference as I
from sedge.operators import resampling as B
from sedge.operators import series as S
from sedge.operators import summaries as M
from sedge.plans.base import CELL, DENSE, dense, r6, totals
from sedge.plans.events import _DELTA, _deltas
from sedge.plans.registry import query
from sedge.plans.statistics import _SUPP, _supp
from sedge.sources.tables import read

_RATES = """r AS (SELECT l_linenumber AS descriptor, l_suppkey % 6 AS control, CASE WHEN l_suppkey % 6 < 3 THEN 'positive' WHEN l_suppkey % 6 < 5 THEN 'size' ELSE 'alert' END AS role, CASE l_linestatus WHEN 'O' THEN 8766 ELSE 2048 END AS n,
    CASE l_returnflag WHEN 'R' THEN 0.2 ELSE 0.0 END AS noise, avg(CASE WHEN l_quantity >= CASE WHEN l_suppkey % 6 < 3 THEN 10 ELSE 41 END THEN 1.0 ELSE 0 END) AS rate FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


@query("gate_verdict", f"""WITH {_RATES}, f AS (SELECT * FROM r WHERE n = (SELECT max(n) FROM r) AND noise = (SELECT max(noise) FROM r)),
    g AS (SELECT descriptor, count(*) FILTER (WHERE role = 'positive') AS positives, count(*) FILTER (WHERE role = 'positive' AND rate >= 0.8) AS powered, count(*) FILTER (WHERE role = 'size' AND rate > 0.2) AS oversized, max(CASE WHEN role = 'alert' THEN rate END) AS alert_rate FROM f GROUP BY 1)
    SELECT descriptor, positives, powered, oversized, round(alert_rate, 6) + 0.0 AS alert_rate, powered >= 2 AND oversized = 0 AS passed FROM g""")
def gate_verdict(spark, sf_dir):
    """Which descriptors pass on power and size, at the greatest length and noise."""
    c = F.col("l_suppkey") % 6
    role = F.when(c < 3, "positive").when(c < 5, "size").otherwise("alert")
    rejected = F.when(F.col("l_quantity") >= F.when(c < 3, 10).otherwise(41), 1.0).otherwise(0.0)
    rows = read(spark, sf_dir, "lineitem", ["l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity"])
    keys = [F.col("l_linenumber").alias("descriptor"), c.alias("control"), role.alias("role"), F.when(F.col("l_linestatus") == "O", 8766).otherwise(2048).alias("n"), F.when(F.col("l_returnflag") == "R", 0.2).otherwise(0.0).alias("noise")]
    out = M.gate_verdict(rows.groupBy(*keys).agg(F.avg(rejected).alias("rate")), 0.8, 0.2, 2)
    return out.withColumn("alert_rate", r6("alert_rate", "alert_rate"))


_GAINS = """g AS (SELECT s_nationkey % 3 AS grp, s_suppkey AS cell, draw, CAST('0x' || substr(md5('gain|' || s_suppkey || '|' || draw), 1, 8) AS BIGINT) / 4294967296.0 + CASE WHEN draw = 0 THEN s_acctbal / 20000 ELSE 0 END AS gain FROM supplier CROSS JOIN (SELECT unnest(range(40)) AS draw))"""


@query("permutation_summary", f"""WITH {_GAINS}, n AS (SELECT * FROM g WHERE draw > 0), o AS (SELECT a.grp, a.cell, a.draw, a.gain, CASE WHEN a.gain > quantile_cont(b.gain, 0.95) THEN 1.0 ELSE 0 END AS beyond FROM n a JOIN n b ON b.cell = a.cell AND b.draw <> a.draw GROUP BY 1, 2, 3, 4),
    s AS (SELECT g.grp, g.cell, 0 AS draw, g.gain, CASE WHEN g.gain > quantile_cont(n.gain, 0.95) THEN 1.0 ELSE 0 END AS beyond FROM g JOIN n ON n.cell = g.cell WHERE g.draw = 0 GROUP BY 1, 2, 3, 4),
    p AS (SELECT grp, draw, round(median(gain), 9) AS m, round(avg(beyond), 9) AS f, count(*) AS cells FROM (SELECT * FROM o UNION ALL SELECT * FROM s) GROUP BY 1, 2), d AS (SELECT grp, m AS om, f AS fo, cells FROM p WHERE draw = 0)
    SELECT d.grp, any_value(d.cells) AS cells, round(any_value(om), 6) + 0.0 AS gain_median, round(any_value(fo), 6) + 0.0 AS cells_beyond, round(median(m), 6) + 0.0 AS null_median, round((1 + count(*) FILTER (WHERE m >= om)) / (count(*) + 1.0), 6) + 0.0 AS p, round((1 + count(*) FILTER (WHERE f >= fo)) / (count(*) + 1.0), 6) + 0.0 AS p_beyond FROM d JOIN p ON p.grp = d.grp AND p.draw > 0 GROUP BY 1""")
def permutation_summary(spark, sf_dir):
    """Medians over cells against those of shared permutations, and cells beyond their own."""
    rows = read(spark, sf_dir, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(39))))
    gain = B.drawn("gain", F.col("s_suppkey"), F.col("draw")) / 4294967296.0 + F.when(F.col("draw") == 0, F.col("s_acctbal") / 20000).otherwise(0.0)
    out = M.permutation_summary(rows.select((F.col("s_nationkey") % 3).alias("grp"), F.col("s_suppkey").alias("cell"), "draw", gain.alias("gain")), ["grp"])
    return out.select("grp", "cells", *(r6(c, c) for c in ("gain_median", "cells_beyond", "null_median", "p", "p_beyond")))


_HALF = "year(l_shipdate) + CASE WHEN month(l_shipdate) > 6 THEN 0.5 ELSE 0.0 END"


@query("trend_field", f"""WITH y AS (SELECT l_returnflag AS field, l_suppkey % 50 AS unit, CAST({_HALF} AS DOUBLE) AS t, round(avg(l_quantity), 1) AS x FROM lineitem GROUP BY 1, 2, 3),
    pr AS (SELECT a.field, a.unit, (b.x - a.x) / (b.t - a.t) AS s, sign(b.x - a.x) AS g FROM y a JOIN y b ON b.field = a.field AND b.unit = a.unit AND b.t > a.t), k AS (SELECT field, unit, median(s) AS slope, sum(g) AS s FROM pr GROUP BY 1, 2),
    ti AS (SELECT field, unit, sum(c * (c - 1) * (2 * c + 5)) AS ties, CAST(sum(c) AS BIGINT) AS n FROM (SELECT field, unit, x, count(*) AS c FROM y GROUP BY 1, 2, 3) GROUP BY 1, 2),
    v AS (SELECT ti.field, ti.unit, n, slope, coalesce(s, 0) AS s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS variance FROM ti LEFT JOIN k ON k.field = ti.field AND k.unit = ti.unit),
    res AS (SELECT y.field, y.unit, t, round(x - coalesce(slope, 0) * t, 9) AS r, n FROM y JOIN v ON v.field = y.field AND v.unit = y.unit),
    c AS (SELECT field, unit, n, row_number() OVER (PARTITION BY field, unit ORDER BY t) AS i, rank() OVER (PARTITION BY field, unit ORDER BY r) + (count(*) OVER (PARTITION BY field, unit, r) - 1) / 2.0 - (n + 1) / 2.0 AS c FROM res),
    sq AS (SELECT field, unit, sum(c * c) AS sq FROM c GROUP BY 1, 2),
    rho AS (SELECT a.field, a.unit, a.n, b.i - a.i AS k, sum(a.c * b.c) / nullif(any_value(sq.sq), 0) AS rho FROM c a JOIN c b ON b.field = a.field AND b.unit = a.unit AND b.i > a.i JOIN sq ON sq.field = a.field AND sq.unit = a.unit WHERE b.i - a.i <= a.n - 3 GROUP BY 1, 2, 3, 4),
    hr AS (SELECT field, unit, sum(CASE WHEN abs(rho) > {I.Z95} / sqrt(n) THEN (n - k) * (n - k - 1) * (n - k - 2) * rho ELSE 0 END) AS total FROM rho GROUP BY 1, 2),
    f AS (SELECT v.*, CASE WHEN n >= 3 THEN greatest(1 + 2 * coalesce(total, 0) / (n * (n - 1) * (n - 2)), 1e-6) ELSE 1.0 END AS ratio FROM v LEFT JOIN hr ON hr.field = v.field AND hr.unit = v.unit),
    zz AS (SELECT *, CASE WHEN n >= 8 AND variance > 0 THEN (s - sign(s)) / sqrt(variance * ratio) END AS z FROM f), p AS (SELECT *, CASE WHEN z IS NOT NULL THEN round({M.two_sided_normal_sql('z')}, 6) END AS p FROM zz),
    r AS (SELECT *, count(*) OVER (PARTITION BY field) AS m, rank() OVER (PARTITION BY field ORDER BY p) + count(*) OVER (PARTITION BY field, p) - 1 AS l FROM p WHERE p IS NOT NULL),
    q AS (SELECT field, unit, n, slope, ratio, p, least(min(p * m / l) OVER (PARTITION BY field ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS q FROM r UNION ALL SELECT field, unit, n, slope, ratio, p, NULL FROM p WHERE p IS NULL)
    SELECT field, unit, CAST(n AS INTEGER) AS n, round(CASE WHEN n >= 8 THEN 10 * slope END, 6) + 0.0 AS slope, round(ratio, 6) + 0.0 AS ratio, p + 0.0 AS p, round(q, 6) + 0.0 AS q, coalesce(q < 0.05, false) AS marked FROM q""")
def trend_field(spark, sf_dir):
    """Trends of half-yearly values by cell, marked where the p, corrected for autocorrelation and adjusted over the field, is under 0.05."""
    half = F.year("l_shipdate") + F.when(F.month("l_shipdate") > 6, 0.5).otherwise(0.0)
    rows = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_suppkey", "l_shipdate", "l_quantity"])
    y = rows.groupBy(F.col("l_returnflag").alias("field"), (F.col("l_suppkey") % 50).alias("unit"), half.alias("t")).agg(F.round(F.avg("l_quantity"), 1).alias("x"))
    return M.trend_field(y, ["field"], "unit", "t", "x", 0.05).select("field", "unit", "n", *(r6(c, c) for c in ("slope", "ratio", "p", "q")), "marked")


_VARIANTS = f"{_SUPP}, v AS (SELECT grp, s_suppkey AS cell, variant, q + variant * round(CAST('0x' || substr(md5('variant|' || s_suppkey || '|' || variant), 1, 8) AS BIGINT) / 4294967296.0, 6) AS z, CAST('0x' || substr(md5('p|' || s_suppkey || '|' || variant), 1, 8) AS BIGINT) / 4294967296.0 AS p, bal AS exposure, d AS control FROM s CROSS JOIN (VALUES (0), (1), (4)) a(variant)), t AS (SELECT v.*, b.z AS base_z FROM v JOIN v b ON b.grp = v.grp AND b.cell = v.cell AND b.variant = 0)"


def _rank(c):
    return f"rank() OVER (PARTITION BY grp, variant ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, variant, {c}) - 1) / 2.0"


@query("variants_against_base", f"""WITH {_VARIANTS}, r AS (SELECT grp, variant, z, p, {_rank('z')} AS rz, {_rank('base_z')} AS rb, {_rank('exposure')} AS rx, {_rank('control')} AS rc FROM t), k AS (SELECT grp, variant, count(*) AS cells, avg(CASE WHEN p <= 0.1 THEN 1.0 ELSE 0 END) AS rejects, median(z) AS z_median, corr(rz, rb) AS rho_base, corr(rx, rz) AS xy, corr(rx, rc) AS xz, corr(rz, rc) AS yz FROM r GROUP BY 1, 2)
    SELECT grp, variant, cells, round(rejects, 6) + 0.0 AS rejects, round(z_median, 6) + 0.0 AS z_median, round(rho_base, 6) + 0.0 AS rho_base, round(CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) + 0.0 AS partial FROM k""")
def variants_against_base(spark, sf_dir):
    """Variants of a batch beside the original in the same cells; intervals are block_bootstrap_association's."""
    s = _supp(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))))
    share = lambda seed: B.drawn(seed, F.col("s_suppkey"), F.col("variant")) / 4294967296.0
    rows = s.select("grp", F.col("s_suppkey").alias("cell"), "variant", (F.col("q") + F.col("variant") * F.round(share("variant"), 6)).alias("z"), share("p").alias("p"), F.col("bal").alias("exposure"), F.col("d").alias("control"))
    return M.against_base(rows, ["grp"], 0, 0.1).select("grp", "variant", "cells", *(r6(c, c) for c in ("rejects", "z_median", "rho_base", "partial")))


@query("gain_by_horizon", """WITH t AS (SELECT l_returnflag AS variable, l_suppkey AS cell, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS horizon, avg(l_discount) AS gain, round(avg(l_extendedprice), 4) AS e FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT *, round(pow(percent_rank() OVER (PARTITION BY variable, horizon ORDER BY e), 3), 9) AS p FROM t),
    r AS (SELECT *, count(*) OVER (PARTITION BY variable, horizon) AS m, rank() OVER (PARTITION BY variable, horizon ORDER BY p) + count(*) OVER (PARTITION BY variable, horizon, p) - 1 AS l FROM p),
    q AS (SELECT variable, horizon, gain, round(least(min(p * m / l) OVER (PARTITION BY variable, horizon ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 9) AS q FROM r)
    SELECT variable, horizon, count(*) AS cells, round(avg(CASE WHEN q <= 0.05 THEN 1.0 ELSE 0 END), 6) + 0.0 AS rejected, round(median(gain), 6) + 0.0 AS gain FROM q GROUP BY 1, 2""")
def gain_by_horizon(spark, sf_dir):
    """Share of cells with an adjusted p of at most 0.05, and median gain, by variable and horizon."""
    horizon = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(7)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    t = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_suppkey", "l_linenumber", "l_discount", "l_extendedprice"]).groupBy(F.col("l_returnflag").alias("variable"), F.col("l_suppkey").alias("cell"), horizon.alias("horizon")).agg(F.avg("l_discount").alias("gain"), F.round(F.avg("l_extendedprice"), 4).alias("e"))
    p = F.round(F.pow(F.percent_rank().over(Window.partitionBy("variable", "horizon").orderBy("e")), 3), 9)
    q = I.adjusted(t.withColumn("p", p), ["variable", "horizon"], "p").withColumn("q", F.round("bh", 9))
    return q.groupBy("variable", "horizon").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg(F.when(F.col("q") <= 0.05, 1.0).otherwise(0.0)), "rejected"), r6(F.percentile("gain", 0.5), "gain"))


_HALVES = {"first": (1995, 1997), "second": (1998, 2000)}


@query("dry_season_overpass", "WITH d AS (SELECT l_suppkey AS cell, year(l_shipdate) AS y, l_quantity AS skt, l_tax < 0.04 AS clear FROM lineitem WHERE month(l_shipdate) BETWEEN 6 AND 9), g AS (SELECT cell, count(skt) AS n, avg(skt) AS skt, " + ", ".join(f"avg(CASE WHEN y BETWEEN {a} AND {b} THEN skt END) AS skt_{h}" for h, (a, b) in _HALVES.items()) + ", avg(CASE WHEN clear THEN skt END) AS skt_clear, count(*) FILTER (WHERE clear) / CAST(nullif(count(skt), 0) AS DOUBLE) AS clear FROM d GROUP BY 1) SELECT cell, n, round(skt, 6) + 0.0 AS skt, round(skt_first, 6) + 0.0 AS skt_first, round(skt_second, 6) + 0.0 AS skt_second, round(skt_second - skt_first, 6) + 0.0 AS skt_change, round(skt_clear, 6) + 0.0 AS skt_clear, round(clear, 6) + 0.0 AS clear FROM g")
def dry_season_overpass(spark, sf_dir):
    """Dry-season means of whole and half periods, their change, and of clear skies only."""
    v, y = F.col("l_quantity"), F.year("l_shipdate")
    clear = F.col("l_tax") < 0.04
    rows = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_tax"]).where(F.month("l_shipdate").between(6, 9))
    halves = [F.avg(F.when(y.between(a, b), v)).alias(f"skt_{h}") for h, (a, b) in _HALVES.items()]
    g = rows.groupBy(F.col("l_suppkey").alias("cell")).agg(F.count(v).alias("n"), F.avg(v).alias("skt"), *halves, F.avg(F.when(clear, v)).alias("skt_clear"), (F.count(F.when(clear, 1)) / F.count(v)).alias("clear"))
    g = g.withColumn("skt_change", F.col("skt_second") - F.col("skt_first"))
    return g.select("cell", "n", *(r6(c, c) for c in ("skt", "skt_first", "skt_second", "skt_change", "skt_clear", "clear")))


_LABELS = [("before", -12, -1), ("early", 1, 6), ("late", 13, 36), ("never", 900, 911)]
_MEANS = f"WITH {_DELTA}, g AS (SELECT unit, " + ", ".join(f"CASE WHEN count(CASE WHEN k BETWEEN {a} AND {b} THEN delta END) >= {0.5 * (b - a + 1)} THEN avg(CASE WHEN k BETWEEN {a} AND {b} THEN delta END) END AS {n}" for n, a, b in _LABELS) + " FROM dd GROUP BY 1)"


@query("recovery_by_group", _MEANS + ", l AS (" + " UNION ALL ".join(f"SELECT unit, '{n}' AS period, {n} AS v FROM g" for n, _, _ in _LABELS) + """), grouped AS (SELECT unit % 2 AS grp, unit % 7 AS cluster, period, v FROM l)
    SELECT grp, period, count(v) AS episodes, count(DISTINCT CASE WHEN v IS NOT NULL THEN cluster END) AS clusters, round(avg(v), 6) + 0.0 AS mean FROM grouped GROUP BY 1, 2""")
def recovery_by_group(spark, sf_dir):
    """Means of each period after an event by group; every group has every period, empty ones too."""
    means = E.window_means(_deltas(spark, sf_dir), ["unit"], "k", "delta", _LABELS)
    rows = means.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.col(n).alias("v")) for n, _, _ in _LABELS)))).select((F.col("unit") % 2).alias("grp"), (F.col("unit") % 7).alias("cluster"), "_p.*")
    return rows.groupBy("grp", "period").agg(F.count("v").alias("episodes"), F.count_distinct(F.when(F.col("v").isNotNull(), F.col("cluster"))).alias("clusters"), r6(F.avg("v"), "mean"))


_FIT = "CASE WHEN year(day) <= 1998 THEN x END"


@query("causal_and_interpolated", f"""WITH {DENSE}, s AS (SELECT cell, day, CASE WHEN dayofmonth(day) NOT IN (5, 11, 12, 20, 21, 22) THEN x END AS x, CAST(least(floor((dayofyear(day) - 1) / 8), 45) AS INTEGER) AS slot FROM dense),
    z AS (SELECT cell, day, CASE WHEN stddev_samp({_FIT}) OVER w > 0 THEN (x - avg({_FIT}) OVER w) / stddev_samp({_FIT}) OVER w END AS z, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM s WINDOW w AS (PARTITION BY cell, slot)),
    k AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN i END IGNORE NULLS) OVER b AS bi, last_value(z IGNORE NULLS) OVER b AS bz, first_value(CASE WHEN z IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ai, first_value(z IGNORE NULLS) OVER a AS az, last_value(z IGNORE NULLS) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM z
      WINDOW b AS (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cell ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT cell, day, round(z, 6) + 0.0 AS target, round(coalesce(held, 0.0), 6) + 0.0 AS causal, round(coalesce(z, CASE WHEN ai - bi - 1 <= 2 THEN bz + (az - bz) * (i - bi) / (ai - bi) END, 0.0), 6) + 0.0 AS interpolated FROM k""")
def causal_and_interpolated(spark, sf_dir):
    """Scores against the fitted years' slots as a target, with gaps filled by what was known, and by a line."""
    gaps = dense(spark, sf_dir).withColumn("x", F.when(~F.dayofmonth("day").isin(5, 11, 12, 20, 21, 22), F.col("x"))).withColumn("slot", calendar.slot(F.col("day")))
    z = S.slot_scores(gaps, CELL, "slot", "x", "z", F.year("day") <= 1998)
    rows = S.fill_short_gaps(z, CELL, "day", "z", 2, 0.0, "interpolated")
    return rows.select("cell", "day", r6("z", "target"), r6(S.fill_forward(F.col("z"), CELL, "day", 2, 0.0), "causal"), r6("interpolated", "interpolated"))


@query("shared_year_orders", """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders), d AS (SELECT CAST(draw AS INTEGER) AS draw, yr, md5('orders|' || draw || '|' || yr) AS h FROM y CROSS JOIN (SELECT unnest(range(39)) AS draw))
    SELECT draw, yr, coalesce(lead(yr) OVER (PARTITION BY draw ORDER BY h, yr), first_value(yr) OVER (PARTITION BY draw ORDER BY h, yr)) AS donor FROM d""")
def shared_year_orders(spark, sf_dir):
    """Orders of the years that all cells share, none of which keeps a year in its place: each year takes the next in an order by hash."""
    years = read(spark, sf_dir, "orders", ["o_orderdate"]).select(F.year("o_orderdate").alias("yr")).distinct()
    d = years.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(38))))
    w = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.lit("orders"), F.col("draw").cast("string"), F.col("yr").cast("string"))), "yr")
    return d.select("draw", "yr", F.coalesce(F.lead("yr").over(w), F.first("yr").over(w)).alias("donor"))


@query("rates_of_selected_tests", """WITH t AS (SELECT l_returnflag AS variable, l_linenumber AS descriptor, l_suppkey AS cell, avg(l_discount) AS p FROM lineitem GROUP BY 1, 2, 3),
    u AS (SELECT 'cells' AS kind, variable, p FROM t WHERE descriptor <= CASE variable WHEN 'R' THEN 2 ELSE 4 END UNION ALL SELECT 'null', variable, p FROM t WHERE descriptor = 5)
    SELECT kind, variable, count(*) AS tests, round(avg(CASE WHEN round(p, 9) <= 0.045 THEN 1.0 ELSE 0 END), 6) + 0.0 AS rate FROM u GROUP BY 1, 2""")
def rates_of_selected_tests(spark, sf_dir):
    """Rejection rates of selections that differ by variable, observed and null ones under a tag."""
    t = read(spark, sf_dir, "lineitem", ["l_returnflag", "l_linenumber", "l_suppkey", "l_discount"]).groupBy(F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("descriptor"), F.col("l_suppkey").alias("cell")).agg(F.avg("l_discount").alias("p"))
    # one pass: a test's tags are an array
    seen = F.when(F.col("descriptor") <= F.when(F.col("variable") == "R", 2).otherwise(4), F.lit("cells"))
    u = t.withColumn("kind", F.explode(F.array_compact(F.array(seen, F.when(F.col("descriptor") == 5, F.lit("null"))))))
    return u.groupBy("kind", "variable").agg(F.count(F.lit(1)).alias("tests"), r6(F.avg(F.when(F.round("p", 9) <= 0.045, 1.0).otherwise(0.0)), "rate"))


_LAGS = " + ".join(f"{1 - i / 15!r} * coalesce(lag(s, {i}) OVER w, 0.0)" for i in range(1, 15))


@query("stationarity_blocks", f"""WITH {DENSE}, t AS (SELECT cell, day, coalesce(x, 0.0) AS x, (row_number() OVER (PARTITION BY cell ORDER BY day) - 1) / CAST(count(*) OVER (PARTITION BY cell) - 1 AS DOUBLE) AS t, ntile(4) OVER (PARTITION BY cell ORDER BY day) AS block FROM dense),
    f AS (SELECT cell, count(*) AS n, regr_slope(x, t) AS b, avg(x) AS mx, avg(t) AS mt, regr_sxx(x, t) AS tt, stddev_pop(x) AS sd, sum(pow(x - m, 2)) AS sq FROM (SELECT *, avg(x) OVER (PARTITION BY cell) AS m FROM t) GROUP BY 1),
    u AS (SELECT t.cell, day, (t - mt) * (x - mx - b * (t - mt)) AS s, sum(x - mx) OVER (PARTITION BY t.cell ORDER BY day ROWS UNBOUNDED PRECEDING) AS cs FROM t JOIN f ON f.cell = t.cell),
    l AS (SELECT cell, s, cs, {_LAGS} AS g FROM u WINDOW w AS (PARTITION BY cell ORDER BY day)), h AS (SELECT f.cell, any_value(n) AS n, any_value(b) AS change, any_value(b) / (sqrt(sum(s * (s + 2 * g))) / any_value(tt)) AS z, max(abs(cs)) / sqrt(any_value(sq) * any_value(n) / (any_value(n) - 1)) AS shift, any_value(sd) AS sd FROM l JOIN f ON f.cell = l.cell GROUP BY 1),
    e AS (SELECT cell, block, x, x - avg(x) OVER (PARTITION BY cell, block) AS e, day FROM t), e1 AS (SELECT *, lag(e) OVER (PARTITION BY cell, block ORDER BY day) AS e1 FROM e), k AS (SELECT cell, block, avg(x) AS m, stddev_pop(x) AS sd, sum(e * e1) / sum(e * e) AS r FROM e1 GROUP BY 1, 2),
    q AS (SELECT cell, max(sd) / min(sd) AS ratio, max(m) - min(m) AS mr, max(r) - min(r) AS ar FROM k GROUP BY 1), o AS (SELECT h.cell, n, change, {M.two_sided_normal_sql('z')} AS change_p, {G.kolmogorov_sql('shift')} AS shift_p, ratio, mr / sd AS mr, ar FROM h JOIN q ON q.cell = h.cell)
    SELECT cell, n, round(change, 5) + 0.0 AS change, round(change_p, 5) + 0.0 AS change_p, round(shift_p, 5) + 0.0 AS shift_p, round(ratio, 5) + 0.0 AS deviation_ratio, round(mr, 5) + 0.0 AS mean_range, round(ar, 5) + 0.0 AS acf_range,
    CAST(CAST(change_p < 0.05 AS INTEGER) + CAST(ratio > 1.5 AS INTEGER) + CAST(mr > 0.5 AS INTEGER) + CAST(ar > 0.25 AS INTEGER) AS INTEGER) AS alerts FROM o""")
def stationarity_blocks(spark, sf_dir):
    """Trend under autocorrelated errors, shift of the mean and differences of blocks of each cell's series: the part of the stationarity diagnostics that stationarity_cells lacks."""
    out = G.block_diagnostics(totals(spark, sf_dir), CELL, "day", "x")
    return out.select("cell", "n", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("change", "change_p", "shift_p", "deviation_ratio", "mean_range", "acf_range")), "alerts")


@query("smap_by_horizon")
def smap_by_horizon(spark, sf_dir):
    """Locally weighted linear forecasts of standardised anomalies 1, 3 and 7 days on against the linear map, staying and the seasonal normal, p adjusted over the cells of a horizon."""
    z = S.mean_square_anomaly(totals(spark, sf_dir), CELL, F.lit(True), "x", 15).select("cell", "day", "z")
    gains = P.horizon_gains(P.forecast_errors(z, CELL, "day", "z", 3, 1, 7), CELL)
    return I.adjusted(gains, ["horizon"], "p").drop("holm").withColumnRenamed("bh", "q")
