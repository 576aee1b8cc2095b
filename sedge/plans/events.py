"""Case-crossover, before/after/control/impact, curves by event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.operators import events as E
from sedge.operators import series as S
from sedge.plans.base import CELL, DENSE, daily, dense, r6
from sedge.plans.registry import query
from sedge.sources.tables import read

_EVENTS = f"""{DENSE}, pre AS (SELECT cell, day, x, CASE WHEN count(*) OVER w = 5 THEN sum(CASE WHEN x > 150 THEN 1 ELSE 0 END) OVER w END AS before FROM dense WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    events_ AS (SELECT cell, day, x FROM pre WHERE x > 150 AND before = 0)"""


def _starts(spark, sf_dir):
    rows = dense(spark, sf_dir)
    return rows.where(F.lit(True)).withColumn("start", S.episode_starts(F.col("x") > 150, CELL, "day", 5)).where("start").select("cell", "day", "x")


@query("case_crossover_percentile", f"""WITH {_EVENTS},
    m AS (SELECT e.cell, e.day, e.x, CASE WHEN month(e.day) = 2 AND dayofmonth(e.day) = 29 AND NOT (y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0)) THEN make_date(y, 2, 28) ELSE make_date(y, month(e.day), dayofmonth(e.day)) END AS mid
      FROM events_ e CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001)) v(y) WHERE y <> year(e.day)),
    c AS (SELECT m.cell, m.day, m.x, d.x AS control FROM m CROSS JOIN (SELECT unnest(range(-15, 16)) AS o) r LEFT JOIN dense d ON d.cell = m.cell AND d.day = m.mid + CAST(r.o AS INTEGER))
    SELECT cell, day, count(control) AS controls, round(avg(control), 6) + 0.0 AS control_mean, round(CASE WHEN count(control) > 0 THEN sum(CASE WHEN control < x THEN 1.0 WHEN control = x THEN 0.5 WHEN control IS NOT NULL THEN 0.0 END) / count(control) END, 6) + 0.0 AS percentile FROM c GROUP BY 1, 2""")
def case_crossover_percentile(spark, sf_dir):
    """Each event's value among those within 15 days of the same date in other years."""
    rows = dense(spark, sf_dir)
    cases = E.matched_dates(_starts(spark, sf_dir), "day", range(1995, 2002), 15)
    joined = cases.join(rows.select("cell", F.col("day").alias("control_day"), F.col("x").alias("control")), ["cell", "control_day"], "left")
    out = E.mid_rank(joined, ["cell", "day"], F.col("x"), F.col("control"))
    return out.select("cell", "day", "controls", r6("control_mean", "control_mean"), r6("percentile", "percentile"))


# A panel by event time: suppliers, months before and after each one's first large shipment, against its nation.
_PANEL = """m AS (SELECT l_suppkey AS unit, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2),
    e AS (SELECT l_suppkey AS unit, CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS start FROM lineitem WHERE l_shipdate >= (SELECT date_trunc('month', min(l_shipdate)) FROM lineitem) + INTERVAL 24 MONTH AND l_quantity >= 50 GROUP BY 1),
    p AS (SELECT m.unit, m.month, s.s_nationkey AS nation, CAST((year(m.month) - year(e.start)) * 12 + month(m.month) - month(e.start) AS INTEGER) AS k, m.x FROM m JOIN e ON e.unit = m.unit JOIN supplier s ON s.s_suppkey = m.unit),
    c AS (SELECT m.month, s.s_nationkey AS nation, sum(m.x) AS sx, count(*) AS nx FROM m JOIN supplier s ON s.s_suppkey = m.unit GROUP BY 1, 2),
    panel AS (SELECT p.unit, p.month, p.k, p.x, CASE WHEN c.nx > 1 THEN (c.sx - p.x) / (c.nx - 1) END AS control FROM p JOIN c ON c.month = p.month AND c.nation = p.nation WHERE p.k BETWEEN -24 AND 36)"""


def _panel(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    month = F.trunc("l_shipdate", "MM").cast("date")
    m = items.groupBy(F.col("l_suppkey").alias("unit"), month.alias("month")).agg(F.avg("l_quantity").alias("x"))
    # an event needs the 24 months before it
    first = items.agg(F.add_months(F.trunc(F.min("l_shipdate"), "MM"), 24).alias("first"))
    e = items.crossJoin(F.broadcast(first)).where("l_shipdate >= first and l_quantity >= 50").groupBy(F.col("l_suppkey").alias("unit")).agg(F.trunc(F.min("l_shipdate"), "MM").cast("date").alias("start"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("nation"))
    rows = m.join(s, "unit")
    c = rows.groupBy("month", "nation").agg(F.sum("x").alias("sx"), F.count("x").alias("nx"))
    k = ((F.year("month") - F.year("start")) * 12 + F.month("month") - F.month("start")).alias("k")
    p = rows.join(e, "unit").select("unit", "month", "nation", k, "x").where("k between -24 and 36").join(c, ["month", "nation"])
    return p.select("unit", "month", "k", "x", F.when(F.col("nx") > 1, (F.col("sx") - F.col("x")) / (F.col("nx") - 1)).alias("control"))


_DELTA = _PANEL + """, d AS (SELECT unit, month, k, (x - avg(CASE WHEN k BETWEEN -12 AND -1 THEN x END) OVER w) - (control - avg(CASE WHEN k BETWEEN -12 AND -1 THEN control END) OVER w) AS delta FROM panel WINDOW w AS (PARTITION BY unit)),
    dd AS (SELECT * FROM d WHERE k <> 0)"""


def _deltas(spark, sf_dir):
    return E.deltas(_panel(spark, sf_dir), ["unit"], "k", "x", "control", 12)


@query("baci_delta", f"WITH {_DELTA} SELECT unit, k, round(delta, 6) + 0.0 AS delta FROM dd")
def baci_delta(spark, sf_dir):
    """Change against the year before, less the same change of the controls."""
    return _deltas(spark, sf_dir).select("unit", "k", r6("delta", "delta"))


@query("baci_curve", f"WITH {_DELTA} SELECT k, count(delta) AS units, round(avg(delta), 6) + 0.0 AS mean, round(stddev_samp(delta) / sqrt(count(delta)), 6) + 0.0 AS error FROM dd GROUP BY 1")
def baci_curve(spark, sf_dir):
    """Mean curve by event time with its standard error."""
    return _deltas(spark, sf_dir).groupBy("k").agg(F.count("delta").alias("units"), r6(F.avg("delta"), "mean"), r6(F.stddev_samp("delta") / F.sqrt(F.count("delta")), "error"))


@query("recovery_time", f"""WITH {_DELTA}, f AS (SELECT unit, k, delta >= -2 AS ok FROM dd WHERE k > 0), h AS (SELECT unit, k, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w = 3 AND count(*) OVER w = 3 AS held FROM f WINDOW w AS (PARTITION BY unit ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT unit, min(CASE WHEN held THEN k END) AS recovery FROM h GROUP BY 1""")
def recovery_time(spark, sf_dir):
    """The first step from which a curve stays near its baseline."""
    return E.first_lasting(_deltas(spark, sf_dir).where("k > 0"), ["unit"], "k", F.col("delta") >= -2, 3)


@query("baseline_change", f"""WITH {_PANEL} SELECT unit, month, k, round(x - avg(CASE WHEN k BETWEEN -24 AND -1 THEN x END) OVER (PARTITION BY unit), 6) + 0.0 AS change,
    round(x - avg(CASE WHEN k BETWEEN -24 AND -1 THEN x END) OVER (PARTITION BY unit, month(month)), 6) + 0.0 AS seasonal_change FROM panel""")
def baseline_change(spark, sf_dir):
    """Change against the mean before, and against the same calendar month before."""
    out = E.against_baseline(_panel(spark, sf_dir), ["unit"], "k", "month", "x", 24)
    return out.select("unit", "month", "k", r6("change", "change"), r6("seasonal_change", "seasonal_change"))


@query("memory_metrics", f"""WITH {_DELTA} SELECT unit,
    round(CASE WHEN count(CASE WHEN k BETWEEN 1 AND 36 THEN delta END) >= 0.3 * 36 THEN sum(CASE WHEN k BETWEEN 1 AND 36 THEN greatest(-delta, 0.0) END) / 12 END, 6) + 0.0 AS deficit,
    round(CASE WHEN count(CASE WHEN k BETWEEN 1 AND 36 THEN delta END) >= 0.3 * 36 THEN -sum(CASE WHEN k BETWEEN 1 AND 36 THEN delta END) / 12 END, 6) + 0.0 AS net_deficit,
    round(CASE WHEN count(CASE WHEN k BETWEEN 1 AND 12 THEN delta END) >= 0.3 * 12 THEN sum(CASE WHEN k BETWEEN 1 AND 12 THEN greatest(-delta, 0.0) END) / 12 END, 6) + 0.0 AS first_deficit,
    round(CASE WHEN count(CASE WHEN k BETWEEN 13 AND 36 THEN delta END) >= 0.3 * 24 THEN avg(CASE WHEN k BETWEEN 13 AND 36 THEN delta END) END, 6) + 0.0 AS residual FROM dd WHERE delta IS NOT NULL GROUP BY 1""")
def memory_metrics(spark, sf_dir):
    """Accumulated deficit and what remains of an event."""
    out = E.memory(_deltas(spark, sf_dir).where("delta is not null"), ["unit"], "k", "delta", 12, 36, 1 / 12)
    return out.select("unit", *(r6(c, c) for c in ("deficit", "net_deficit", "first_deficit", "residual")))


_WINDOWS = [("before", -12, -1), ("early", 1, 6), ("first", 7, 12), ("late", 13, 36)]


@query("window_means_fixed_cohort", f"WITH {_DELTA}, g AS (SELECT unit, " + ", ".join(f"CASE WHEN count(CASE WHEN k BETWEEN {a} AND {b} THEN delta END) >= {0.5 * (b - a + 1)} THEN avg(CASE WHEN k BETWEEN {a} AND {b} THEN delta END) END AS {n}" for n, a, b in _WINDOWS) + " FROM dd GROUP BY 1) SELECT unit, " + ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n, _, _ in _WINDOWS) + ", " + " AND ".join(f"{n} IS NOT NULL" for n, _, _ in _WINDOWS) + " AS fixed FROM g")
def window_means_fixed_cohort(spark, sf_dir):
    """Window means of every unit and whether it is in the fixed cohort."""
    out = E.window_means(_deltas(spark, sf_dir), ["unit"], "k", "delta", _WINDOWS)
    return out.select("unit", *(r6(n, n) for n, _, _ in _WINDOWS), "fixed")


@query("lead_transitions", f"""WITH {_PANEL}, t AS (SELECT unit, k, x, lead(k) OVER w AS nk, lead(x) OVER w AS nx FROM panel WINDOW w AS (PARTITION BY unit ORDER BY k)) SELECT unit, k, round(x, 6) + 0.0 AS x, round(nx, 6) + 0.0 AS next_x FROM t WHERE nk = k + 1 AND sign(k) = sign(nk)""")
def lead_transitions(spark, sf_dir):
    """Next states that neither skip a step nor cross the event."""
    return E.transitions(_panel(spark, sf_dir), ["unit"], "k", "x").select("unit", "k", r6("x", "x"), r6("next_x", "next_x"))


@query("lookback_interval_mean", f"""WITH {DENSE}, ev AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'R' WHEN o_orderstatus = 'O' THEN 'N' ELSE 'A' END AS cell, CAST(o_orderdate AS DATE) AS at FROM orders WHERE o_totalprice > 300000)
    SELECT e.o_orderkey, round(avg(d.x), 6) + 0.0 AS before_mean, count(d.x) AS before_n FROM ev e JOIN daily d ON d.cell = e.cell AND d.day < e.at AND d.day >= e.at - 60 GROUP BY 1""")
def lookback_interval_mean(spark, sf_dir):
    """Mean of the sixty days before each event, as an equality join on blocks."""
    status = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    ev = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", status.alias("cell"), F.to_date("o_orderdate").alias("at"))
    out = E.lookback_mean(ev, daily(spark, sf_dir), CELL, "at", "day", "x", 60, ["o_orderkey"])
    return out.select("o_orderkey", r6("before_mean", "before_mean"), "before_n")


@query("nearest_controls", """WITH a AS (SELECT s_suppkey, s_nationkey, s_acctbal, avg(l_quantity) AS q FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
    z AS (SELECT s_suppkey, s_nationkey % 5 AS zone, s_suppkey % 7 = 0 AS treated, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z1, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS z2 FROM a),
    d AS (SELECT t.s_suppkey AS unit, c.s_suppkey AS control, row_number() OVER (PARTITION BY t.s_suppkey ORDER BY round(sqrt(pow(t.z1 - c.z1, 2) + pow(t.z2 - c.z2, 2)), 9), c.s_suppkey) AS place, round(sqrt(pow(t.z1 - c.z1, 2) + pow(t.z2 - c.z2, 2)), 6) + 0.0 AS distance FROM z t JOIN z c ON c.zone = t.zone AND t.treated AND NOT c.treated)
    SELECT unit, control, CAST(place AS INTEGER) AS place, distance FROM d WHERE place <= 3""")
def nearest_controls(spark, sf_dir):
    """The three nearest untreated units of the same zone in standardised covariates."""
    q = read(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity"]).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q"))
    a = read(spark, sf_dir, "supplier").join(q, "s_suppkey")
    stats = a.agg(*(f(c).alias(f"{n}_{c}") for c in ("s_acctbal", "q") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = a.crossJoin(F.broadcast(stats)).select("s_suppkey", (F.col("s_nationkey") % 5).alias("zone"), (F.col("s_suppkey") % 7 == 0).alias("treated"), ((F.col("s_acctbal") - F.col("m_s_acctbal")) / F.col("s_s_acctbal")).alias("z1"), ((F.col("q") - F.col("m_q")) / F.col("s_q")).alias("z2"))
    near = E.nearest(z.where("treated"), z.where("not treated"), "zone", "s_suppkey", ["z1", "z2"], 3)
    return near.select("unit", "control", "place", r6("d", "distance"))
