"""Daily series, climatologies, anomalies, rolling conditions, episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions import bits, calendar
from sedge.functions import meteorology as met
from sedge.functions.numbers import block_key, coverage, right_closed, seed_of
from sedge.operators import series as S
from sedge.plans.base import CELL, DAILY, DENSE, daily, dense, r6, smooth_sql
from sedge.plans.registry import query
from sedge.sources.tables import read



def _base():
    return F.year("day") <= 1998

_NORMAL = f"""WITH {DENSE}, base AS (SELECT cell, dayofyear(day) AS doy, avg(x) AS v FROM dense WHERE year(day) <= 1998 GROUP BY 1, 2),
    {smooth_sql('base', 'clim', 15, 'v')},
    anom AS (SELECT d.cell, d.day, dayofyear(d.day) AS doy, d.x, d.x - c.v AS anomaly FROM dense d LEFT JOIN clim c ON c.cell = d.cell AND c.doy = dayofyear(d.day)),
    sq AS (SELECT cell, doy, avg(anomaly * anomaly) AS v FROM anom WHERE year(day) <= 1998 GROUP BY 1, 2),
    {smooth_sql('sq', 'var', 15, 'v')},
    z AS (SELECT a.cell, a.day, a.x, a.anomaly, CASE WHEN v.v > 0 THEN a.anomaly / sqrt(v.v) END AS z FROM anom a LEFT JOIN var v ON v.cell = a.cell AND v.doy = a.doy)"""


@query("seasonal_anomaly", _NORMAL + " SELECT cell, day, round(anomaly, 6) + 0.0 AS anomaly, round(z, 6) + 0.0 AS z FROM z")
def seasonal_anomaly(spark, sf_dir):
    """Daily anomaly and standardised anomaly against a smoothed day-of-year normal."""
    out = S.mean_square_anomaly(dense(spark, sf_dir), CELL, _base(), "x", 15)
    return out.select("cell", "day", r6("anomaly", "anomaly"), r6("z", "z"))


@query("monthly_anomaly_summary", _NORMAL + " SELECT cell, date_trunc('month', day)::DATE AS month, count(z) AS n, round(avg(z), 6) + 0.0 AS z_mean, round(stddev_samp(z), 6) + 0.0 AS z_sd FROM z GROUP BY 1, 2")
def monthly_anomaly_summary(spark, sf_dir):
    """Monthly summary of the standardised anomaly."""
    out = S.mean_square_anomaly(dense(spark, sf_dir), CELL, _base(), "x", 15)
    return out.groupBy("cell", calendar.month_start(F.col("day")).alias("month")).agg(F.count("z").alias("n"), r6(F.avg("z"), "z_mean"), r6(F.stddev_samp("z"), "z_sd"))


@query("daily_series_spine", f"WITH {DENSE} SELECT cell, day, x FROM dense")
def daily_series_spine(spark, sf_dir):
    """Totals on a dense grid of cells and days."""
    return dense(spark, sf_dir)


@query("local_day_completeness", """SELECT event_type AS cell, CAST(ts - INTERVAL 3 HOUR AS DATE) AS day, count(DISTINCT date_trunc('hour', ts)) AS hours,
    CASE WHEN count(DISTINCT date_trunc('hour', ts)) >= 20 THEN round(avg(value), 6) + 0.0 END AS x_mean, CASE WHEN count(DISTINCT date_trunc('hour', ts)) >= 20 THEN round(max(value), 6) + 0.0 END AS x_max
    FROM events GROUP BY 1, 2""")
def local_day_completeness(spark, sf_dir):
    """Local days at UTC-3; a day with too few hours has no statistic, never a partial one."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), calendar.local_day(F.col("ts"), -3).alias("day"), F.date_trunc("hour", "ts").alias("hour"), "value")
    g = rows.groupBy("cell", "day").agg(F.countDistinct("hour").alias("hours"), F.avg("value").alias("m"), F.max("value").alias("h"))
    whole = F.col("hours") >= 20
    return g.select("cell", "day", "hours", F.when(whole, r6("m", "m")).alias("x_mean"), F.when(whole, r6("h", "h")).alias("x_max"))


@query("complete_day_statistics", f"WITH {DAILY} SELECT cell, date_trunc('month', day)::DATE AS day, count(x) AS n, CASE WHEN count(x) >= 28 THEN round(avg(x), 6) + 0.0 END AS x_mean, CASE WHEN count(x) >= 28 THEN min(x) END AS x_min, CASE WHEN count(x) >= 28 THEN max(x) END AS x_max, CASE WHEN count(x) >= 28 THEN sum(x) END AS x_sum FROM daily GROUP BY 1, 2")
def complete_day_statistics(spark, sf_dir):
    """Statistics of periods that are complete enough, here months of 28 days."""
    out = S.complete_totals(daily(spark, sf_dir), CELL, calendar.month_start(F.col("day")), "x", 28)
    return out.select("cell", "day", "n", r6("x_mean", "x_mean"), "x_min", "x_max", "x_sum")


@query("rolling_lagged_conditions", f"""WITH {DENSE} SELECT cell, day,
    CASE WHEN count(x) OVER w7 = 7 THEN round(avg(x) OVER w7, 6) + 0.0 END AS mean_7, CASE WHEN count(x) OVER w30 = 30 THEN round(sum(x) OVER w30, 6) + 0.0 END AS sum_30,
    CASE WHEN count(x) OVER w8 >= 6 THEN round(avg(x) OVER w8, 6) + 0.0 END AS mean_8, CASE WHEN count(x) OVER c15 = 31 THEN round(sum(x) OVER c15, 6) + 0.0 END AS centred_31 FROM dense
    WINDOW w7 AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w30 AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
    w8 AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), c15 AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""")
def rolling_lagged_conditions(spark, sf_dir):
    """Rolling means and sums, lagged by a day, with their own rules for missing days."""
    x = F.col("x")
    return dense(spark, sf_dir).select("cell", "day", r6(S.rolling(x, CELL, "day", -7, -1), "mean_7"), r6(S.rolling(x, CELL, "day", -30, -1, "sum"), "sum_30"), r6(S.rolling(x, CELL, "day", -7, 0, least=6), "mean_8"), r6(S.rolling(x, CELL, "day", -15, 15, "sum"), "centred_31"))


_RUNS = f"""WITH {DENSE}, r AS (SELECT cell, day, x, coalesce(x < 80, false) AS dry, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM dense),
    o AS (SELECT *, coalesce(max(CASE WHEN NOT dry THEN i END) OVER (PARTITION BY cell ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS off FROM r)"""


@query("dry_spell_length", _RUNS + " SELECT cell, day, CAST(CASE WHEN dry THEN i - off ELSE 0 END AS BIGINT) AS dry_days FROM o")
def dry_spell_length(spark, sf_dir):
    """Days in a row under a threshold up to each day; a missing day ends the run."""
    out = S.with_run_length(dense(spark, sf_dir), F.col("x") < 80, CELL, "day", "dry_days")
    return out.select("cell", "day", "dry_days")


@query("annual_extremes_longest_run", _RUNS + " SELECT cell, CAST(year(day) AS INTEGER) AS year, max(x) AS x_max, count(x) AS days, count(*) FILTER (WHERE x >= 200) AS heavy_days, CAST(max(CASE WHEN dry THEN i - off ELSE 0 END) AS BIGINT) AS longest_dry FROM o GROUP BY 1, 2")
def annual_extremes_longest_run(spark, sf_dir):
    """Extremes of the year and the longest run that ends in it."""
    out = S.with_run_length(dense(spark, sf_dir), F.col("x") < 80, CELL, "day", "dry_days")
    return out.groupBy("cell", F.year("day").alias("year")).agg(F.max("x").alias("x_max"), F.count("x").alias("days"), F.count(F.when(F.col("x") >= 200, 1)).alias("heavy_days"), F.max("dry_days").alias("longest_dry"))


@query("episode_starts_quiet_gap", f"""WITH {DENSE}, e AS (SELECT cell, day, x, CASE WHEN count(*) OVER w = 5 THEN sum(CASE WHEN x > 150 THEN 1 ELSE 0 END) OVER w END AS before FROM dense WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT cell, day, x FROM e WHERE x > 150 AND before = 0""")
def episode_starts_quiet_gap(spark, sf_dir):
    """Events after a quiet time that is fully on record."""
    rows = dense(spark, sf_dir)
    return rows.withColumn("start", S.episode_starts(F.col("x") > 150, CELL, "day", 5)).where("start").select("cell", "day", "x")


@query("slot_standardisation", f"""WITH {DENSE}, s AS (SELECT cell, day, x, CAST(least(floor((dayofyear(day) - 1) / 8), 45) AS INTEGER) AS slot FROM dense)
    SELECT cell, day, slot, round(CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 6) + 0.0 AS z,
    round(CASE WHEN stddev_samp(CASE WHEN year(day) <= 1998 THEN x END) OVER w > 0 THEN (x - avg(CASE WHEN year(day) <= 1998 THEN x END) OVER w) / stddev_samp(CASE WHEN year(day) <= 1998 THEN x END) OVER w END, 6) + 0.0 AS z_fit
    FROM s WINDOW w AS (PARTITION BY cell, slot)""")
def slot_standardisation(spark, sf_dir):
    """Scores against the slot of the year, of all rows and of the fitted years only."""
    rows = dense(spark, sf_dir).withColumn("slot", calendar.slot(F.col("day")))
    rows = S.slot_scores(rows, CELL, "slot", "x", "z")
    rows = S.slot_scores(rows, CELL, "slot", "x", "z_fit", F.year("day") <= 1998)
    return rows.select("cell", "day", "slot", r6("z", "z"), r6("z_fit", "z_fit"))


@query("gap_refill", f"""WITH {DENSE}, g AS (SELECT cell, day, CASE WHEN dayofmonth(day) IN (5, 11, 12, 20, 21, 22) THEN NULL ELSE x END AS x, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM dense),
    k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS bi, last_value(x IGNORE NULLS) OVER b AS bx, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ai, first_value(x IGNORE NULLS) OVER a AS ax FROM g
      WINDOW b AS (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY cell ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT cell, day, round(coalesce(x, CASE WHEN ai - bi - 1 <= 2 THEN bx + (ax - bx) * (i - bi) / (ai - bi) END, 0.0), 6) + 0.0 AS filled,
      round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0.0), 6) + 0.0 AS causal FROM k""")
def gap_refill(spark, sf_dir):
    """Short gaps in a line, long ones a constant; and what was known at the time."""
    gaps = dense(spark, sf_dir).withColumn("x", F.when(~F.dayofmonth("day").isin(5, 11, 12, 20, 21, 22), F.col("x")))
    rows = S.fill_short_gaps(gaps, CELL, "day", "x", 2, 0.0, "filled")
    return rows.select("cell", "day", r6("filled", "filled"), r6(S.fill_forward(F.col("x"), CELL, "day", 2, 0.0), "causal"))


@query("ews_rolling_variance_ar1", f"""WITH {DENSE}, p AS (SELECT cell, day, x, lag(x) OVER (PARTITION BY cell ORDER BY day) AS y FROM dense), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
    SELECT cell, day, CASE WHEN count(x) OVER w = 60 THEN round(var_samp(x) OVER w, 6) + 0.0 END AS variance, CASE WHEN count(x) OVER w = 60 THEN round(corr(x, y) OVER w, 6) + 0.0 END AS ar1
    FROM q WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def ews_rolling_variance_ar1(spark, sf_dir):
    """Rolling variance and lag-one autocorrelation over finite pairs."""
    w = Window.partitionBy("cell").orderBy("day")
    rows = dense(spark, sf_dir).withColumn("y", F.lag("x").over(w)).where("x is not null and y is not null")
    back = w.rowsBetween(-59, 0)
    full = F.count("x").over(back) == 60
    return rows.select("cell", "day", F.when(full, r6(F.var_samp("x").over(back), "v")).alias("variance"), F.when(full, r6(F.corr("x", "y").over(back), "c")).alias("ar1"))


@query("linear_detrend", f"""WITH {DENSE}, t AS (SELECT cell, day, x, CAST(date_diff('day', DATE '1995-01-01', day) AS DOUBLE) AS t FROM dense WHERE x IS NOT NULL),
    f AS (SELECT cell, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM t GROUP BY 1) SELECT t.cell, t.day, round(x - a - b * t.t, 5) + 0.0 AS residual FROM t JOIN f ON f.cell = t.cell""")
def linear_detrend(spark, sf_dir):
    """What a line through each cell's series leaves."""
    t = dense(spark, sf_dir).where("x is not null").withColumn("t", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double"))
    f = t.groupBy("cell").agg(F.regr_slope("x", "t").alias("b"), F.regr_intercept("x", "t").alias("a"))
    return t.join(F.broadcast(f), "cell").select("cell", "day", (F.round(F.col("x") - F.col("a") - F.col("b") * F.col("t"), 5) + F.lit(0.0)).alias("residual"))


@query("mean_of_next_steps", f"""WITH {DENSE} SELECT cell, day, CASE WHEN count(x) OVER w >= 2 THEN round(avg(x) OVER w, 6) + 0.0 END AS target, lead(x, 4) OVER (PARTITION BY cell ORDER BY day) AS step_4, sum(coalesce(x, 0)) OVER (PARTITION BY cell ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
    FROM dense WINDOW w AS (PARTITION BY cell ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def mean_of_next_steps(spark, sf_dir):
    """Forecast targets (mean of the next steps, the h-th step) and running totals."""
    w = Window.partitionBy("cell").orderBy("day")
    return dense(spark, sf_dir).select("cell", "day", r6(S.mean_of_next(F.col("x"), CELL, "day", 4), "target"), F.lead("x", 4).over(w).alias("step_4"), F.sum(F.coalesce("x", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@query("percent_rank_by_month", f"""WITH {DAILY} SELECT cell, day, round((rank() OVER (PARTITION BY cell, month(day) ORDER BY x) + (count(*) OVER (PARTITION BY cell, month(day), x) - 1) / 2.0) / count(*) OVER (PARTITION BY cell, month(day)), 6) + 0.0 AS rank FROM daily""")
def percent_rank_by_month(spark, sf_dir):
    """Average percent rank within cell and calendar month."""
    rows = daily(spark, sf_dir).withColumn("m", F.month("day"))
    return rows.select("cell", "day", r6(S.percent_rank_average(F.col("x"), "cell", "m"), "rank"))


@query("decaying_trail", f"""WITH {DENSE}, n AS (SELECT cell, day, greatest(coalesce(x, 0), 0.0) AS x, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM dense)
    SELECT a.cell, a.day, round(max(b.x * pow(0.45, a.i - b.i)) + 1e-9, 5) AS trail FROM n a JOIN n b ON b.cell = a.cell AND b.i BETWEEN a.i - 60 AND a.i GROUP BY 1, 2""")
def decaying_trail(spark, sf_dir):
    """The greatest of what is left of all values before. The twin looks 60 days back: after that less than 1e-20 of a value is left."""
    rows = dense(spark, sf_dir).withColumn("x", F.coalesce("x", F.lit(0.0)))
    out = S.decayed_maximum(rows, CELL, "day", "x", 0.45, "b")
    return out.select("cell", "day", F.round(F.col("b") + 1e-9, 5).alias("trail"))


@query("lag_embedding", f"WITH {DENSE}, e AS (SELECT cell, day, x AS e0, lead(x, 7) OVER w AS e1, lead(x, 14) OVER w AS e2 FROM dense WINDOW w AS (PARTITION BY cell ORDER BY day)) SELECT * FROM e WHERE e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL")
def lag_embedding(spark, sf_dir):
    """Delay vectors."""
    return S.lag_embedding(dense(spark, sf_dir), CELL, "day", "x", 3, 7).select("cell", "day", "e0", "e1", "e2")


@query("year_block_permutation", f"""WITH {DENSE}, s AS (SELECT cell, CAST(year(day) AS INTEGER) AS year, CAST(dayofyear(day) AS INTEGER) AS doy, x FROM dense),
    o AS (SELECT year, row_number() OVER (ORDER BY md5('years|' || year), year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM s)), m AS (SELECT a.year, b.year AS donor FROM o a JOIN o b ON b.i = a.i % a.n + 1)
    SELECT a.cell, a.year, a.doy, b.x AS moved, a.x AS kept FROM s a JOIN m ON m.year = a.year LEFT JOIN s b ON b.cell = a.cell AND b.year = m.donor AND b.doy = a.doy""")
def year_block_permutation(spark, sf_dir):
    """Whole years of one column from other years, none in its place: the years that there are, in the order of a hash, each from the next. A day that the donor lacks is null."""
    s = dense(spark, sf_dir).select("cell", F.year("day").alias("year"), F.dayofyear("day").alias("doy"), "x")
    # years are few, whatever the rows
    order = Window.orderBy(F.md5(F.concat(F.lit("years|"), F.col("year").cast("string"))), "year")
    o = s.select("year").distinct().select("year", F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    m = o.select("year", (F.col("i") % F.col("n") + 1).alias("i")).join(o.select(F.col("year").alias("donor"), "i"), "i").select("year", "donor")
    b = s.select("cell", F.col("year").alias("donor"), "doy", F.col("x").alias("moved"))
    return s.join(F.broadcast(m), "year").join(b, ["cell", "donor", "doy"], "left").select("cell", "year", "doy", "moved", F.col("x").alias("kept"))


@query("derived_meteorology", """WITH m AS (SELECT event_id, value / 4.0 AS t, value / 4.0 - (event_id % 11) AS d, 1000.0 - (event_id % 30) AS p, CAST(event_id % 7 AS DOUBLE) - 3 AS u, CAST(event_id % 5 AS DOUBLE) - 2 AS v FROM events),
    e AS (SELECT *, 0.6108 * exp(17.27 * t / (t + 237.3)) AS es, 0.6108 * exp(17.27 * d / (d + 237.3)) AS ea FROM m)
    SELECT event_id, round(greatest(es - ea, 0), 5) + 0.0 AS vpd, round(least(greatest(100 * ea / es, 0), 100), 5) + 0.0 AS rh, round(622.0 * ea * 10 / (p - 0.378 * ea * 10), 5) + 0.0 AS q, round(sqrt(u * u + v * v), 6) + 0.0 AS wind, coalesce(d <= t + 0.05 AND p > ea * 10, false) AS ok FROM e""")
def derived_meteorology(spark, sf_dir):
    """Vapour pressure, deficit, humidity, wind, plausibility."""
    t, d = F.col("value") / 4.0, F.col("value") / 4.0 - F.col("event_id") % 11
    p, u, v = F.lit(1000.0) - F.col("event_id") % 30, (F.col("event_id") % 7).cast("double") - 3, (F.col("event_id") % 5).cast("double") - 2
    r5 = lambda x, n: (F.round(x, 5) + F.lit(0.0)).alias(n)
    return read(spark, sf_dir, "events").select("event_id", r5(met.vapour_deficit(t, d), "vpd"), r5(met.relative_humidity(t, d), "rh"), r5(met.specific_humidity(d, p), "q"), r6(met.wind_speed(u, v), "wind"), met.plausible(t, d, p, 0.05).alias("ok"))


@query("qc_bit_predicates", """SELECT l_orderkey, l_linenumber, CAST((l_partkey >> 3) & 7 AS BIGINT) AS field, ((l_partkey >> 3) & 3) = 0 AND ((l_partkey >> 5) & 7) <= 1 AS leaf, ((l_partkey >> 5) & 7) = 0 AS leaf_strict,
    (l_orderkey & 3) = 0 AND ((l_orderkey >> 2) & 1) = 0 AND ((l_orderkey >> 6) & 3) <= 2 AND ((l_orderkey >> 10) & 1) = 0 AND (l_partkey & 3) <= 1 AND l_quantity <= 35 AS clear,
    (l_linenumber BETWEEN 1 AND 366) AND (l_suppkey & 1) = 1 AS burned, (l_partkey & 3) <= 1 AND ((l_partkey >> 6) & 3) <= 1 AS lst,
    round(CASE WHEN l_tax + l_discount <> 0 THEN (l_tax - l_discount) / (l_tax + l_discount) END, 6) + 0.0 AS nd FROM lineitem""")
def qc_bit_predicates(spark, sf_dir):
    """Bit fields of quality words and the predicates on them."""
    c = F.col
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bits.field(c("l_partkey"), 3, 3).alias("field"), bits.leaf_area_ok(c("l_partkey")).alias("leaf"), bits.leaf_area_ok(c("l_partkey"), True).alias("leaf_strict"), bits.reflectance_ok(c("l_orderkey"), c("l_partkey"), c("l_quantity")).alias("clear"), bits.burned(c("l_linenumber"), c("l_suppkey")).alias("burned"), bits.surface_temperature_ok(c("l_partkey")).alias("lst"), r6(bits.normalised_difference(c("l_tax"), c("l_discount")), "nd"))


@query("calendar_keys", """SELECT o_orderkey, CAST(least(floor((dayofyear(o_orderdate) - 1) / 8), 45) AS INTEGER) AS slot, CAST(year(o_orderdate) * 46 + least(floor((dayofyear(o_orderdate) - 1) / 8), 45) AS INTEGER) AS ordinal,
    CASE WHEN month(o_orderdate) = 2 AND dayofmonth(o_orderdate) = 29 THEN DATE '2003-02-28' ELSE make_date(2003, month(o_orderdate), dayofmonth(o_orderdate)) END AS same_2003,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month, dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 AS leap, CAST(dayofmonth(last_day(o_orderdate)) AS INTEGER) AS month_days FROM orders""")
def calendar_keys(spark, sf_dir):
    """Slots, clocks, the same date in another year, months, leap years."""
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", calendar.slot(d).alias("slot"), calendar.slot_ordinal(d).alias("ordinal"), calendar.same_date(d, F.lit(2003)).alias("same_2003"), calendar.month_start(d).alias("month"), calendar.leap(F.year(d)).alias("leap"), F.dayofmonth(F.last_day(d)).alias("month_days"))


@query("binning_and_keys", """SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN 'low' WHEN s_acctbal <= 5000 THEN 'middle' ELSE 'high' END AS bin, CAST(floor(s_suppkey / 3.0) AS BIGINT) || '_' || CAST(floor(s_nationkey / 2.0) AS BIGINT) AS block,
    CAST(('0x' || substr(sha256('7|' || s_name), 7, 2) || substr(sha256('7|' || s_name), 5, 2) || substr(sha256('7|' || s_name), 3, 2) || substr(sha256('7|' || s_name), 1, 2)) AS BIGINT) AS seed,
    CASE WHEN s_acctbal >= 0.3 * 10000 THEN s_acctbal END AS covered FROM supplier""")
def binning_and_keys(spark, sf_dir):
    """Right-closed bins, spatial blocks, coverage, seeds of parts."""
    c = F.col
    return read(spark, sf_dir, "supplier").select("s_suppkey", right_closed(c("s_acctbal"), [0, 5000], ["low", "middle", "high"]).alias("bin"), block_key(c("s_suppkey") / 1.5, c("s_nationkey").cast("double"), 2.0).alias("block"), seed_of(F.lit("7"), c("s_name")).alias("seed"), coverage(c("s_acctbal"), c("s_acctbal"), F.lit(10000.0), 0.3).alias("covered"))
