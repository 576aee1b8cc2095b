"""Descriptors of series in SQL terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.operators import series as S
from sedge.operators import symbolic as Y
from sedge.plans.base import CELL, DENSE, dense, r6
from sedge.plans.registry import query
from sedge.sources.tables import read

_VALID = f"{DENSE}, v AS (SELECT cell, day, x FROM dense WHERE x IS NOT NULL)"


def _valid(spark, sf_dir):
    return dense(spark, sf_dir).where("x is not null")


@query("ordinal_patterns_entropy_complexity", f"""WITH {_VALID}, e AS (SELECT cell, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM v WINDOW w AS (PARTITION BY cell ORDER BY day)),
    p AS (SELECT cell, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS p FROM e WHERE c IS NOT NULL),
    k AS (SELECT cell, p, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT cell, n, n / sum(n) OVER (PARTITION BY cell) AS p FROM k),
    g AS (SELECT cell, CAST(sum(n) AS BIGINT) AS n, -sum(p * ln(p)) AS s, -sum((p / 2 + 0.5 / 6) * ln(p / 2 + 0.5 / 6)) AS m, count(*) AS seen FROM q GROUP BY 1)
    SELECT cell, n, round(s / ln(6), 6) + 0.0 AS entropy, round((m - (6 - seen) * (0.5 / 6 * ln(0.5 / 6)) - s / 2 - ln(6) / 2) / (-0.5 * (7.0 / 6 * ln(7) - 2 * ln(12) + ln(6))) * s / ln(6), 6) + 0.0 AS complexity FROM g""")
def ordinal_patterns_entropy_complexity(spark, sf_dir):
    """Ordinal patterns, their entropy and complexity."""
    out = Y.entropy_complexity(Y.ordinal_patterns(_valid(spark, sf_dir), CELL, "day", "x", 3), CELL, 3)
    return out.select("cell", "n", r6("entropy", "entropy"), r6("complexity", "complexity"))


@query("word_entropy", f"""WITH {_VALID}, e AS (SELECT cell, CAST(b AS VARCHAR) || lead(b) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w || lead(b, 4) OVER w AS word FROM (SELECT cell, day, CASE WHEN x > 100 THEN 1 ELSE 0 END AS b FROM v) WINDOW w AS (PARTITION BY cell ORDER BY day)),
    k AS (SELECT cell, word, count(*) AS n FROM e WHERE word IS NOT NULL GROUP BY 1, 2), p AS (SELECT cell, n / sum(n) OVER (PARTITION BY cell) AS p FROM k) SELECT cell, round(-sum(p * log2(p)) / 5, 6) + 0.0 AS bits FROM p GROUP BY 1""")
def word_entropy(spark, sf_dir):
    """Bits a day of five-day wet and dry words."""
    rows = _valid(spark, sf_dir).withColumn("wet", F.col("x") > 100)
    return Y.word_entropy(rows, CELL, "day", "wet", 5).select("cell", r6("bits", "bits"))


@query("time_reversal_asymmetry", f"WITH {_VALID}, d AS (SELECT cell, (lead(x, 3) OVER (PARTITION BY cell ORDER BY day) - x) / stddev_pop(x) OVER (PARTITION BY cell) AS d FROM v) SELECT cell, round(avg(pow(d, 3)), 6) + 0.0 AS asymmetry FROM d GROUP BY 1")
def time_reversal_asymmetry(spark, sf_dir):
    """Asymmetry under reversal of time, population deviation."""
    return Y.reversal_asymmetry(_valid(spark, sf_dir), CELL, "day", "x", 3).select("cell", r6("asymmetry", "asymmetry"))


_AMI = f"""WITH {_VALID}, b AS (SELECT cell, day, CAST(floor((row_number() OVER (PARTITION BY cell ORDER BY x, day) - 1) * 8 / count(*) OVER (PARTITION BY cell)) AS BIGINT) AS b FROM v), l AS (SELECT unnest(range(1, 13)) AS lag), r AS (SELECT cell, b, row_number() OVER (PARTITION BY cell ORDER BY day) AS t FROM b),
    j AS (SELECT a.cell, lag, a.b AS i, c.b AS j, count(*) AS n FROM r a CROSS JOIN l JOIN r c ON c.cell = a.cell AND c.t = a.t + lag GROUP BY 1, 2, 3, 4), m AS (SELECT cell, lag, n / sum(n) OVER (PARTITION BY cell, lag) * ln(n * sum(n) OVER (PARTITION BY cell, lag) / (sum(n) OVER (PARTITION BY cell, lag, i) * sum(n) OVER (PARTITION BY cell, lag, j))) AS m FROM j),
    a AS (SELECT cell, CAST(lag AS INTEGER) AS lag, sum(m) AS ami FROM m GROUP BY 1, 2)"""


@query("average_mutual_information", _AMI + " SELECT cell, lag, round(ami, 6) + 0.0 AS ami FROM a")
def average_mutual_information(spark, sf_dir):
    """Mutual information by lag."""
    return Y.mutual_information(_valid(spark, sf_dir), CELL, "day", "x", 8, range(1, 13)).select("cell", "lag", r6("ami", "ami"))


@query("ami_delay", _AMI + ", s AS (SELECT cell, lag, ami, lag(ami) OVER w AS before, lead(ami) OVER w AS after, first_value(ami) OVER w AS first FROM a WINDOW w AS (PARTITION BY cell ORDER BY lag)) SELECT cell, coalesce(least(min(CASE WHEN ami < before AND ami <= after THEN lag END), min(CASE WHEN ami <= first * exp(-1.0) THEN lag END)), 1) AS delay FROM s GROUP BY 1")
def ami_delay(spark, sf_dir):
    """The first minimum or the fall to 1/e, whichever is earlier."""
    a = Y.mutual_information(_valid(spark, sf_dir), CELL, "day", "x", 8, range(1, 13))
    w = Window.partitionBy("cell").orderBy("lag")
    s = a.withColumn("before", F.lag("ami").over(w)).withColumn("after", F.lead("ami").over(w)).withColumn("first", F.first("ami").over(w))
    least = F.least(F.min(F.when((F.col("ami") < F.col("before")) & (F.col("ami") <= F.col("after")), F.col("lag"))), F.min(F.when(F.col("ami") <= F.col("first") * F.exp(F.lit(-1.0)), F.col("lag"))))
    return s.groupBy("cell").agg(F.coalesce(least, F.lit(1)).alias("delay"))


@query("run_length_distribution", f"""WITH {DENSE}, r AS (SELECT cell, day, coalesce(x < 80, false) AS dry, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM dense), g AS (SELECT cell, i - row_number() OVER (PARTITION BY cell ORDER BY i) AS isl FROM r WHERE dry), l AS (SELECT cell, isl, count(*) AS len FROM g GROUP BY 1, 2), k AS (SELECT cell, len, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cell) AS p FROM k)
    SELECT cell, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(sum(len * n) / sum(n), 6) + 0.0 AS mean_length, CAST(sum(n) AS BIGINT) AS runs FROM p GROUP BY 1""")
def run_length_distribution(spark, sf_dir):
    """Runs of a flag, how long they are, and the entropy of that."""
    rows = S.with_run_length(dense(spark, sf_dir), F.col("x") < 80, CELL, "day", "len")
    ends = rows.withColumn("next", F.lead("len").over(Window.partitionBy("cell").orderBy("day"))).where("len > 0 and coalesce(next, 0) = 0")
    return Y.run_entropy(ends, CELL, "len").select("cell", r6("entropy", "entropy"), r6("mean_length", "mean_length"), "runs")


_HOURS = "h AS (SELECT event_type AS cell, date_trunc('hour', ts) AS t, avg(value) AS x FROM events GROUP BY 1, 2), n AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY t) AS i, x FROM h), e AS (SELECT cell, i, x AS a, lead(x, 2) OVER w AS b, lead(x) OVER w AS y FROM n WINDOW w AS (PARTITION BY cell ORDER BY i))"


def _hours(spark, sf_dir):
    """By kind of event, the mean of each hour and its number: a series a cell, of as many hours as the table spans."""
    h = read(spark, sf_dir, "events", ["event_type", "ts", "value"]).groupBy(F.col("event_type").alias("cell"), F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("x"))
    w = Window.partitionBy("cell").orderBy("i")
    n = h.select("cell", F.row_number().over(Window.partitionBy("cell").orderBy("t")).alias("i"), "x")
    return n.select("cell", "i", F.col("x").alias("a"), F.lead("x", 2).over(w).alias("b"), F.lead("x").over(w).alias("y"))


#: Vectors of a series whose pairs with all others are one group of a join.
_BLOCK = 256


def _against(rows, other, condition):
    """rows with all of `other` of the same cell under a condition, by cell and block of rows, so that one long series is many groups."""
    left = rows.withColumn("_b", F.floor(F.col("i") / _BLOCK))
    blocks = left.groupBy("cell").agg(F.max("_b").alias("_most"))
    right = other.join(blocks, "cell").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most")))).drop("_most")
    return left.join(right, ["cell", "_b"]).where(condition).drop("_b")


@query("correlation_sum", f"WITH {_HOURS}, p AS (SELECT u.cell, sqrt(pow(u.a - v.a, 2) + pow(u.b - v.b, 2)) AS d FROM e u JOIN e v ON v.cell = u.cell AND v.i > u.i + 5 AND u.b IS NOT NULL AND v.b IS NOT NULL) SELECT cell, r AS radius, round(avg(CASE WHEN d < r THEN 1.0 ELSE 0 END), 6) + 0.0 AS c FROM p CROSS JOIN (VALUES (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) q(r) GROUP BY 1, 2")
def correlation_sum(spark, sf_dir):
    """Share of pairs of a cell's delay vectors within a radius, near times left out."""
    e = _hours(spark, sf_dir).where("b is not null").select("cell", "i", "a", "b")
    p = _against(e, e.select("cell", F.col("i").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2")), F.col("j") > F.col("i") + 5)
    d = F.hypot(F.col("a") - F.col("a2"), F.col("b") - F.col("b2"))
    shares = p.select("cell", d.alias("d")).groupBy("cell").agg(*(F.avg(F.when(F.col("d") < r, 1.0).otherwise(0.0)).alias(f"c{k}") for k, r in enumerate((2.0, 5.0, 10.0, 20.0))))
    return shares.select("cell", F.explode(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(f"c{k}").alias("c")) for k, r in enumerate((2.0, 5.0, 10.0, 20.0))))).alias("s")).select("cell", "s.radius", r6("s.c", "c"))


@query("recurrence_det_lam", f"""WITH {_HOURS}, p AS (SELECT u.cell, u.i, v.i AS j FROM e u JOIN e v ON v.cell = u.cell AND v.i > u.i + 2 AND u.b IS NOT NULL AND v.b IS NOT NULL AND sqrt(pow(u.a - v.a, 2) + pow(u.b - v.b, 2)) < 8),
    d AS (SELECT cell, j - i AS k, i - row_number() OVER (PARTITION BY cell, j - i ORDER BY i) AS g FROM p), l AS (SELECT cell, count(*) AS len FROM d GROUP BY cell, k, g), c AS (SELECT cell, i, j - row_number() OVER (PARTITION BY cell, i ORDER BY j) AS g FROM p), m AS (SELECT cell, count(*) AS len FROM c GROUP BY cell, i, g),
    x AS (SELECT cell, CAST(sum(len) AS BIGINT) AS points, round(coalesce(sum(len) FILTER (WHERE len >= 2), 0) / sum(len), 6) + 0.0 AS det, max(len) AS longest FROM l GROUP BY 1), y AS (SELECT cell, round(coalesce(sum(len) FILTER (WHERE len >= 2), 0) / sum(len), 6) + 0.0 AS lam FROM m GROUP BY 1)
    SELECT cell, points, det, longest, lam FROM x JOIN y USING (cell)""")
def recurrence_det_lam(spark, sf_dir):
    """Recurrences of a cell's delay vectors on diagonals and columns."""
    e = _hours(spark, sf_dir).where("b is not null").select("cell", "i", "a", "b")
    near = (F.col("j") > F.col("i") + 2) & (F.hypot(F.col("a") - F.col("a2"), F.col("b") - F.col("b2")) < 8)
    p = _against(e, e.select("cell", F.col("i").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2")), near).select("cell", "i", "j")
    k = F.col("j") - F.col("i")
    diag = p.select("cell", k.alias("k"), (F.col("i") - F.row_number().over(Window.partitionBy("cell", k).orderBy("i"))).alias("g")).groupBy("cell", "k", "g").agg(F.count(F.lit(1)).alias("len"))
    col = p.select("cell", "i", (F.col("j") - F.row_number().over(Window.partitionBy("cell", "i").orderBy("j"))).alias("g")).groupBy("cell", "i", "g").agg(F.count(F.lit(1)).alias("len"))
    share = F.sum(F.when(F.col("len") >= 2, F.col("len")).otherwise(0)) / F.sum("len")
    return diag.groupBy("cell").agg(F.sum("len").alias("points"), r6(share, "det"), F.max("len").alias("longest")).join(col.groupBy("cell").agg(r6(share, "lam")), "cell")


@query("knn_prediction_error", f"""WITH {_HOURS}, s AS (SELECT *, max(i) OVER (PARTITION BY cell) AS n FROM e WHERE b IS NOT NULL AND y IS NOT NULL), d AS (SELECT t.cell, t.i, t.y, l.y AS ly, row_number() OVER (PARTITION BY t.cell, t.i ORDER BY round(sqrt(pow(t.a - l.a, 2) + pow(t.b - l.b, 2)), 9), l.i) AS k FROM s t JOIN s l ON l.cell = t.cell AND t.i > t.n * 0.6 AND l.i <= l.n * 0.6),
    f AS (SELECT cell, i, y, avg(ly) AS p FROM d WHERE k <= 5 GROUP BY 1, 2, 3) SELECT cell, count(*) AS n, round(sqrt(avg(pow(y - p, 2))) / stddev_pop(y), 6) + 0.0 AS error FROM f GROUP BY 1""")
def knn_prediction_error(spark, sf_dir):
    """Error of five nearest neighbours, the first part of a cell's series predicting the rest."""
    s = _hours(spark, sf_dir).where("b is not null and y is not null").withColumn("n", F.max("i").over(Window.partitionBy("cell")))
    lib = s.where("i <= n * 0.6").select("cell", F.col("i").alias("li"), F.col("a").alias("la"), F.col("b").alias("lb"), F.col("y").alias("ly"))
    d = _against(s.where("i > n * 0.6"), lib, F.lit(True)).withColumn("d", F.round(F.hypot(F.col("a") - F.col("la"), F.col("b") - F.col("lb")), 9))
    f = d.withColumn("k", F.row_number().over(Window.partitionBy("cell", "i").orderBy("d", "li"))).where("k <= 5").groupBy("cell", "i", "y").agg(F.avg("ly").alias("p"))
    return f.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))) / F.stddev_pop("y"), "error"))


@query("false_nearest_neighbours", f"""WITH {_HOURS}, f AS (SELECT cell, i, a, b, lead(a, 4) OVER (PARTITION BY cell ORDER BY i) AS c FROM e), s AS (SELECT *, stddev_pop(a) OVER (PARTITION BY cell) AS sd FROM f WHERE c IS NOT NULL),
    d AS (SELECT u.cell, u.i, u.sd, sqrt(pow(u.a - v.a, 2) + pow(u.b - v.b, 2)) AS d, abs(u.c - v.c) AS g, row_number() OVER (PARTITION BY u.cell, u.i ORDER BY round(sqrt(pow(u.a - v.a, 2) + pow(u.b - v.b, 2)), 9), v.i) AS k FROM s u JOIN s v ON v.cell = u.cell AND abs(u.i - v.i) > 5)
    SELECT cell, count(*) AS n, round(avg(CASE WHEN d > 0 AND (g / d > 10 OR sqrt(d * d + g * g) > 2 * sd) THEN 1.0 ELSE 0 END), 6) + 0.0 AS share FROM d WHERE k = 1 GROUP BY 1""")
def false_nearest_neighbours(spark, sf_dir):
    """Neighbours of a cell's vectors that part when one coordinate more is seen."""
    w = Window.partitionBy("cell").orderBy("i")
    s = _hours(spark, sf_dir).withColumn("c", F.lead("a", 4).over(w)).where("c is not null").select("cell", "i", "a", "b", "c", F.stddev_pop("a").over(Window.partitionBy("cell")).alias("sd"))
    d = _against(s, s.select("cell", *(F.col(c).alias(f"{c}2") for c in "iabc")), F.abs(F.col("i") - F.col("i2")) > 5).withColumn("d", F.hypot(F.col("a") - F.col("a2"), F.col("b") - F.col("b2"))).withColumn("g", F.abs(F.col("c") - F.col("c2")))
    near = d.withColumn("k", F.row_number().over(Window.partitionBy("cell", "i").orderBy(F.round("d", 9), "i2"))).where("k = 1")
    false = (F.col("d") > 0) & ((F.col("g") / F.col("d") > 10) | (F.hypot("d", "g") > 2 * F.col("sd")))
    return near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(false, 1.0).otherwise(0.0)), "share"))
