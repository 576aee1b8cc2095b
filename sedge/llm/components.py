"""Connected components of an edge table by labels that spread and jump, and joins that keys with very many rows don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import keep

#: A key with more than one in SHARE of all rows is dealt over several parts; so fewer than SHARE keys are.
SHARE = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of keys that hold over one in SHARE of `total` rows: fewer than SHARE of them. counts: key, n."""
    return counts.where(F.col("n") * SHARE > total).select(key, F.ceil(F.col("n") * SHARE / F.lit(max(1, total))).alias("parts"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key; rows of hot keys are dealt over their parts, to each of which the table's row is copied.

    hot (from hot_keys) is the one thing broadcast: fewer than SHARE rows.
    """
    hot = F.broadcast(hot)
    left = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("parts")))).drop("parts")
    right = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): root is the least node that a node reaches. edges: src, dst (long).

    Every round takes the least root of the neighbours, then the root's own
    root, so paths halve; rounds end when no root changes. Labels go through
    the shared folder. Nodes with very many edges and roots of very many nodes
    are dealt over several parts. Loops count for nothing, repeated edges once;
    no edges, no rows.
    """
    edges = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = keep(edges, f"{name}-edges")
    total = 2 * edges.count()
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degrees = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("low"))
    labels = keep(degrees.select(F.col("src").alias("node"), F.least("src", "low").alias("root"), "n"), name)
    busy = keep(hot_keys(labels.select(F.col("node").alias("dst"), "n"), "dst", total), f"{name}-busy")
    nodes = labels.count()
    labels = labels.drop("n")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("dst"), "root"), "dst", busy).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # a root has few nodes more than it had a round ago, or is dealt anew in the next round
        large = hot_keys(labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", nodes)
        new = keep(spread_join(low, up, "root", large, "left").select("node", "was", F.least(F.col("root"), F.coalesce("top", "root")).alias("root")), name)
        changed = not new.where(F.col("was") != F.col("root")).isEmpty()
        labels = new.select("node", "root")
        if not changed:
            return labels
