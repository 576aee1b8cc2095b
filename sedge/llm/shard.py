"""Weighted rendezvous hashing of stable record keys, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers; a shard is numbered in blocks of about this size.
BLOCK_ROWS = 20_000
_UNIT = float(1 << 52)


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) of the key and a salt: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key)), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.log(uniform(key, str(shard))) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def best(key: Column, weights: Sequence[float]) -> Column:
    """struct<score, shard>: the shard with the least -ln(u)/weight; shard i gets a share weights[i]/sum(weights).

    Only the key and the weights of the shards decide. A further shard takes
    rows only into itself, since the other scores stay as they are. A shard of
    weight 0 gets none. Ties go to the lower number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be at least 0, one of them above")
    return F.array_min(F.array(*(_score(key, i, w) for i, w in enumerate(weights) if w > 0)))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of best()'s shard."""
    return best(key, weights)["shard"]


def assign(docs: DataFrame, weights: Sequence[float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every record's shard, its place there, and its shard if one more of mean weight came.

    Returns doc_id, size (UTF-8 bytes of the text, null none, plus 8),
    text_crc32, law ('key'), shard, slot (gapless from 0 in each shard, by a
    hash of the key) and grown_shard. A null key counts as the text 'null';
    repeated keys share a shard and get slots of their own, those of equal rows
    in any order. No rows, no rows; other columns don't matter.

    A shard is numbered in blocks, ranges of that hash of about BLOCK_ROWS
    rows, so that no task holds a shard; the blocks' sizes give their starts.
    """
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    blocks = max(1, math.ceil(docs.count() / (BLOCK_ROWS * len(weights))))
    place = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_column), F.lit(""))) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_column), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        key.alias("_key"),
        best(key, weights).alias("_best"),
        uniform(key, "slot").alias("_at"),
    )
    # one more shard: only its own score is new
    grown = F.array_min(F.array(F.col("_best"), _score(F.col("_key"), len(weights), sum(weights) / len(weights))))["shard"]
    place = place.select("doc_id", "size", "text_crc32", "law", F.col("_best.shard").cast("int").alias("shard"), "_at", grown.cast("int").alias("grown_shard"))
    block = F.least(F.floor(F.col("_at") * blocks), F.lit(blocks - 1)).cast("int").alias("_block")
    place = place.select("*", block)
    keys = docs.select(rendezvous(key, weights).cast("int").alias("shard"), uniform(key, "slot").alias("_at")).select("shard", block)
    sizes = keys.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))

    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_at", "doc_id", "size", "text_crc32"))
    ranked = place.withColumn("_rank", within.cast("long") - 1).join(starts, ["shard", "_block"])
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_rank")).alias("slot"), "grown_shard")
