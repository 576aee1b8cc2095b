"""Cubes of time and place as Parquet in chunks, of which a read takes only those that its points touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days and degrees of a chunk.
DAYS, DEGREES = 50, 1.0
#: A cube has about so many chunks at most, or one for so many rows if that is more: a chunk is a folder and a file.
CHUNKS, ROWS = 1000, 500_000


def chunk(day: str, lat: str, lon: str, days: int = DAYS, degrees: float = DEGREES) -> Column:
    """The name of the chunk that a day and place are in."""
    parts = F.floor(F.datediff(day, F.lit("1970-01-01")) / days), F.floor(F.col(lat) / degrees), F.floor(F.col(lon) / degrees)
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def fitting(rows: DataFrame, day: str, lat: str, lon: str, days: int = DAYS, degrees: float = DEGREES) -> float:
    """Degrees of a chunk: `degrees`, doubled until the cube of these rows has no more chunks than CHUNKS and ROWS allow.

    A cube that grows in space would otherwise have a file for every few rows.
    Whatever the layout, reads have the same rows; the same number goes to
    write_cube() and read_points().
    """
    place = rows.select(F.floor(F.datediff(day, F.lit("1970-01-01")) / days).alias("t"), F.floor(F.col(lat) / degrees).alias("i"), F.floor(F.col(lon) / degrees).alias("j"))
    chunks = place.groupBy("t", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    scales = [2**k for k in range(32)]
    # one row of numbers, each good to a few per cent
    counts = chunks.agg(F.sum("n").alias("n"), *(F.approx_count_distinct(F.struct("t", F.floor(F.col("i") / s), F.floor(F.col("j") / s))).alias(f"c{k}") for k, s in enumerate(scales))).first()
    most = max(CHUNKS, (counts["n"] or 0) // ROWS)
    return degrees * next((s for k, s in enumerate(scales) if counts[f"c{k}"] <= most), scales[-1])


def write_cube(cube: DataFrame, path: str, day: str, lat: str, lon: str, days: int = DAYS, degrees: float = DEGREES) -> None:
    """Writes a cube with a folder for each chunk; a chunk's rows meet in one task, so it is one file."""
    named = cube.withColumn("chunk", chunk(day, lat, lon, days, degrees))
    named.repartition("chunk").sortWithinPartitions("chunk", lat, lon, day).write.partitionBy("chunk").parquet(path)


def touched(spark: SparkSession, path: str, points: DataFrame, day: str, lat: str, lon: str, days: int = DAYS, degrees: float = DEGREES) -> DataFrame:
    """The rows of the chunks that points touch; no other file is opened.

    The names of these chunks, fewer than the folders that the driver lists to
    plan the scan, become a filter on the partition column.
    """
    names = sorted(r["chunk"] for r in points.select(chunk(day, lat, lon, days, degrees).alias("chunk")).distinct().collect() if r["chunk"])
    cube = spark.read.parquet(path)
    return cube.withColumn("chunk", F.col("chunk").cast("string")).where(F.col("chunk").isin(names))


def read_points(spark: SparkSession, path: str, points: DataFrame, day: str, lat: str, lon: str, columns: Sequence[str], days: int = DAYS, degrees: float = DEGREES) -> DataFrame:
    """points with the cube's columns at their day and place, null where the cube has none. Joined within chunks."""
    cube = touched(spark, path, points, day, lat, lon, days, degrees).select("chunk", day, lat, lon, *columns)
    asked = points.withColumn("chunk", chunk(day, lat, lon, days, degrees))
    return asked.join(cube, ["chunk", day, lat, lon], "left").drop("chunk")
