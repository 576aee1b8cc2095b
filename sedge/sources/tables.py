"""Tables as Parquet folders or files, with contracts: columns, calendars, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table, or only some columns of it; the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns: in Spark NaN equals itself and exceeds all numbers."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def missing_days(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Days of a period that a table lacks."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day))
    return spine.join(df.select(day).distinct(), day, "left_anti")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join that fails if a key of the right side occurs twice."""
    counted = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_k"))
    checked = right.join(counted, list(on)).where("assert_true(_k = 1, 'a key of the right side occurs twice') is null").drop("_k")
    return left.join(checked, list(on), "left")


def write_once(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes Parquet, replacing only the partitions that df has."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size, time and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def read_points_csv(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """lat, lon and time of a CSV of detections within (north, west, south, east)."""
    north, west, south, east = bounds
    rows = spark.read.schema("lat double, lon double, data_pas string").option("header", True).csv(path)
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("lat", "lon", F.to_timestamp("data_pas").alias("ts"))
