"""Batches in parts that can be taken up again: results are kept by a hash of the specification's used sections, parts count once a manifest names them."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spec_hash(spec: dict, sections: Sequence[str] | None = None) -> str:
    """Ten digits of the SHA-256 of a specification's JSON, or of some sections of it, keys in order."""
    part = spec if sections is None else {k: spec[k] for k in sections}
    return hashlib.sha256(json.dumps(part, sort_keys=True, default=str).encode()).hexdigest()[:10]


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; in local mode a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sedge-")
    return f"{where.rstrip('/')}/parts-{uuid.uuid4().hex}"


class Batch:
    """Parts of a batch below a folder.

    A round's results are written to a folder of their own and count once the
    manifest has a row for each of its parts, which is written last; so what a
    run that was killed has left is not read, and the next run computes only
    parts without a row. The manifest has folder, rows and checksum (sum of
    row hashes) of each part. Parts under another hash are other parts: a
    change in a section that is used starts anew, one elsewhere doesn't. A
    specification whose status isn't `frozen` is refused.
    """

    MANIFEST = "part string, folder string, rows long, checksum decimal(38,0), round int, finished timestamp"

    def __init__(self, spark: SparkSession, folder: str, spec: dict, sections: Sequence[str]):
        if spec.get("status") != "frozen":
            raise ValueError("a batch runs on a frozen specification only")
        self.spark, self.hash = spark, spec_hash(spec, sections)
        self.path = f"{folder.rstrip('/')}/{self.hash}"

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def manifest(self) -> DataFrame:
        """A row for each part that is done."""
        where = f"{self.path}/done"
        return self.spark.read.schema(self.MANIFEST).parquet(where) if self._exists(where) else self.spark.createDataFrame([], self.MANIFEST)

    def run(self, parts: DataFrame, compute: Callable[[DataFrame], DataFrame], size: int, rounds: int | None = None) -> int:
        """Computes the parts that aren't done, about `size` at a time, at most `rounds` times; the number of rounds that ran.

        parts has a column `part`, once for each. compute takes a DataFrame of
        such rows and returns results with `part`; a part without a result is
        done with no rows.
        """
        done = self.manifest()
        todo = parts.select("part").distinct().join(done, "part", "left_anti")
        n = todo.count()
        last = (done.agg(F.max("round")).first()[0] or 0) if n else 0
        total = -(-n // size)
        ran = min(total, total if rounds is None else rounds)
        for k in range(ran):
            mine = todo.where(F.pmod(F.xxhash64("part"), F.lit(total)) == k)
            folder = f"{self.path}/results/{uuid.uuid4().hex}"
            compute(mine).write.parquet(folder)
            kept = self.spark.read.parquet(folder)
            sums = kept.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(kept.columns)).cast("decimal(38,0)")).alias("checksum"))
            rows = mine.join(sums, "part", "left").select("part", F.lit(folder).alias("folder"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("checksum", F.lit(0).cast("decimal(38,0)")).alias("checksum"), F.lit(last + k + 1).alias("round"), F.current_timestamp().alias("finished"))
            # todo was read from the manifest as it was: what is appended doesn't change it within this run
            rows.write.mode("append").parquet(f"{self.path}/done")
        return ran

    def results(self) -> DataFrame:
        """Results of all parts that are done, with the round of each."""
        done = self.manifest()
        folders = [r["folder"] for r in done.where("rows > 0").select("folder").distinct().collect()]  # a folder a round
        if not folders:
            raise ValueError("no part with results is done")
        rows = self.spark.read.parquet(*folders)
        return rows.join(done.select("part", "round"), "part")

    def damaged(self) -> DataFrame:
        """(part, rows, found): parts whose results are no longer what the manifest says."""
        rows = self.results().drop("round")
        now = rows.groupBy("part").agg(F.count(F.lit(1)).alias("found"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("_sum"))
        both = self.manifest().where("rows > 0").join(now, "part", "left")
        return both.where("found is null or found <> rows or _sum <> checksum").select("part", "rows", F.coalesce("found", F.lit(0).cast("long")).alias("found"))
