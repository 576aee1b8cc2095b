"""Batches that are taken up again."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedge.sources.parts import Batch, scratch, spec_hash

SPEC = {"status": "frozen", "model": {"k": 3}, "report": {"digits": 2}}


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/batch"


def work(seen):
    """A computation that notes which parts it was given; part p0 has no result."""

    def compute(parts):
        seen.append(sorted(r["part"] for r in parts.collect()))
        return parts.where("part <> 'p0'").withColumn("value", F.explode(F.sequence(F.lit(1), F.length("part"))))

    return compute


def table(spark, n):
    return spark.createDataFrame([(f"p{k}",) for k in range(n)] + [("p1",)], "part string")


def test_a_killed_run_is_taken_up(spark, folder):
    seen = []
    assert Batch(spark, folder, SPEC, ["model"]).run(table(spark, 11), work(seen), 3, rounds=2) == 2
    first = sorted(sum(seen, []))
    assert 0 < len(first) < 11 and len(Batch(spark, folder, SPEC, ["model"]).manifest().collect()) == len(first)
    again = []
    batch = Batch(spark, folder, SPEC, ["model"])
    batch.run(table(spark, 11), work(again), 3)
    assert sorted(sum(again, []) + first) == sorted(f"p{k}" for k in range(11))
    rows = batch.results().toPandas()
    assert len(rows) == sum(len(f"p{k}") for k in range(1, 11)) and "p0" not in set(rows.part)
    assert {r["part"]: r["rows"] for r in batch.manifest().collect()}["p0"] == 0
    assert batch.run(table(spark, 11), work(again), 3) == 0 and batch.damaged().count() == 0
    # a new part is all that is left to do
    more = []
    batch.run(table(spark, 12), work(more), 3)
    assert more == [["p11"]] and batch.manifest().agg(F.max("round")).first()[0] == rows["round"].max() + 1


def test_results_that_no_manifest_names_do_not_count(spark, folder):
    batch = Batch(spark, folder, SPEC, ["model"])

    def fails(parts):
        spark.createDataFrame([("p1", 9)], "part string, value int").write.parquet(f"{batch.path}/results/left-behind")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        batch.run(table(spark, 4), fails, 9)
    with pytest.raises(ValueError, match="no part"):
        batch.results()
    batch.run(table(spark, 4), work([]), 9)
    assert batch.results().where("value = 9").count() == 0


def test_a_changed_specification_starts_anew(spark, folder):
    seen = []
    Batch(spark, folder, SPEC, ["model"]).run(table(spark, 4), work(seen), 9)
    assert Batch(spark, folder, {**SPEC, "report": {"digits": 5}}, ["model"]).run(table(spark, 4), work(seen), 9) == 0
    other = Batch(spark, folder, {**SPEC, "model": {"k": 4}}, ["model"])
    assert other.manifest().count() == 0 and other.run(table(spark, 4), work(seen), 9) == 1 and len(seen) == 2
    with pytest.raises(ValueError, match="frozen"):
        Batch(spark, folder, {**SPEC, "status": "draft"}, ["model"])
    assert Batch(spark, folder, SPEC, ["model"]).run(spark.createDataFrame([], "part string"), work(seen), 9) == 0


def test_damage_is_found(spark, folder):
    batch = Batch(spark, folder, SPEC, ["model"])
    batch.run(table(spark, 4), work([]), 9)
    where = batch.manifest().first()["folder"].removeprefix("file:").replace("//", "/", 1)
    rows = pd.read_parquet(where)
    for f in __import__("pathlib").Path(where).glob("*"):
        f.unlink()
    for f in __import__("pathlib").Path(where).glob(".*.crc"):
        f.unlink()
    rows.loc[rows.part == "p2", "value"] += 1
    rows[rows.part != "p3"].to_parquet(f"{where}/part-0.parquet", index=False)
    assert sorted((r["part"], r["found"]) for r in batch.damaged().collect()) == [("p2", 2), ("p3", 0)]


def test_hash_of_a_specification():
    a = {"b": {"y": 1, "x": [1, 2]}, "a": "é"}
    assert spec_hash(a) == spec_hash(json.loads(json.dumps({"a": "é", "b": {"x": [1, 2], "y": 1}}))) != spec_hash(a, ["a"])
    assert spec_hash(a, ["a"]) == spec_hash({**a, "b": 0}, ["a"]) and len(spec_hash(a)) == 10


def test_scratch_asks_for_a_shared_folder(spark):
    assert scratch(spark) != scratch(spark)
