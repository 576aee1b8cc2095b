"""Cubes in chunks: what is read, and that it is all that is asked for."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from sedge.sources import cubes as C


def test_only_touched_chunks_are_read(spark, tmp_path):
    rnd, start = random.Random(5), date(1999, 12, 1)
    rows = [(start + timedelta(days=d), i * 0.5 - 3, j * 0.5 - 2, float(d + i * j)) for d in range(0, 240, 2) for i in range(10) for j in range(8)]
    path = f"{tmp_path}/cube"
    cube = spark.createDataFrame(rows, "day date, lat double, lon double, x double")
    C.write_cube(cube, path, "day", "lat", "lon")
    inside = [(k, start + timedelta(days=rnd.randint(60, 90)), rnd.choice([-1.0, -0.5]), rnd.choice([0.0, 0.5])) for k in range(40)]
    odd = [(100, date(1980, 1, 1), -1.0, 0.0), (101, None, -1.0, 0.0), (102, start + timedelta(days=60), 77.0, 0.0), (103, inside[0][1], None, 0.5), (40, *inside[0][1:])]
    points = spark.createDataFrame(inside + odd, "k int, day date, lat double, lon double")
    got = C.read_points(spark, path, points, "day", "lat", "lon", ["x"])
    want = {(d, a, b): x for d, a, b, x in rows}
    found = got.collect()
    assert sorted((r["k"], r["x"]) for r in found if r["x"] is not None) == sorted((k, want[d, a, b]) for k, d, a, b in inside + odd if (d, a, b) in want)
    assert len(found) == len(inside) + len(odd) and got.columns == ["day", "lat", "lon", "k", "x"]
    # the files that the read opens are those of the chunks that the points touch
    opened = {r[0] for r in C.touched(spark, path, points, "day", "lat", "lon").select(F.input_file_name()).distinct().collect()}
    name = lambda d, a, b: f"{(d - date(1970, 1, 1)).days // 50}_{int(a // 1)}_{int(b // 1)}"
    chunks = {name(d, a, b) for _, d, a, b in inside}
    assert {f.split("chunk=")[1].split("/")[0] for f in opened} == chunks and len(opened) == len(chunks) < len({name(*r[:3]) for r in rows}) / 10
    plan = C.touched(spark, path, points, "day", "lat", "lon")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(chunk" in plan or "PartitionFilters: [chunk" in plan
    assert C.read_points(spark, path, points.where("false"), "day", "lat", "lon", ["x"]).count() == 0


def test_chunks_grow_with_the_space(spark, tmp_path, monkeypatch):
    """a cube over a wide space has no folder for every few rows, and its points read the same."""
    monkeypatch.setattr(C, "CHUNKS", 20)
    start = date(2000, 1, 1)
    rows = [(start + timedelta(days=d), float(i), 0.5, float(d + i)) for d in range(0, 90, 10) for i in range(-300, 300)]
    cube = spark.createDataFrame(rows, "day date, lat double, lon double, x double")
    degrees = C.fitting(cube, "day", "lat", "lon")
    path = f"{tmp_path}/wide"
    C.write_cube(cube, path, "day", "lat", "lon", C.DAYS, degrees)
    chunks = [p for p in (tmp_path / "wide").iterdir() if p.name.startswith("chunk=")]
    assert degrees > 1 and 2 <= len(chunks) <= 30
    points = spark.createDataFrame([(1, rows[7][0], rows[7][1], 0.5), (2, rows[7][0], 9e4, 0.5)], "k int, day date, lat double, lon double")
    assert sorted((r["k"], r["x"]) for r in C.read_points(spark, path, points, "day", "lat", "lon", ["x"], C.DAYS, degrees).collect()) == [(1, rows[7][3]), (2, None)]
    assert C.fitting(cube.where("lat between 0 and 3 and day < '2000-01-20'"), "day", "lat", "lon") == 1.0 and C.fitting(cube.where("false"), "day", "lat", "lon") == 1.0
