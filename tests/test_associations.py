"""Batteries of associations against least squares on ranks, Student's t against its closed forms."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedge.kernels.special import incomplete_beta
from sedge.operators import associations as A

MODELS = [A.Model("plain", "u", "v"), A.Model("two", "u", "v", ("w", "z")), A.Model("part", "u", "v", ("w",), "k % 3 = 0"), A.Model("flat", "one", "v", ("w",)), A.Model("explained", "u", "v", ("u",))]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    n = 144
    k = np.arange(n)
    w, z = rng.normal(size=n).round(1), np.sin(k / 9) + 0.2 * rng.normal(size=n)
    u = w + rng.normal(size=n)
    v = 0.6 * u - z + rng.normal(size=n)
    pdf = pd.DataFrame({"k": k, "lat": (k // 12) * 0.25, "lon": (k % 12) * 0.25, "u": u, "v": v, "w": w, "z": z, "one": 1.0})
    pdf.loc[[5, 17], "w"] = None
    return pdf


def ranks_of(pdf, m):
    used = [m.exposure, m.response, *m.controls]
    part = pdf[(pdf.k % 3 == 0) | (m.where == "true")].dropna(subset=used)
    return part, [part[c].rank().to_numpy() for c in used]


def left_of(y, controls):
    x = np.column_stack([np.ones(len(y)), *controls])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def partial_of(rx, ry, rc):
    a, b = left_of(rx, rc), left_of(ry, rc)
    return np.corrcoef(a, b)[0, 1] if a.std() > 1e-6 and b.std() > 1e-6 else None


def test_battery_by_least_squares(spark, table):
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "k long, lat double, lon double, u double, v double, w double, z double, one double")
    got = {r["model"]: r for r in A.battery(df, "k", "lat", "lon", MODELS, 1.0, 99, "s").collect()}
    assert set(got) == {m.name for m in MODELS}
    drawn = {m.name: [] for m in MODELS}
    import hashlib

    for m in MODELS:
        part, (rx, ry, *rc) = ranks_of(table, m)
        r = got[m.name]
        assert r["cells"] == len(part)
        want = partial_of(rx, ry, rc)
        assert (r["partial"] is None) == (want is None) and (want is None or r["partial"] == pytest.approx(want, abs=1e-8))
        assert m.name == "flat" or r["raw"] == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-8)
        block = (np.floor(part.lat) * 1000 + np.floor(part.lon)).astype(int).to_numpy()
        names = sorted(set(block))
        for d in range(99):
            take = [int(hashlib.md5(f"s|{d}|{k}".encode()).hexdigest()[:8], 16) % len(names) for k in range(len(names))]
            at = np.concatenate([np.flatnonzero(block == names[k]) for k in take])
            v = partial_of(rx[at], ry[at], [c[at] for c in rc])
            if v is not None:
                drawn[m.name].append(v)
        if want is not None and m.name != "explained":
            v = np.array(drawn[m.name])
            assert r["draws"] == len(v) and r["lo"] == pytest.approx(np.quantile(v, 0.025), abs=1e-7) and r["hi"] == pytest.approx(np.quantile(v, 0.975), abs=1e-7)
            assert r["p"] == pytest.approx(min(1, 2 * (min((v <= 0).sum(), (v >= 0).sum()) + 1) / (len(v) + 1)))


def test_spatial_inference_by_hand(spark, table):
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "k long, lat double, lon double, u double, v double, w double, z double, one double")
    got = {r["model"]: r for r in A.spatial_inference(df, "k", "lat", "lon", MODELS[:3], 0.26, 0.5, 50.0).collect()}
    for m in MODELS[:3]:
        part, (rx, ry, *rc) = ranks_of(table, m)
        x, y = left_of(rx, rc), left_of(ry, rc)
        e = y - (x @ y) / (x @ x) * x
        n = len(x)
        d = np.hypot(part.lat.to_numpy()[:, None] - part.lat.to_numpy(), part.lon.to_numpy()[:, None] - part.lon.to_numpy())
        np.fill_diagonal(d, -1)
        total = float(n)
        for lo in np.arange(0, d.max() + 0.5, 0.5):
            w = (d > lo + 1e-9) & (d <= lo + 0.5 + 1e-9)
            if w.sum():
                total += w.sum() * (x @ w @ x / w.sum() / (x @ x / n)) * (y @ w @ y / w.sum() / (y @ y / n))
        n_eff = 1 + 1 / max(total / n**2, 1 / n)
        freedom = max(n_eff - 2 - len(m.controls), 1e-9)
        r = np.corrcoef(x, y)[0, 1]
        near = (d > 0) & (d <= 0.26)
        g = got[m.name]
        assert g["cells"] == n and g["partial"] == pytest.approx(r, abs=1e-9) and g["n_eff"] == pytest.approx(n_eff, rel=1e-8) and g["df"] == pytest.approx(freedom, rel=1e-8)
        t = r * math.sqrt(freedom / (1 - r * r))
        assert g["p"] == pytest.approx(incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)), abs=1e-8)
        if near.any():
            assert g["moran"] == pytest.approx(n / near.sum() * (e @ near @ e) / (e @ e), abs=1e-9)


#: Two-sided 5 % and 1 % points of Student's t.
TABLED = [(12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (1.983972, 100, 0.05), (63.656741, 1, 0.01), (3.169273, 10, 0.01), (2.625891, 100, 0.01)]


def test_student_in_both_dialects(spark):
    rows = [(t, float(df)) for t, df, _ in TABLED] + [(t, df) for df in (1e-9, 0.01, 0.3, 1.5, 2.0, 3.7, 42.5, 997.25, 20000.0) for t in (0.0, 0.4, 1.3, 3.0, 9.0)]
    got = [r["p"] for r in A.student_two_sided(F.col("t"), F.col("df"), spark.createDataFrame(rows, "t double, df double"), "p").collect()]
    for (t, df), p in zip(rows, got, strict=True):
        assert p == pytest.approx(incomplete_beta(df / 2, 0.5, df / (df + t * t)) if t else 1.0, abs=2e-8), (t, df)
    for p, (_, _, want) in zip(got, TABLED, strict=False):
        assert p == pytest.approx(want, abs=1e-7)
    con = duckdb.connect()
    con.register("rows", pd.DataFrame(rows, columns=["t", "df"]))
    other = con.execute(f"select {A.student_sql('t', 'df', 'duckdb')} from rows").fetchall()
    assert np.allclose([p for (p,) in other], got, atol=1e-11)


def test_no_cells(spark):
    none = spark.createDataFrame([], "k long, lat double, lon double, u double, v double, w double, z double, one double")
    assert A.battery(none, "k", "lat", "lon", MODELS, 1.0, 9, "s").count() == 0
    assert A.spatial_inference(none, "k", "lat", "lon", MODELS, 0.26, 0.5, 5.0).count() == 0


def test_pairs_meet_by_blocks(spark, table, monkeypatch):
    """cells over many squares and blocks, some with one key or one place, against all pairs at once; the ranks are read twice."""
    from sedge.operators import spatial as P

    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "STEP", 40)
    rng = np.random.default_rng(3)
    rows = [(int(k), float(a), float(b), *map(float, v)) for k, a, b, v in zip(rng.integers(0, 110, 130), rng.integers(-9, 30, 130) * 0.25, rng.integers(-4, 4, 130) * 0.25, np.column_stack([rng.integers(0, 2, 130), rng.normal(size=(130, 3))]), strict=True)]
    rows = list({r[:3]: (*r[:4], *(v * r[3] for v in r[4:])) for r in rows}.values())
    df = spark.createDataFrame([*rows, (500, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "k long, lat double, lon double, one0 double, rx0 double, ry0 double, e0 double")
    got = {r["class"]: tuple(r)[2:] for r in P.class_sums(df, "k", "lat", "lon", ["m"], 0.26, 0.5, 3.0).collect()}
    want = {}
    for k, a, b, one, rx, ry, e in rows:
        for k2, a2, b2, one2, rx2, ry2, e2 in rows:
            d = math.hypot(a - a2, b - b2)
            if k != k2 and d <= 3.0:
                near = float(d <= 0.26)
                w = want.setdefault(math.ceil(round(d / 0.5, 9)), np.zeros(5))
                w += [one * one2, rx * rx2, ry * ry2, near * one * one2, near * e * e2]
    want = {c: w for c, w in want.items() if w[0]}
    assert set(got) == set(want) and all(np.allclose(got[c], want[c]) for c in want)
    cells = spark.createDataFrame(table.astype(object).where(table.notna(), None).values.tolist(), "k long, lat double, lon double, u double, v double, w double, z double, one double")
    plan = A.residuals(A.dealt(cells, "k", "lat", "lon", MODELS), A.variables(MODELS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 2


def test_registered_tests_plan(spark, sf_dir):
    """what the adjustments read is made once; the plan that the driver holds reads no table."""
    from sedge.plans.associations import registered_tests

    leaves = registered_tests(spark, sf_dir)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).nodeName() for i in range(leaves.size())} == {"InMemoryRelation"}
