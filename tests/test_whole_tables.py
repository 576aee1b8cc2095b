"""Queries over the whole of their tables, against brute force on small fixtures."""

from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd

from sedge.plans import registry
from sedge.plans.all import load_all

load_all()


def test_cell_means_of_all_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    supplier = pd.DataFrame({"s_suppkey": np.arange(1, 401), "s_acctbal": rng.normal(1000, 300, 400).round(2)})
    supplier.to_parquet(tmp_path / "supplier.parquet")
    got = registry.QUERIES["overlap_weighted_cell_mean"](spark, str(tmp_path)).toPandas()
    got = {(round(r.south / 0.6), round(r.west / 0.6)): r["mean"] for _, r in got.iterrows()}
    sums = defaultdict(lambda: [0.0, 0.0])
    for k, x in supplier.itertuples(index=False):
        lat, lon = k // 10 * 0.25, k % 10 * 0.25
        for i in range(20):
            for j in range(6):
                high = min(i * 0.6 + 0.6, lat + 0.25) - max(i * 0.6, lat)
                wide = min(j * 0.6 + 0.6, lon + 0.25) - max(j * 0.6, lon)
                if high > 1e-9 and wide > 1e-9:
                    w = high * wide * np.cos(np.radians(lat))
                    sums[i, j][0] += w * x
                    sums[i, j][1] += w
    assert set(got) == set(sums) and max(i for i, _ in got) > 4
    assert all(abs(got[c] - a / b) < 2e-5 for c, (a, b) in sums.items())
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    for south, west, mean in con.execute(registry.SQL["overlap_weighted_cell_mean"]).fetchall():
        assert abs(got[round(float(south) / 0.6), round(float(west) / 0.6)] - float(mean)) < 2e-5
