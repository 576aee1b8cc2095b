"""Series queries over all days of their tables, whatever the years."""

import numpy as np
import pandas as pd
import pytest

from sedge.plans import registry
from sedge.plans.all import load_all

load_all()
DAYS = 420


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """Two cells of 420 days from 2010 on."""
    rng = np.random.default_rng(9)
    at = tmp_path_factory.mktemp("late")
    days = pd.date_range("2010-01-01", periods=DAYS).date
    x = {c: np.round(50 + 20 * rng.random(DAYS), 2) for c in "AB"}
    pd.DataFrame({"l_returnflag": np.repeat(list("AB"), DAYS), "l_shipdate": np.tile(days, 2), "l_quantity": np.concatenate([x["A"], x["B"]])}).to_parquet(at / "lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["surrogate_suite_cells", "ft_surrogate_asymmetry", "ews_trend_test"])
def test_suites_have_all_days(spark, late, name):
    got = registry.QUERIES[name](spark, late).toPandas()
    assert set(got["cell"]) == {"A", "B"} and (got["n"] == DAYS).all() and got["error"].isna().all()


@pytest.mark.parametrize("name", ["surrogate_suite_families", "smap_gain_cells", "ccm_pairs", "stationarity_cells", "wolf_kantz_cao_cells"])
def test_other_years_have_results(spark, late, name):
    assert len(registry.QUERIES[name](spark, late).toPandas()) > 0


def test_reference_counts(spark, late):
    suite = registry.QUERIES["surrogate_suite_cells"](spark, late).toPandas()
    assert suite["n_null"].max() == 39


def test_early_warnings_of_all_windows(spark, late):
    from sedge.kernels import dynamics as D

    rows = pd.read_parquet(f"{late}/lineitem.parquet").sort_values("l_shipdate")
    got = registry.QUERIES["ews_trend_test"](spark, late).toPandas().set_index(["cell", "descriptor"])
    assert (got["n_null"] == 39).all()
    for cell, part in rows.groupby("l_returnflag"):
        r = D.gaussian_detrended(part["l_quantity"].to_numpy(), 365)
        w = DAYS // 2
        want = D.kendall(np.array([r[i : i + w].var(ddof=1) for i in range(DAYS - w + 1)]))
        assert abs(got.loc[(cell, "variance_trend"), "observed"] - want) < 1e-9


def test_forecasts_at_all_vectors(spark, late):
    from sedge.kernels import dynamics as D

    rows = pd.read_parquet(f"{late}/lineitem.parquet").sort_values("l_shipdate")
    got = registry.QUERIES["smap_gain_cells"](spark, late).toPandas().set_index("cell")
    for cell, part in rows.groupby("l_returnflag"):
        want = D.forecast_gain(part["l_quantity"].to_numpy(), 3, 1, 7, every=1)
        assert abs(got.loc[cell, "gain"] - want["gain"]) < 1e-9


def test_least_columns_as_a_stable_sort_has_them():
    from sedge.kernels import dynamics as D

    d = np.random.default_rng(1).integers(0, 6, (200, 30)).astype(float)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (D._first(d.copy(), 5) == want).all()
