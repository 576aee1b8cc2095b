"""Every registered query runs, and agrees with its SQL twin where it has one."""

import glob
import os

import duckdb
import pytest

from sedge.plans import registry
from sedge.plans.all import load_all
from tests.compare import differences

load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert differences(got, want) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert len(registry.QUERIES[name](spark, sf_dir).toPandas()) > 0
