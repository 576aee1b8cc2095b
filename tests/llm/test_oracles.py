"""The corpus queries that SQL can express agree with it."""

import duckdb
import pytest

from sedge.llm import queries
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert differences(queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.SQL[name]).df()) == []


def test_scratch_is_cleared(spark):
    from sedge.llm import common

    df = common.keep(spark.range(3), "scratch")
    assert df.count() == 3
    assert common.clear(spark) >= 1 and common._WRITTEN == []
