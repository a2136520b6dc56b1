"""The queries that SQL can express against their SQL, over the test tables."""

import glob
import os

import duckdb
import pytest

from entitylink.llm import queries


@pytest.fixture(scope="module")
def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(str(tuple(None if v is None or v != v else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, sf_dir, views, name):
    got = rows(queries.QUERIES[name](spark, sf_dir).toPandas())
    assert got == rows(views.sql(queries.ORACLES[name]).df()) and got[1]
