"""Every query of the mapping library against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from entitylink import fixtures_sql


@pytest.fixture(scope="module")
def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(str(tuple(None if v is None or v != v else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(fixtures_sql.QUERIES))
def test_like_sql(spark, sf_dir, views, name):
    got = fixtures_sql.QUERIES[name](spark, sf_dir).toPandas()
    assert rows(got) == rows(views.sql(fixtures_sql.ORACLES[name]).df())
    assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(fixtures_sql.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


LONG_QUERIES = ["map_type_column", "map_id"]


@pytest.mark.parametrize("name", LONG_QUERIES)
def test_long_values_shared_by_many_rows_are_written_once(spark, sf_dir, tmp_path, name):
    """Equal ones stand together after the join.  By default they go plain from the first that the dictionary of 1 MB doesn't hold, with
    10,000 rows in memory where short ones stand before them."""
    for key in fixtures_sql.LONG_ROWS:
        spark.conf.unset(key)
    plan = fixtures_sql.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join(")
    long = "concat_ws(',', transform(sequence(1, 4000), x -> md5(concat(x, id div 100))))"  # 132 kB
    rows = spark.range(0, 2000, 1, 1).selectExpr("id", f"CASE WHEN id >= 1000 THEN {long} END AS ids")
    rows.write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 10_000_000
    assert spark.read.parquet(str(tmp_path / "out")).selectExpr("count(distinct ids)", "sum(length(ids))").head()[:] == (10, 1000 * (4000 * 33 - 1))


def test_settings_of_the_user_stay(spark):
    key = "parquet.page.size.row.check.max"
    spark.conf.set(key, "77")
    fixtures_sql.writes_long_rows(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
