import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from vecengine.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in ("embeddings", "lineitem", "events"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), db.execute(ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(frame):
        return sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))

    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
