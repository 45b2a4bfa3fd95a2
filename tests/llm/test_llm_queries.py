"""Registered corpus queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

queries = pytest.importorskip("vecengine.llm.queries")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    ours, theirs = queries.QUERIES[name](spark, DIR).toPandas(), db.execute(queries.ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(frame):
        return sorted(map(tuple, frame[columns].astype(str).to_numpy().tolist()))

    assert rows(ours) == rows(theirs)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
