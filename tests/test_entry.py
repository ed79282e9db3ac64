from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from isoreach.plans.queries import QUERIES, SQL
from isoreach.streaming.demand import stream_access

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_access(stream, lambda d: d, lambda df, _: got.append(df.count()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sum(got) > 0 and Path(tmp_path / "ck").exists()
