"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_every_chunk_has_a_window(spark):
    from pyspark.sql import functions as F

    out = QUERIES["p19_slice_pcm"](spark, SF).collect()
    chunks = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("label").cast("long"), "vec_id").collect()
    assert sorted((r.title_id, r.seq) for r in out) == sorted(map(tuple, chunks)) and {r.n for r in out} == {320}


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
