"""Every registered query with SQL against that SQL, on the smallest tables, and rows of all the others."""

import math

import duckdb
import pytest

from lanternfish.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.5f}".replace("-0.00000", "0.00000") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, small, duck, name):
    frame = registry.QUERIES[name](spark, small)
    names = sorted(frame.columns)
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(relation.columns) == names
    got = sorted(tuple(shown(r[c]) for c in names) for r in frame.collect())
    want = sorted(tuple(shown(r[relation.columns.index(c)]) for c in names) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_gives_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streams_over_several_files(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_watermark", "stream_dedupe"):  # every file spans the whole time
        found, want = (sorted(map(tuple, registry.QUERIES[name](spark, d).collect())) for d in (str(tmp_path), small))
        assert found == want and found
