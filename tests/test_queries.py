"""Every query with an SQL equivalent against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck, tmp_path):
    entry.queries()[name](spark, sf_dir).write.parquet(f"file://{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE VIEW ours AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE VIEW theirs AS {entry.oracle_sql()[name]}")
    columns = sorted(r[0] for r in duck.execute("DESCRIBE theirs").fetchall())
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE ours").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
