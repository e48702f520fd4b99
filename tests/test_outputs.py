"""Queries whose columns can't be told apart, and halves that the queries' SQL rounds in its own way."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


def events(folder, users):
    """A table of events: for each user, 15 (time, kind, value) a second apart, or as given."""
    start = datetime.datetime(2024, 1, 15)
    rows = [(i, start + datetime.timedelta(seconds=s), u, kind, value) for i, (u, s, kind, value) in enumerate((u, *e) for u, es in users.items() for e in es)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY e TO '{folder}/events.parquet'")


def both(name, spark, folder):
    """Rows of a query and of its SQL over a folder's events."""
    entry.queries()[name](spark, str(folder)).write.parquet(f"file://{folder}/{name}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    theirs = con.execute(entry.oracle_sql()[name]).fetchall()
    listed = ", ".join(f'"{c[0]}"' for c in con.description)
    return sorted(con.execute(f"SELECT {listed} FROM '{folder}/{name}/*.parquet'").fetchall(), key=str), sorted(theirs, key=str)


def test_picture_replay_can_be_written(spark, sf_dir, tmp_path):
    rows = entry.queries()["picture_replay"](spark, sf_dir)
    assert len({c.lower() for c in rows.columns}) == len(rows.columns)
    rows.limit(3).write.parquet(f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


@pytest.mark.parametrize("name", ["module_findings", "window_history"])
def test_half_hundredths(name, spark, tmp_path):
    """A window that ends half a hundredth after an even one."""
    events(tmp_path, {1: [(k + 0.325 * (k == 14), "error", 80.0) for k in range(15)]})
    ours, theirs = both(name, spark, tmp_path)
    assert ours == theirs and "170527681433" in str(ours)


def test_risk_beyond_one(spark, tmp_path):
    """A replay score of 560 / 500 is the module's risk as it is."""
    events(tmp_path, {1: [(k, "view", 560.21 if k == 3 else 20.0) for k in range(15)]})
    ours, theirs = both("module_results", spark, tmp_path)
    assert ours == theirs and 1.12042 in [r[-2] for r in ours]


def test_half_percents(spark, tmp_path):
    """Windows of calibrated risk 0.445 and 0.285: 0.445 * 100 is a half, 0.285 * 100 just below one."""
    events(tmp_path, {u: [(k, "error" if k < bad else "view", value) for k in range(15)] for u, (bad, value) in enumerate([(2, 63.78841), (1, 71.23868), (2, 56.518955), (4, 39.626385), (1, 74.385154)])})
    ours, theirs = both("session_summaries", spark, tmp_path)
    assert ours == theirs and all(f"risk of {p}%" in str(ours) for p in (45, 28, 53))


def test_pictures_come_in_small_batches(spark, sf_dir):
    """Windows of 48 kB reach Python a few at a time, however many a partition has."""
    from tidemark.plans import signal_queries as Q

    pages = Q.page_pictures(spark, sf_dir)
    counted = pages.union(pages).union(pages).coalesce(1).select("page_id").mapInPandas(lambda batches: (b.iloc[:1].assign(page_id=len(b)) for b in batches), "page_id long")
    sizes = [r.page_id for r in counted.collect()]
    assert len(sizes) > 1 and max(sizes) <= Q.WINDOWS_A_BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_feathered_masks_are_made_once():
    from tidemark.operators import augment

    assert augment.feathered(64, 64) is augment.feathered(64, 64)


def test_words_of_few_pairs_at_a_time():
    """A large batch of word pairs takes little more memory than a small one."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.functions import edits

    def peak(n):
        words = pa.array([[f"{i}-{k}" for k in range(100)] for i in range(n)])
        tracemalloc.start()
        found = edits._distances.func(words, words)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.to_pylist() == [0] * n
        return most

    assert peak(4000) < 2 * peak(200)


@pytest.mark.parametrize("quality", [30, 95, 100])
def test_pictures_are_coded_by_arrays(quality):
    """The symbols of a picture are arrays, whose places grow in the order of the file."""
    import numpy as np

    from tidemark.operators import jpeg

    picture = np.random.default_rng(0).integers(0, 256, (40, 24, 3), np.uint8)
    first, rest = jpeg.tokens(jpeg.coefficients(jpeg.components(picture)[0], jpeg.tables(quality)[0]))
    assert isinstance(rest, np.ndarray) and len(np.unique(np.concatenate([first[:, 0], rest[:, 0]]))) == len(first) + len(rest)
