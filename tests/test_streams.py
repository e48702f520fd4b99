"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import explain, fusion
from tidemark.streaming import streams


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_stateful_verdicts_equal_batch(spark, folder):
    rows = spark.range(240).select((F.col("id") % 5).alias("key"), F.col("id").alias("n"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("probability"), F.when(F.col("id") % 31 == 0, F.array(F.lit("replay"))).otherwise(F.array().cast("array<string>")).alias("gates"))
    for k in range(3):  # files in order of time
        rows.filter(f"n >= {80 * k} AND n < {80 * k + 80}").coalesce(1).write.mode("append").parquet(folder("in"))
    stream = streams.read_events(spark, folder("in"), rows.schema)
    streams.drained(streams.verdicts(stream, "key", "n"), folder("out"), folder("state"))
    key = lambda df: sorted((r.key, r.n, round(r.smoothed, 9), r.category, r.action) for r in df.collect())
    assert key(spark.read.parquet(folder("out"))) == key(fusion.verdicts(rows, "key", "n"))


def test_emitted_findings_equal_batch(spark, folder):
    rows = spark.range(200).select((F.col("id") % 3).alias("key"), F.col("id").cast("double").alias("t"), F.lit(0).alias("place"), F.element_at(F.array(F.lit("face"), F.lit("lips")), (F.pmod(F.xxhash64("id"), F.lit(2)) + 1).cast("int")).alias("id"), F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, "high").otherwise("medium").alias("severity"))
    for k in range(2):
        rows.filter(f"t >= {100 * k} AND t < {100 * k + 100}").coalesce(1).write.mode("append").parquet(folder("in"))
    streams.drained(streams.emitted(streams.read_events(spark, folder("in"), rows.schema), "key", "t"), folder("out"), folder("state"))
    key = lambda df: sorted(map(tuple, df.select("key", "t", "id", "severity").collect()))
    assert key(spark.read.parquet(folder("out"))) == key(explain.deduplicated(rows, "key", "t"))


def test_late_rows_are_dropped(spark, folder):
    row = lambda t: (f"2024-01-01 {t}", "view", 1.0)
    make = lambda ts: spark.createDataFrame([row(t) for t in ts], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    batches = [["00:10:00", "00:20:00"], ["09:00:00"], ["00:30:00", "09:10:00"], ["23:00:00"]]
    schema = make(["00:00:00"]).schema
    for k, b in enumerate(batches):
        make(b).write.mode("append").parquet(folder("in"))
        out = streams.hopping(streams.read_events(spark, folder("in"), schema), "ts", "event_type", "value", "1 hour", "1 hour", "2 hours")
        streams.drained(out, folder("out"), folder("state"))
    got = {r.start.hour: r.n for r in spark.read.parquet(folder("out")).collect()}
    assert got[0] == 2 and got[9] == 2


def test_newest_wins(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("a", 2)], "key string, n int")
    kept, dropped = streams.newest_wins(rows, "key", "n")
    assert sorted(map(tuple, kept.collect())) == [("a", 3), ("b", 2)] and dropped.first().dropped == 2


def in_files(spark, folder, rows, order, files=3):
    """rows as a stream that reads a file a trigger, in order."""
    n = rows.count()
    for k in range(files):
        rows.filter((F.col(order) >= n * k // files) & (F.col(order) < n * (k + 1) // files)).coalesce(1).write.mode("append").parquet(folder("in"))
    return streams.read_events(spark, folder("in"), rows.schema)


def test_static_counter_equals_batch(spark, folder):
    from tidemark.operators.signals import frozen_count

    rows = spark.range(150).select((F.col("id") % 4).alias("key"), F.col("id").alias("n"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(5)) < 3).alias("still"))
    streams.drained(streams.static_counts(in_files(spark, folder, rows, "n"), "key", "n", "still"), folder("out"), folder("state"))
    key = lambda df: sorted((r.key, r.n, r.frozen) for r in df.collect())
    assert key(spark.read.parquet(folder("out"))) == key(frozen_count(rows, "key", "n", "still"))


def test_sessions_are_summed_up_at_their_end(spark, folder):
    rows = spark.range(90).select((F.col("id") % 3).alias("key"), F.col("id").alias("n"), (F.col("id") / 100.0).alias("risk"), ((F.col("id") == 60) | (F.col("id") == 88)).alias("ended"))
    streams.drained(streams.finished(in_files(spark, folder, rows, "n"), "key", "n", "risk", "ended"), folder("out"), folder("state"))
    got = {r.key: (r.windows, round(r.last_risk, 6), round(r.mean_risk, 6)) for r in spark.read.parquet(folder("out")).collect()}
    # Key 0 ends with the trigger that has row 60, so with that trigger's rows; key 2 never ends.
    assert got == {0: (30, 0.87, round(sum(range(0, 90, 3)) / 30 / 100, 6)), 1: (30, 0.88, round(sum(range(1, 90, 3)) / 30 / 100, 6))}


def test_known_values_reach_a_stream(spark, folder):
    rows = spark.range(30).select((F.col("id") % 3).alias("key"), F.col("id").alias("n"))
    known = spark.createDataFrame([(0, "front camera"), (1, "back camera")], "key long, label string")
    streams.drained(streams.with_known(in_files(spark, folder, rows, "n"), known, "key"), folder("out"), folder("state"))
    assert {(r.key, r.label) for r in spark.read.parquet(folder("out")).collect()} == {(0, "front camera"), (1, "back camera"), (2, None)}


def test_session_windows(spark, folder):
    rows = spark.createDataFrame([("a", 0), ("a", 50), ("a", 200), ("b", 10), ("a", 230), ("z", 90_000)], "key string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.filter(F.col("ts") < F.timestamp_seconds(F.lit(100))).coalesce(1).write.parquet(folder("in"))
    rows.filter(F.col("ts") >= F.timestamp_seconds(F.lit(100))).coalesce(1).write.mode("append").parquet(folder("in"))
    out = streams.sessions(streams.read_events(spark, folder("in"), rows.schema), "ts", "key", "1 minute", "10 minutes")
    streams.drained(out, folder("out"), folder("state"))
    got = {(r.key, int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in spark.read.parquet(folder("out")).collect()}
    assert got == {("a", 0, 110, 2), ("b", 10, 70, 1), ("a", 200, 290, 2)}


def test_idle_verdicts_are_forgotten(spark, folder):
    import time

    # Timeouts come with the next rows; with empty triggers too, a run over all there is would have no end.
    spark = spark.newSession()
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = spark.range(6).select(F.when(F.col("id") < 4, "idle").otherwise("late").alias("key"), F.col("id").alias("n"), F.lit(0.9).alias("probability"), F.array().cast("array<string>").alias("gates"))
    rows.filter("n < 4").coalesce(1).write.parquet(folder("in"))
    run = lambda: streams.drained(streams.verdicts(streams.read_events(spark, folder("in"), rows.schema), "key", "n", timeout_ms=200), folder("out"), folder("state"))
    run()
    time.sleep(1)
    rows.filter("n >= 4").coalesce(1).write.mode("append").parquet(folder("in"))
    run()
    # The idle key comes back with another window: its latch begins anew, so one high window doesn't latch.
    time.sleep(1)
    again = spark.createDataFrame([("idle", 9, 0.9, [])], rows.schema)
    again.coalesce(1).write.mode("append").parquet(folder("in"))
    run()
    got = {r.n: r.in_state for r in spark.read.parquet(folder("out")).collect()}
    assert got[1] and got[3] and not got[9]
