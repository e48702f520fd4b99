"""Live windows and the overload queue: streams equal the batch operators and plain simulations, for any cut into triggers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.streaming import live, streams


@pytest.fixture
def own(spark):
    session = live.stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def frames(spark, n):
    return spark.range(n).select((F.col("id") % 3 * F.col("id") % 5).alias("key"), F.col("id").alias("frame"), (F.col("id") / 15).alias("ts"))


def put(rows, low, high, path):
    rows.filter((F.col("frame") >= low) & (F.col("frame") < high)).coalesce(1).write.mode("append").parquet(path)


def run(own, rows, folder, **more):
    stream = streams.read_events(own, folder("in"), rows.schema)
    streams.drained(live.live_windows(stream, "key", ["ts"], ["frame"], **more), folder("out"), folder("state"))


def test_live_windows_equal_batch_over_restarts(spark, own, folder):
    rows = frames(spark, 900)
    cuts = [0, 1, 40, 333, 334, 700, 900]
    for low, high in zip(cuts, cuts[1:]):
        put(rows, low, high, folder("in"))
        if low % 2:  # a restart after some of the files
            run(own, rows, folder)
    run(own, rows, folder)
    got = {(r.key, r.window_id): r.frame for r in own.read.parquet(folder("out")).collect()}
    want = W.window_arrays(W.count_windows(rows, "key", ["ts"]), "key", ["frame"]).collect()
    assert got == {(r.key, r.window_id): r.frame for r in want} and len(got) > 20
    ring = live.ring_rows(own, folder("state"))
    assert all(r["count"] <= live.RETAINED for r in ring.groupBy("key").count().collect())
    kept = lambda w: sorted((r.key, r.window_id, r.frame) for r in W.window_arrays(w, "key", ["frame"]).collect())
    assert kept(W.count_windows(ring, "key", ["ts"])) == kept(W.count_windows(rows, "key", ["ts"], retain=live.RETAINED))


def test_twenty_seconds_give_eighteen_live_windows(spark, own, folder):
    rows = spark.range(300).select(F.lit("s").alias("key"), F.col("id").alias("frame"), (F.col("id") / 15).alias("ts"))
    put(rows, 0, 300, folder("in"))
    run(own, rows, folder)
    out = own.read.parquet(folder("out")).orderBy("window_id").collect()
    assert [r.window_id for r in out] == list(range(1, 19)) and all(r.frame[0] == 15 * (r.window_id - 1) and len(r.ts) == 45 for r in out)
    assert live.ring_rows(own, folder("state")).count() == 75
    with pytest.raises(ValueError):
        live.live_windows(own.readStream.schema(rows.schema).parquet(folder("in")), "key", ["ts"], ["frame"], retain=44)


def test_idle_keys_are_forgotten(spark, own, folder):
    rows = spark.range(60).select(F.when(F.col("id") < 40, "idle").otherwise("late").alias("key"), F.col("id").alias("frame"), F.col("id").cast("double").alias("ts"))
    put(rows, 0, 40, folder("in"))
    run(own, rows, folder, idle_ms=300)
    time.sleep(1)
    put(rows, 40, 60, folder("in"))
    run(own, rows, folder, idle_ms=300)
    assert {r.key for r in live.ring_rows(own, folder("state")).collect()} <= {"late"}


def simulated(rows, capacity):
    """Fates of (at, cost, name) rows of one key."""
    waiting, free, drops, fates = [], float("-inf"), 0, {}
    for at, cost, name in rows:
        while waiting and (cost is None or free <= at):
            a, c, n = waiting.pop(0)
            fates[n] = ("taken", max(a, free), drops)
            free = max(a, free) + c
        if cost is None:
            continue
        if len(waiting) == capacity:
            drops += 1
            fates[waiting.pop(0)[2]] = ("dropped", None, drops)
        waiting.append((at, cost, name))
    return fates


@pytest.mark.parametrize("cuts", [[0, 240], [0, 1, 2, 77, 78, 200, 240]])
def test_queue_equals_a_simulation(spark, own, folder, cuts):
    r = random.Random(4)
    rows, clock = [], {0: 0.0, 1: 0.0, 2: 0.0}
    for i in range(237):
        key = i % 3
        clock[key] += r.choice((0.5, 1.0, 1.0, 3.0))
        rows.append((key, clock[key], r.choice((0.25, 1.0, 2.5)) if key else 2.0, i))
    rows += [(k, clock[k] + 1, None, 237 + k) for k in range(3)]
    frame = spark.createDataFrame(rows, "key long, at double, cost double, frame long")
    for low, high in zip(cuts, cuts[1:]):
        put(frame, low, high, folder("in"))
    stream = streams.read_events(own, folder("in"), frame.schema)
    streams.drained(live.bounded_queue(stream, "key", "at", "cost", "frame", 2), folder("out"), folder("state"))
    got = {x.frame: (x.outcome, x.started_at, x.dropped) for x in own.read.parquet(folder("out")).collect()}
    want = {}
    for k in range(3):
        want |= simulated([x[1:] for x in rows if x[0] == k], 2)
    assert got == want and sum(f[0] == "dropped" for f in want.values()) > 20 and len(want) == 237


def test_metrics_need_no_second_pass(spark, own, folder):
    from tidemark.streaming import metrics

    rows = frames(spark, 500).withColumn("ms", (F.col("frame") % 7).cast("double"))
    exprs = metrics.measures({"odd": F.col("frame") % 2 == 1}, {"newest": F.col("frame")}, {"ms": (F.col("ms"), [0.5, 3.0])})
    want = {"odd": 250, "ms_bucket__0.5": 72, "ms_bucket__3.0": 287, "ms_bucket__+Inf": 500, "ms_sum": rows.agg(F.sum("ms")).first()[0]}

    batch = metrics.Meter()
    seen, taken = batch.observed(rows, "batch", exprs)
    seen.write.format("noop").mode("overwrite").save()
    batch.take(taken)
    assert {f"{n}__{b}" if b else n: v for k, n, b, v in batch.rows() if k == "counter"} == want and batch.gauges["newest"] == 499
    assert 'ms_bucket{le="3.0"} 287\n' in batch.exposed()

    for low in range(0, 500, 125):
        put(rows, low, low + 125, folder("in"))
    meter = metrics.Meter()
    own.streams.addListener(meter)
    stream = streams.read_events(own, folder("in"), rows.schema).observe("rows", *exprs)
    out = stream.withColumn("at", F.timestamp_seconds(F.col("ts"))).withWatermark("at", "1 hour").groupBy("key").count()
    out.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder("state")).trigger(availableNow=True).start().awaitTermination()
    assert meter.ended()
    own.streams.removeListener(meter)
    assert {f"{n}__{b}" if b else n: v for k, n, b, v in meter.rows() if k == "counter"} == want | {"stream_rows": 500}
    assert meter.gauges["newest"] == 499 and meter.gauges["stream_state_rows"] > 0 and meter.gauges["active_streams"] == 0 and meter.gauges["stream_lag_seconds"] > 1e9

    class Told:  # a trigger that is told again counts once
        class progress:
            id, batchId, numInputRows, observedMetrics, eventTime, durationMs, stateOperators = next(iter(meter.seen)), 0, 125, {}, {}, {}, []

    meter.onQueryProgress(Told)
    assert meter.counters["stream_rows"] == 500
