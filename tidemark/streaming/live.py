"""Live windows and their overload queue as keyed state: a ring of the newest rows, and a bounded queue that drops its oldest.

State is kept by `transformWithState` in RocksDB, so it is on disk, survives restarts from a checkpoint and costs a key its
ring or queue and two numbers, however many rows have passed. Rows of one trigger are taken in their order; rows of a later
trigger come after them, as they do in a buffer that frames are appended to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.plans import params as P

STORE = "spark.sql.streaming.stateStore"
#: Rows a key that the ring keeps.
RETAINED = 75


def stateful_session(spark: SparkSession, empty_triggers: bool = False) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB; state partitions are as many as spark has shuffle partitions.

    empty_triggers: timers fire without new rows too. A stream with timers then has no end, so it isn't for runs over all there is.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(f"{STORE}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set(f"{STORE}.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set(f"{STORE}.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_triggers).lower())
    return own


def table_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The files of a Parquet table (a folder or a single file) as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable")


class IdleKeys(StatefulProcessor):
    """Forgets a key that had no row for idle_ms of processing time."""

    idle_ms: int | None = None

    def untimed(self) -> None:
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)

    def touched(self, times) -> None:
        self.untimed()
        if self.idle_ms:
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.idle_ms)


class Windows(IdleKeys):
    def __init__(self, key: str, order: list[str], row: StructType, size: int, stride: int, retain: int, idle_ms: int | None):
        self.key, self.order, self.row, self.size, self.stride, self.retain, self.idle_ms = key, order, row, size, stride, retain, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", self.row)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues):
        names = self.row.names
        ring = list(self.ring.get())
        seen = self.seen.get()[0] if self.seen.exists() else 0
        found = []
        for row in in_order(rows, self.order)[names].itertuples(index=False, name=None):
            ring.append(row)
            seen += 1
            if seen >= self.size and (seen - self.size) % self.stride == 0:
                window = list(zip(*ring[-self.size :], strict=True))
                found.append((key[0], (seen - self.size) // self.stride + 1, *map(list, window)))
            if len(ring) > 2 * self.retain:
                del ring[: -self.retain]
        self.ring.put(ring[-self.retain :])
        self.seen.update((seen,))
        self.touched(timerValues)
        if found:
            yield pd.DataFrame(found, columns=[self.key, "window_id", *names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.ring.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_windows(
    stream: DataFrame, key: str, order: list[str], values: list[str], size: int = P.WINDOW_FRAMES, stride: int = P.STRIDE_FRAMES, retain: int = RETAINED, idle_ms: int | None = None
) -> DataFrame:
    """Each window of a key's newest `size` rows as soon as it is complete, then one every `stride` rows.

    One row a window: key, window_id (from 1) and an array for each column of order and values. No window comes before
    `size` rows have. The ring keeps the newest `retain` rows (at least `size`); `ring_rows` reads it.
    """
    if retain < size:
        raise ValueError("the ring has to hold a window")
    row = StructType([StructField(n, stream.schema[n].dataType) for n in dict.fromkeys([*order, *values])])
    out = StructType([stream.schema[key], *StructType.fromDDL("window_id long"), *[StructField(f.name, ArrayType(f.dataType)) for f in row]])
    processor = Windows(key, order, row, size, stride, retain, idle_ms)
    return stream.select(key, *row.names).groupBy(key).transformWithStateInPandas(processor, out, "append", "ProcessingTime" if idle_ms else "None")


def ring_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that the rings of a live_windows stream hold at its checkpoint, with their key."""
    held = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return held.select("key.*", "list_element.*")


class Queue(IdleKeys):
    def __init__(self, key: str, at: str, cost: str, name: str, capacity: int, idle_ms: int | None):
        self.key, self.at, self.cost, self.name, self.capacity, self.idle_ms = key, at, cost, name, capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, cost double, name long")
        self.server = handle.getValueState("server", "free_at double, dropped long")

    def handleInputRows(self, key, rows, timerValues):
        waiting = [tuple(r) for r in self.waiting.get()]
        free_at, dropped = self.server.get() if self.server.exists() else (float("-inf"), 0)
        found = []

        def take() -> float:
            at, cost, name = waiting.pop(0)
            start = max(at, free_at)
            found.append((key[0], name, at, "taken", start, dropped))
            return start + cost

        for at, cost, name in in_order(rows, [self.at, self.name])[[self.at, self.cost, self.name]].itertuples(index=False, name=None):
            over = pd.isna(cost)
            while waiting and (over or free_at <= at):
                free_at = take()
            if over:
                continue
            if len(waiting) == self.capacity:
                dropped += 1
                old = waiting.pop(0)
                found.append((key[0], old[2], old[0], "dropped", None, dropped))
            waiting.append((at, cost, name))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.server.update((free_at, dropped))
        self.touched(timerValues)
        if found:
            yield self.frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """What still waits is taken, late as it is; then the key is forgotten."""
        free_at, dropped = self.server.get() if self.server.exists() else (float("-inf"), 0)
        found = []
        for at, cost, name in self.waiting.get():
            start = max(at, free_at)
            found.append((key[0], name, at, "taken", start, dropped))
            free_at = start + cost
        self.waiting.clear()
        self.server.clear()
        if found:
            yield self.frame(found)

    def frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[self.key, self.name, self.at, "outcome", "started_at", "dropped"]).astype({"started_at": "float64"})

    def close(self) -> None:
        pass


def bounded_queue(stream: DataFrame, key: str, at: str, cost: str, name: str, capacity: int = P.QUEUE_CAPACITY, idle_ms: int | None = None) -> DataFrame:
    """What a consumer that needs `cost` seconds a row takes from a queue of `capacity` rows that drops its oldest when full.

    Rows (name long) come at `at` (seconds, in order); one that finds the consumer free is taken at once. Each row comes out
    once, when its fate is known: outcome taken, with started_at, or dropped; `dropped` counts the key's drops so far. A row
    with a null cost ends a session: what waits is taken. How rows are cut into triggers makes no difference.
    """
    rows = stream.select(key, F.col(at).cast("double").alias(at), F.col(cost).cast("double").alias(cost), F.col(name).cast("long").alias(name))
    out = StructType([stream.schema[key], *StructType.fromDDL(f"{name} long, {at} double, outcome string, started_at double, dropped long")])
    return rows.groupBy(key).transformWithStateInPandas(Queue(key, at, cost, name, capacity, idle_ms), out, "append", "ProcessingTime" if idle_ms else "None")
