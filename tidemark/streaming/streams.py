"""The batch operators over streams: windows by event time, verdicts and findings with keyed state, newest-wins batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.explain import RANKS, Memory
from tidemark.operators.fusion import VERDICT, Latch
from tidemark.plans import params as P


def read_events(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def hopping(stream: DataFrame, time: str, key: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts and means of hopping windows; rows later than `late` behind the newest are dropped by the watermark."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, size, slide).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), key, "n", "mean_value")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "smooth double, high int, low int, latched boolean, acted boolean"


def verdicts(stream: DataFrame, key: str, order: str, timeout_ms: int | None = None) -> DataFrame:
    """The batch latch over a stream of scored windows: the same step, its state kept by key; idle keys are forgotten."""
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {order} {stream.schema[order].dataType.simpleString()}, {VERDICT}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latch = Latch(*state.get) if state.exists else Latch()
        # A trigger's rows of one key: as many as arrived since the last.
        rows = pd.concat(list(batches)).sort_values(order)
        found = [(k[0], n, *latch.step(p, list(g))) for n, p, g in zip(rows[order], rows["probability"], rows["gates"], strict=True)]
        state.update(latch.dump())
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(found, columns=[key, order, *[c.split()[0] for c in VERDICT.split(", ")]])

    return stream.groupBy(key).applyInPandasWithState(run, out, STATE, "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def emitted(stream: DataFrame, key: str, time: str, rearm: float = P.REARM_SEC) -> DataFrame:
    """Findings that are emitted, with each key's memory as state."""
    checks = "checks array<string>, ranks array<int>, times array<double>"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = Memory(rearm)
        if state.exists:
            memory.last = {c: (r, t) for c, r, t in zip(*state.get, strict=True)}
        rows = pd.concat(list(batches)).sort_values([time, "place"])
        keep = [memory.admits(c, RANKS.get(s, 1), t) for c, s, t in zip(rows["id"], rows["severity"], rows[time], strict=True)]
        state.update(([*memory.last], [r for r, _ in memory.last.values()], [float(t) for _, t in memory.last.values()]))
        yield rows[keep]

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, checks, "append", "NoTimeout")


def newest_wins(batch: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Of a micro-batch each key's newest row, and a one-row count of those dropped."""
    newest = batch.groupBy(key).agg(F.max(order).alias("newest"))
    rows = batch.join(newest, key)
    return rows.filter(F.col(order) == F.col("newest")).drop("newest"), rows.agg(F.count_if(F.col(order) < F.col("newest")).alias("dropped"))


def first_titles(stream: DataFrame, time: str, late: str) -> DataFrame:
    """The first finding of each (id, title) within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["id", "title"])


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all there is and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def static_counts(stream: DataFrame, key: str, order: str, static: str) -> DataFrame:
    """Each key's run counter of static windows as state: up by one when static, else down by one, never below 0; null changes nothing."""
    kind = lambda c: stream.schema[c].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(order)
        found = []
        for n, s in zip(rows[order], rows[static], strict=True):
            count = count if pd.isna(s) else count + 1 if s else max(0, count - 1)
            found.append((k[0], n, count))
        state.update((count,))
        yield pd.DataFrame(found, columns=[key, order, "frozen"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind(key)}, {order} {kind(order)}, frozen int", "frozen int", "append", "NoTimeout")


def finished(stream: DataFrame, key: str, order: str, risk: str, ended: str, timeout_ms: int | None = None) -> DataFrame:
    """One row a session at its end (a row that says `ended`, or no row for timeout_ms): its windows, last and mean risk."""
    kind = lambda c: stream.schema[c].dataType.simpleString()
    names = [key, "windows", "last_risk", "mean_risk"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, total, place = state.get if state.exists else (0, 0.0, 0.0, None)
        done = state.hasTimedOut
        if not done:
            rows = pd.concat(list(batches)).sort_values(order)
            known = rows[rows[risk].notna()]
            n, total = n + len(known), total + float(known[risk].sum())
            if len(known) and (place is None or known[order].iloc[-1] >= place):
                last, place = float(known[risk].iloc[-1]), float(known[order].iloc[-1])
            done = bool(rows[ended].fillna(False).astype(bool).any())
        if done:
            state.remove()
            yield pd.DataFrame([(k[0], n, last, total / n if n else 0.0)], columns=names)
            return
        state.update((n, last, total, place))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    out = f"{key} {kind(key)}, windows int, last_risk double, mean_risk double"
    return stream.groupBy(key).applyInPandasWithState(run, out, "n int, last double, total double, place double", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def with_known(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The stream with the columns of a table of what is known of each key (one row a key), as it stands at each trigger; without it they are null."""
    return stream.join(known, key, "left")
