"""Stored moments of vectors: a mergeable state (count, mean, sums of products around the mean) kept as a table of versions.

A task makes the state of its rows in one pass, batch by batch; states merge pairwise, on the cluster, until one is left.
Nothing is subtracted that was large before, so neither the order nor an offset of the data matters beyond rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.io import committed

STATE = "width int, n long, mean array<double>, products array<double>"
#: States that one task merges.
FAN_IN = 64

Moments = tuple[int, np.ndarray, np.ndarray]


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """The state of two sets of rows from the states of each."""
    if a is None or b is None or not a[0] or not b[0]:
        return a if b is None or not b[0] else b
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def of_rows(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    c = x - mean
    return len(x), mean, c.T @ c


def _batch(states: dict[int, Moments]) -> pa.RecordBatch:
    columns = [pa.array([*states], pa.int32()), pa.array([s[0] for s in states.values()], pa.int64())]
    columns += [pa.array([s[i].ravel() for s in states.values()], pa.list_(pa.float64())) for i in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, ["width", "n", "mean", "products"])


def _states(batch: pa.RecordBatch) -> Iterator[tuple[int, Moments]]:
    for r in batch.select(["width", "n", "mean", "products"]).to_pylist():
        yield r["width"], (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(r["width"], r["width"]))


def folded(states: DataFrame) -> DataFrame:
    """One state for each width, by merging FAN_IN at a time."""
    parts = states.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, Moments] = {}
            for batch in batches:
                for width, state in _states(batch):
                    found[width] = merged(found.get(width), state)
            if found:
                yield _batch(found)

        states = states.coalesce(parts).mapInArrow(run, STATE)
        if parts == 1:
            return states


def states_of(rows: DataFrame, vector: str) -> DataFrame:
    """STATE of each width among the vectors without nulls and NaN, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for width in set(sizes.tolist()) - {0}:
                flat = column.take(pa.array(np.flatnonzero(sizes == width))).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                flat = flat[~np.isnan(flat).any(1)]
                if len(flat):
                    found[width] = merged(found.get(width), of_rows(flat))
        if found:
            yield _batch(found)

    return folded(rows.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, STATE))


def state(states: DataFrame, width: int | None = None) -> Moments | None:
    """The state of one width (the largest, if not told) on the driver: width x width numbers."""
    row = (states if width is None else states.filter(F.col("width") == width)).orderBy(F.desc("width")).first()
    return None if row is None else (row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(row["width"], row["width"]))


def covariance(found: Moments) -> np.ndarray:
    """Sample covariance."""
    return found[2] / (found[0] - 1)


def update(spark: SparkSession, path: str, rows: DataFrame, vector: str, version: int) -> bool:
    """Write version `version` of the stored state: the one before it merged with new rows. False if it is there already.

    Versions count from 1. The new one is written aside and renamed, so a version is there whole or not at all.
    """

    def write(folder: str) -> None:
        fresh = states_of(rows, vector)
        both = fresh if version == 1 else fresh.unionByName(stored(spark, path, version - 1))
        folded(both).write.mode("overwrite").partitionBy("width").parquet(folder)

    return committed(spark, path, "moments", version, write)


def stored(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/batch=moments-{version}").select(*[c.split()[0] for c in STATE.split(", ")])
