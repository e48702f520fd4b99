"""Series of vectors: change from one to the next, covariance, distance from the usual, attention pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import columns as C
from tidemark.operators import moments as M
from tidemark.operators.joins import consecutive

FLICKER_LEAST, FLICKER_SPREAD, JUMP = 0.60, 0.15, 0.65
JITTER_MOST = 0.08


def similarities(rows: DataFrame, series: str, order: str, vector: str) -> DataFrame:
    pairs = consecutive(rows.withColumn(vector, F.col(vector).cast("array<double>")), series, [order], [vector])
    return pairs.select(series, order, C.cosine(F.col(vector), F.col(f"prev_{vector}")).alias("similarity"))


def flicker(rows: DataFrame, series: str, order: str, vector: str) -> DataFrame:
    """Least, mean and spread of consecutive similarity, jumps, the flag and the score of each series."""
    s = similarities(rows, series, order, vector).groupBy(series)
    out = s.agg(F.min("similarity").alias("least"), F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("spread"), F.count_if(F.col("similarity") < JUMP).alias("jumps"))
    flag = (F.col("least") < FLICKER_LEAST) | (F.col("spread") > FLICKER_SPREAD) | (F.col("jumps") >= 2)
    return out.withColumn("flickers", flag).withColumn("score", C.clip(0.6 * F.greatest(F.lit(0.0), 1 - F.col("least")), 0, 1))


def jitter(points: DataFrame, series: str, frame: str) -> DataFrame:
    """Mean length of second differences over time of points(series, frame, point, x, y)."""
    from tidemark.operators.windows import ordered

    w = ordered([series, "point"], frame)
    second = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    moved = points.select(series, second("x").alias("dx"), second("y").alias("dy")).filter("dx IS NOT NULL")
    return moved.groupBy(series).agg(F.avg(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("jitter")).withColumn("jitters", F.col("jitter") > JITTER_MOST)


def long_form(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def whole_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have `width` parts and no null among them, and those vectors."""
    column = column.cast(pa.list_(pa.float64()))
    some = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    good = ~np.isnan(values).any(1)
    return at[good], values[good]


def moments(rows: DataFrame, vector: str, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance of a column of vectors, of `width` parts or as many as the longest has, in one pass.

    Vectors of another width or with nulls take no part; without two that do there is an error. One state comes to the driver.
    """
    found = M.state(M.states_of(rows, vector), width)
    if found is None or found[0] < 2:
        raise ValueError(f"{found[0] if found else 0} rows of {vector} have {width} parts: no covariance")
    return found[1], M.covariance(found)


def novelty(rows: DataFrame, key: str, vector: str, width: int | None = None, ridge: float = 1e-4, fitted: M.Moments | None = None) -> DataFrame:
    """Mahalanobis distance of each vector from the mean of all, or of a stored state; null for vectors that take no part in it."""
    mean, cov = moments(rows, vector, width) if fitted is None else (fitted[1], M.covariance(fitted))
    precision = np.linalg.pinv(cov + ridge * np.eye(len(mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_vectors(batch.column(1), len(mean))
            d = x - mean
            distance = np.full(batch.num_rows, np.nan)
            distance[at] = np.sqrt(np.maximum(0.0, ((d @ precision) * d).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance, from_pandas=True)], names=[key, "distance"])

    rows = rows.select(key, vector)
    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("distance", DoubleType())]))


def attention_pool(rows: DataFrame, series: str, vector: str, logit: F.Column) -> DataFrame:
    """Mean and deviation of each dimension of a series, rows weighed by the softmax of `logit`."""
    rows = rows.select(series, vector, logit.alias("logit"))
    top = rows.groupBy(series).agg(F.max("logit").alias("top"))
    weighed = rows.join(top, series).select(series, F.exp(F.col("logit") - F.col("top")).alias("w"), F.posexplode(F.col(vector)).alias("dim", "x"))
    m = weighed.groupBy(series, "dim").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"))
    mean = F.col("sx") / F.col("s")
    return m.select(series, "dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("sxx") / F.col("s") - mean * mean, F.lit(0.0)) + 1e-6).alias("deviation"))
