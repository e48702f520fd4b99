"""Aggregates over groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.windows import ordered
from tidemark.plans import params as P


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where either column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def weighted_mean(channels: list[tuple[str, float]]) -> Column:
    """Mean of columns by weight; weights of null columns go to the others."""
    have = [(C.number(F.col(c)), F.lit(w)) for c, w in channels]
    total = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in have), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(x, F.lit(0.0)) * w for x, w in have), F.lit(0.0)), total)


def interval_statistics(rows: DataFrame, key: str, time_ms: Column, order: list[str]) -> DataFrame:
    """Intervals between a key's rows: count, population deviation, median, share of long ones, and flags."""
    gaps = rows.withColumn("gap", time_ms - F.lag(time_ms).over(ordered(key, *order))).filter("gap is not null")
    middle = gaps.groupBy(key).agg(F.count("*").alias("n"), F.stddev_pop("gap").alias("std_ms"), F.median("gap").alias("median_ms"))
    middle = middle.filter(F.col("n") >= P.LEAST_INTERVALS)
    long = gaps.join(middle.select(key, "median_ms"), key).groupBy(key).agg(F.avg((F.col("gap") > P.DROP_FACTOR * F.col("median_ms")).cast("double")).alias("drop_ratio"))
    out = middle.join(long, key)
    return out.withColumn("too_smooth", F.col("std_ms") < P.TOO_SMOOTH_STD_MS).withColumn("drops", F.col("drop_ratio") > P.DROP_HIGH)


def bucket_counts(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, then all."""
    counts = rows.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("c")).select("c.*")


def envelope(rows: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """Root mean square of each run of `size` rows."""
    rows = rows.withColumn("bucket", F.floor((F.row_number().over(ordered(key, *order)) - 1) / size))
    return rows.groupBy(key, "bucket").agg(F.sqrt(F.avg(F.col(value) * F.col(value)) + F.lit(1e-6)).alias("rms"), F.count("*").alias("n"))


def plane_fit(rows: DataFrame, key: str, x: str, y: str, z: str) -> DataFrame:
    """Least squares plane z = a x + b y + c of each group by centred normal equations, and its R squared."""
    m = rows.groupBy(key).agg(
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.var_pop(z).alias("zz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"), F.count("*").alias("n")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    m = m.withColumn("a", F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det)).withColumn("b", F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det))
    left = F.col("zz") - F.col("a") * F.col("xz") - F.col("b") * F.col("yz")
    return m.select(key, "n", "a", "b", (1 - left / (F.col("zz") + 1e-6)).alias("r2"))


def centroid(rows: DataFrame, key: str, x: Column, y: Column, mass: Column, least: float = 15.0) -> DataFrame:
    """Centre of mass of each group whose mass is over `least`."""
    m = rows.groupBy(key).agg(F.sum(mass).alias("m00"), F.sum(mass * x).alias("m10"), F.sum(mass * y).alias("m01"))
    return m.filter(F.col("m00") > least).select(key, "m00", (F.col("m10") / F.col("m00")).alias("cx"), (F.col("m01") / F.col("m00")).alias("cy"))


def first_maximum(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """The highest value of each key and its smallest place."""
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p"))).alias("b"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.p")).alias(place))
