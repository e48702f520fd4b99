"""Sliding windows by count and by time, and ordered functions over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import params as P


def ordered(key: str | list[str], *order: str):
    return Window.partitionBy(key).orderBy(*order)


def count_windows(rows: DataFrame, key: str, order: list[str], size: int = P.WINDOW_FRAMES, stride: int = P.STRIDE_FRAMES, retain: int | None = None) -> DataFrame:
    """A row for each row and each complete window of `size` rows that it is in; windows start every `stride` rows.

    Adds `rn` (from 0), `window_id` (from 1) and `place` (from 0). retain keeps the newest rows of a key alone, as a
    bounded buffer would.
    """
    rows = rows.withColumn("rn", F.row_number().over(ordered(key, *order)) - 1).withColumn("n_rows", F.count("*").over(Window.partitionBy(key)))
    if retain is not None:
        rows = rows.withColumn("rn", F.col("rn") - F.greatest(F.col("n_rows") - retain, F.lit(0))).filter("rn >= 0").withColumn("n_rows", F.least("n_rows", F.lit(retain)))
    first = F.greatest(F.floor((F.col("rn") - size + stride) / stride), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("rn") / stride), F.floor((F.col("n_rows") - size) / stride)).cast("int")
    rows = rows.filter((F.col("n_rows") >= size) & (first <= last))
    rows = rows.withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.withColumn("place", F.col("rn") - F.col("window_id") * stride).withColumn("window_id", F.col("window_id") + 1).drop("n_rows")


def window_arrays(windows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row a window with an array for each of `values`, in order; a window is as long as it was asked to be."""
    rows = windows.groupBy(key, "window_id").agg(F.array_sort(F.collect_list(F.struct("place", *values))).alias("rows"))
    return rows.select(key, "window_id", *[F.col("rows")[v].alias(v) for v in values])


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, numbered from the newest."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)


def differences(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First and central second difference of `value`."""
    w, x = ordered(key, *order), F.col(value)
    return rows.withColumn("first_difference", x - F.lag(x).over(w)).withColumn("second_difference", F.lead(x).over(w) - 2 * x + F.lag(x).over(w))


def centred(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.withColumn("centred", F.col(value) - F.avg(value).over(Window.partitionBy(key)))


def carried(rows: DataFrame, key: str, order: list[str], value: str, every: int = 3) -> DataFrame:
    """`value` as taken at the first and at every `every`-th row, carried on to the rows between."""
    w = ordered(key, *order)
    n = F.row_number().over(w)
    rows = rows.withColumn("step", n).withColumn("taken", F.when((F.col("step") == 1) | (F.col("step") % every == 0), F.col(value)))
    return rows.withColumn("carried", F.last_value("taken", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("taken")


def sessions_by_gap(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def best_lag(correlations: Column) -> Column:
    """The lag of the highest correlation, the first of equals."""
    known = F.filter(correlations, lambda c: c["corr"].isNotNull())
    return F.reduce(known, F.lit(None).cast("struct<lag:int,corr:double>"), lambda best, c: F.when(best.isNull() | (c["corr"] > best["corr"]), c).otherwise(best))
