"""Joins by interval, by band with the nearest row as fallback, by segment, and keyed merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import params as P


def interval_join(windows: DataFrame, points: DataFrame, key: str, margin_sec: float = 1.0, cell_sec: float | None = None) -> DataFrame:
    """Each window with the sorted ids of the key's points whose time is within the window and its margin, or is missing or 0.

    windows: key, window_id, t_start, t_end (s); points: key, seq, t0 (ms). Time is cut into cells (as long as the mean
    window with its margins, if not told): a window meets the cells that it reaches and a point is in one, so a key's
    points don't meet all its windows. Timeless points belong to all windows of a key and go a list a key.
    """
    if cell_sec is None:
        cell_sec = max(1e-3, (windows.agg(F.avg(F.col("t_end") - F.col("t_start"))).first()[0] or 0.0) + 2 * margin_sec)
    cell = lambda at: F.floor(at / F.lit(cell_sec))
    low, high = F.col("t_start") - margin_sec, F.col("t_end") + margin_sec
    timeless = F.col("t0").isNull() | (F.col("t0") == 0)
    always = points.filter(timeless).groupBy(key).agg(F.collect_list("seq").alias("always"))
    timed = points.filter(~timeless).select(key, "seq", (F.col("t0") / F.lit(1000.0)).alias("point at")).withColumn("cell", cell(F.col("point at")))
    spread = windows.filter(low <= high).select(key, "window_id", low.alias("low"), high.alias("high"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    near = spread.join(timed, [key, "cell"]).filter(F.col("point at").between(F.col("low"), F.col("high")))
    near = near.groupBy(key, "window_id").agg(F.collect_list("seq").alias("near"))
    rows = windows.select(key, "window_id").distinct().join(near, [key, "window_id"], "left").join(always, key, "left")
    return rows.select(key, "window_id", F.array_sort(F.flatten(F.array_compact(F.array("near", "always")))).alias("found"))


def band_join_nearest(left: DataFrame, right: DataFrame, key: str, band: float) -> DataFrame:
    """For each row of left(key, id, at) the least `value` of right(key, place, at, value) within the band, else that of the nearest.

    Both sides are cut into cells as wide as the band; a row meets its cell and the two beside it. The nearest row of
    those without any comes from the last one before and the first one after, by ordered windows.
    """
    cell = F.floor(F.col("at") / band)
    cells = left.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("l")
    r = right.withColumn("cell", cell).alias("r")
    met = cells.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.cell") == F.col("r.cell")) & (F.abs(F.col("l.at") - F.col("r.at")) <= band))
    inside = met.groupBy(F.col(f"l.{key}").alias(key), F.col("l.id").alias("id")).agg(F.min("r.value").alias("least"), F.count("*").alias("hits"))
    none = F.lit(None)
    both = left.select(key, "at", F.lit(1).alias("side"), "id", none.cast("long").alias("place"), none.cast("double").alias("value"))
    both = both.unionByName(right.select(key, "at", F.lit(0).alias("side"), none.cast("long").alias("id"), "place", "value"))
    row = F.when(F.col("side") == 0, F.struct("at", "place", "value"))
    # Of equal distances the smallest place counts: among equal times before, the first placed one.
    before = Window.partitionBy(key).orderBy("at", "side", F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("at", F.desc("side"), "place").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("before", F.last(row, True).over(before)).withColumn("after", F.first(row, True).over(after)).filter("side = 1")
    d0, d1 = F.col("at") - F.col("before.at"), F.col("after.at") - F.col("at")
    first = F.col("after").isNull() | (d0 < d1) | ((d0 == d1) & (F.col("before.place") <= F.col("after.place")))
    nearest = F.when(F.col("before").isNotNull() & first, F.col("before.value")).otherwise(F.col("after.value"))
    out = both.select(key, "id", nearest.alias("nearest")).join(inside, [key, "id"], "left")
    return out.select(key, "id", F.coalesce("least", "nearest").alias("value"), F.coalesce("hits", F.lit(0)).alias("hits"))


def calibrated(logit: Column, knots: list[tuple[float, float]] = P.KNOTS) -> Column:
    """Straight lines between knots, level beyond them; of shared knots the earlier segment."""
    out = F.when(logit <= knots[0][0], knots[0][1]).when(logit >= knots[-1][0], knots[-1][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(logit <= x1, y0 + (logit - x0) / (x1 - x0) * (y1 - y0))
    return F.when(logit.isNotNull(), out)


def merge_features(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of features(keys, seq, feature, value): of a repeated feature the last part that has it counts; a map a key."""
    rows = reduce(DataFrame.unionByName, [p.select(*keys, F.lit(i).alias("part"), "feature", "value") for i, p in enumerate(parts)])
    last = rows.groupBy(*keys, "feature").agg(F.max_by("value", "part").alias("value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias("features"))


def consecutive(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the columns of the row before, as prev_<name>; first rows go."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns], F.row_number().over(w).alias("step"))
    return out.filter("step > 1").drop("step")
