"""Evaluation of scores against labels: ROC by row and by score, AUC, EER, calibration error, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.io import staged


def running_totals(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Running sums over the whole of rows in a global order without one task for all.

    Rows are dealt by ranges of the order (as many as the session has shuffle partitions, if not told); each range's own
    sums come from a window within it, and the sums of the ranges before from a table with one row a range. The ranges
    are written before both uses: dealt twice, they could get other bounds, which are sampled.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("part").agg(*[F.sum(v).alias(f"own_{k}") for k, v in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sums])
    out = ranged.withColumns({f"own_{k}": F.sum(v).over(own) for k, v in sums.items()}).join(F.broadcast(totals), "part")  # `parts` rows
    return out.withColumns({k: F.col(f"own_{k}") + F.col(f"before_{k}") for k in sums}).drop("part", *[f"{x}_{k}" for x in ("own", "before") for k in sums])


def roc_points(rows: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """A point for each row in descending order of score: seq, fpr and tpr to 4 places. With one class there are none."""
    order = [F.desc(score), F.asc(tie)]
    sums = {"seq": F.lit(1), "tp": F.col(label).cast("long"), "fp": 1 - F.col(label).cast("long")}
    run = running_totals(rows.select(score, label, tie), order, sums)
    totals = rows.agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    run = run.crossJoin(F.broadcast(totals)).filter("p > 0 AND n > 0")  # one row
    return run.select("seq", score, label, tie, F.bround(F.col("fp") / F.col("n"), 4).alias("fpr"), F.bround(F.col("tp") / F.col("p"), 4).alias("tpr"))


def auc_eer(points: DataFrame) -> DataFrame:
    """Trapezoid area from (0, 0) over the points and the error rate where false positives and negatives are nearest."""
    prev = points.select((F.col("seq") + 1).alias("seq"), F.col("fpr").alias("pf"), F.col("tpr").alias("pt"))
    steps = points.join(prev, "seq", "left")
    area = (F.col("fpr") - F.coalesce("pf", F.lit(0.0))) * (F.col("tpr") + F.coalesce("pt", F.lit(0.0))) / 2
    gap = F.round(F.abs(F.col("fpr") - (1 - F.col("tpr"))), 6)
    best = F.min(F.struct(gap.alias("gap"), "seq", ((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer")))
    return steps.agg(F.coalesce(F.sum(area), F.lit(0.5)).alias("auc"), F.coalesce(best["eer"], F.lit(0.5)).alias("eer"))


def roc_by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One point for each distinct score, ties merged."""
    merged = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("all"))
    run = running_totals(merged, [F.desc(score)], {"seq": F.lit(1), "tp": F.col("pos"), "fp": F.col("all") - F.col("pos")})
    totals = merged.agg(F.sum("pos").alias("p"), (F.sum("all") - F.sum("pos")).alias("n"))
    run = run.crossJoin(F.broadcast(totals)).filter("p > 0 AND n > 0")  # one row
    return run.select("seq", score, (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def rank_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half, from counts by score: no pairs are made."""
    merged = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    run = running_totals(merged, [F.asc(score)], {"below": F.col("neg")})
    wins = F.col("pos") * (F.col("below") - F.col("neg") / 2)
    return run.agg(F.sum(wins).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.try_divide("w", F.col("p") * F.col("n")).alias("auc"))


def calibration_error(rows: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Bins of probability with their mean probability, rate and share of the expected calibration error."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")
    out = rows.groupBy(b).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(F.col(label).cast("double")).alias("rate"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("error", F.abs(F.col("confidence") - F.col("rate")) * F.col("n") / F.sum("n").over(every))  # `bins` rows


def quantile(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row `cut`: the exact quantile of a column, straight between two values; null without values.

    Counts by value are summed up over ranges, so no task holds all values.
    """
    known = rows.filter(F.col(value).isNotNull())
    merged = known.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = running_totals(merged, [F.asc("v")], {"upto": F.col("n")})
    at = merged.agg(((F.sum("n") - 1) * F.lit(float(share))).alias("place"))
    run = run.crossJoin(F.broadcast(at))  # one row
    least = run.agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("b"), F.max("place").alias("place"))
    part = F.col("place") - F.floor("place")
    return least.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("cut"))


def group_quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group by name, straight between two values; groups without values don't come.

    Counts by group and value are summed up over ranges of both, so a group with most of the rows is many tasks' work.
    """
    merged = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    run = running_totals(merged, [F.asc(group), F.asc("v")], {"upto": F.col("n")})
    # A group's own counts begin where the group before it ends.
    of = run.groupBy(F.col(group).alias("_group")).agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.max("upto").alias("end"))
    run = run.join(of, F.col(group).eqNullSafe(F.col("_group"))).withColumn("upto", F.col("upto") - F.col("base"))
    place = {k: (F.col("end") - F.col("base") - 1) * F.lit(float(p)) for k, p in shares.items()}
    found = [F.min(F.when(F.col("upto") > edge(place[k]), F.col("v"))).alias(f"{name}_{k}") for k in shares for name, edge in (("a", F.floor), ("b", F.ceil))]
    least = run.groupBy(group).agg(*found, *[F.max(place[k] - F.floor(place[k])).alias(f"part_{k}") for k in shares])
    a, b, part = (lambda k, x=x: F.col(f"{x}_{k}") for x in ("a", "b", "part"))
    return least.select(group, *[F.when(a(k) == b(k), a(k)).otherwise((1 - part(k)) * a(k) + part(k) * b(k)).alias(k) for k in shares])


#: Draws of a replicate from one digest: sixteen parts of 16 bits.
DRAWS = 16


def poisson_bounds(most: int = 8) -> list[int]:
    """16-bit draws from which a Poisson(1) weight is at least 1, 2, ...; a weight of `most` or more has no 16-bit draw."""
    shares, total, out = math.exp(-1.0), 0.0, []
    for k in range(1, most):
        total += shares
        shares /= k
        out.append(math.floor(total * 65536))
    return out


def poisson_weights(key: Column, replicates: int) -> list[Column]:
    """A row's Poisson(1) weight in each replicate, from the SHA-256 of its key and the number of sixteen replicates: every run draws the same."""
    digests = [F.sha2(F.concat(key.cast("string"), F.lit(f":{block}")), 256) for block in range(-(-replicates // DRAWS))]
    draw = lambda r: F.conv(F.substring(digests[r // DRAWS], r % DRAWS * 4 + 1, 4), 16, 10).cast("int")
    return [sum((F.when(draw(r) >= bound, 1).otherwise(0) for bound in poisson_bounds()), F.lit(0)).cast("long") for r in range(replicates)]


def bootstrap_auc(rows: DataFrame, key: str, score: str, label: str, replicates: int = 32) -> DataFrame:
    """replicate and auc of Poisson-bootstrap resamples, all from one pass over ranges of scores.

    Weights are summed by score and label before they are shuffled; a replicate without a positive or negative has a null auc.
    """
    weights = poisson_weights(F.col(key), replicates)
    rows = rows.select(score, F.col(label).cast("long").alias("_label"), *[w.alias(f"w{r}") for r, w in enumerate(weights)])
    sides = [F.sum(F.when(F.col("_label") == side, F.col(f"w{r}")).otherwise(0)).alias(f"{name}{r}") for r in range(replicates) for side, name in ((1, "p"), (0, "n"))]
    run = running_totals(rows.groupBy(score).agg(*sides), [F.asc(score)], {f"below{r}": F.col(f"n{r}") for r in range(replicates)})
    wins = lambda r: F.sum(F.col(f"p{r}") * (F.col(f"below{r}") - F.col(f"n{r}") / 2))
    out = run.agg(*[F.struct(F.lit(r).alias("replicate"), F.try_divide(wins(r), F.sum(f"p{r}") * F.sum(f"n{r}")).alias("auc")).alias(f"r{r}") for r in range(replicates)])
    return out.select(F.explode(F.array(*[f"r{r}" for r in range(replicates)])).alias("x")).select("x.*")


def interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """low, middle and high of a statistic's replicates: one row from as many as there are replicates."""
    at = lambda p: F.percentile(value, F.lit(p))
    return replicates.agg(at((1 - level) / 2).alias("low"), at(0.5).alias("middle"), at((1 + level) / 2).alias("high"))


def acceptance_at(rows: DataFrame, score: str, label: str, rejected: float) -> DataFrame:
    """Share of attacks (label 1) that pass where `rejected` of the genuine (label 0) are turned away."""
    cut = quantile(rows.filter(F.col(label) == 0), score, 1 - rejected)
    return rows.filter(F.col(label) == 1).crossJoin(F.broadcast(cut)).agg(F.first("cut").alias("cut"), F.avg((F.col(score) <= F.col("cut")).cast("double")).alias("accepted"))


def group_split(rows: DataFrame, group: str, share: float = 0.8) -> DataFrame:
    """rows with `fold`: the first int(share * n) groups in order are train, the others test; no group is in both."""
    groups = rows.select(group).distinct()
    placed = running_totals(groups, [F.asc(group)], {"place": F.lit(1)})
    n = groups.agg(F.floor(F.count("*") * share).alias("cut"))
    placed = placed.crossJoin(F.broadcast(n)).select(group, F.when(F.col("place") <= F.col("cut"), "train").otherwise("test").alias("fold"))  # n is one row
    return rows.join(placed, group)
