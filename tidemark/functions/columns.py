"""Scalar and array expressions that the operators share; all but the edit distance stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.edits import edit_distance


def number(x: Column) -> Column:
    """NaN as null."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null and NaN stay null."""
    x = number(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def ramp(x: Column, start: float, width: float) -> Column:
    """0 up to start, 1 from start + width, straight between."""
    return clip((x - start) / width, 0.0, 1.0)


def sigmoid(x: Column, bound: float = 15.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -bound, bound)))


def disagreement(a: Column, b: Column) -> Column:
    return F.abs(F.tanh(a) - F.tanh(b))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hex_chromaticity(colour: Column) -> Column:
    """r, g and luma of a colour such as #ff8000; one third each and 128 where it hasn't six digits."""

    def of(digits: Column) -> Column:
        part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("double")
        return let(F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), digits.rlike("^[0-9a-fA-F]{6}$").alias("good")), shares)

    def shares(v: Column) -> Column:
        good, total = v["good"], v["r"] + v["g"] + v["b"] + F.lit(1e-6)
        return F.struct(
            F.when(good, v["r"] / total).otherwise(0.333).alias("cr"), F.when(good, v["g"] / total).otherwise(0.333).alias("cg"), F.when(good, luma(v["r"], v["g"], v["b"])).otherwise(128.0).alias("luma")
        )

    return let(F.regexp_replace(F.trim(colour), "^#+", ""), of)


def let(value: Column, then) -> Column:
    """then(value), with value computed, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def mean(a: Column) -> Column:
    """Mean of an array of doubles; null for an empty one."""
    return let(a, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v)))


def variance(a: Column) -> Column:
    """Population variance of an array."""
    return let(a, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def deviation(a: Column) -> Column:
    return F.sqrt(variance(a))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where either is constant."""

    def of(p: Column) -> Column:
        joint = let(F.struct(mean(p["a"]).alias("a"), mean(p["b"]).alias("b")), lambda m: mean(F.zip_with(p["a"], p["b"], lambda x, y: (x - m["a"]) * (y - m["b"]))))
        return F.try_divide(joint, deviation(p["a"]) * deviation(p["b"]))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return let(a, lambda v: F.sqrt(dot(v, v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 1 where a vector has no length, so that missing data is no change."""
    lengths = norm(a) * norm(b)
    return F.when(lengths < 1e-12, F.lit(1.0)).otherwise(F.try_divide(dot(a, b), lengths))


def median(a: Column) -> Column:
    """Median of an array, the mean of the middle two for an even count."""
    return let(F.array_sort(a), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def even_sample(a: Column, size: int, count: int) -> Column:
    """`count` elements at even steps of an array of `size`, first and last included."""
    places = [k * (size - 1) // (count - 1) for k in range(count)]
    return F.array(*[F.get(a, F.lit(p)) for p in places])


def roll(a: Column, k: int) -> Column:
    """The array turned k places to the right."""
    n = F.size(a)
    shift = F.pmod(F.lit(k), n).cast("int")
    return F.when(n > 0, F.concat(F.slice(a, n - shift + 1, shift), F.slice(a, F.lit(1), n - shift))).otherwise(a)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)


def word_error_rate(expected: Column, heard: Column) -> Column:
    """Word edits over expected words; with none expected 0 or 1. It may exceed 1."""
    n = F.size(expected)
    return F.when(n == 0, F.when(F.size(heard) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(expected, heard) / n)


def label_of_path(path: Column) -> Column:
    """File stem and the label before its last underscore part."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    return F.struct(stem.alias("stem"), F.regexp_extract(stem, r"_(fake|real)$", 1).alias("label"))
