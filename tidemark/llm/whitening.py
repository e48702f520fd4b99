"""Whitening of embeddings by matrix-free block Lanczos.

Each entry becomes an integer x. With n rows and sums S of each dimension, n * x - S is an exact integer and its quotient by
n the centred entry to the last bit, so nothing is lost to the offset of x. The covariance matrix is never formed: a pass
over the rows gives its product with a block of vectors, as a sum of small matrices that tasks make and Spark adds up.

`lanczos` grows an orthonormal basis block by block. Each product is orthogonalised twice against the whole basis; where it
loses rank (an invariant subspace was found) random directions, orthogonalised too, restart it. After each block the
Ritz values and vectors and their residuals are taken; the wanted ones have converged when every residual is at most TOLERANCE
of the largest value and a random restart has brought nothing new, or the basis spans the whole space. A basis of MOST_BASIS times the wanted count is compressed to
its Ritz vectors and goes on. The driver holds width x basis numbers, whatever the number of rows.

The sum of eigenvalues is the trace, taken from the exact deviations. Components whose share of it is under LEAST_SHARE
have no variance to the precision of doubles and are left out, so that there may be fewer than asked for.

Rows whose vector is null or holds null or non-finite entries take no part; so do vectors of another length than the
commonest (ties: the longer). An entry beyond a long's range takes that range's end. deviation is null where it exceeds a long.
No rows or no variance give no result rows. A repeated or null vec_id is carried as it is; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Vectors that one pass multiplies.
BLOCK = 16
#: Largest residual of a wanted component, as a share of the largest eigenvalue.
TOLERANCE = 1e-14
#: Basis vectors at most, as a multiple of the wanted components (and of the width at most).
MOST_BASIS = 4
#: Blocks of a random restart that must leave converged components as they are: a value of higher multiplicity than the block's width hides from one start.
DOUBTED = 4
#: Components with a smaller share of the trace have no variance beyond rounding.
LEAST_SHARE = 1e-13
#: Rows that one numpy step holds as doubles.
STEP_CELLS = 1 << 20

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and vector (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("vector")).filter(sound)
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("vector") == (width["width"] if width else 0))


def integers(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Row keys and entries as longs, some rows at a time."""
    vectors = batch.column(1)
    width = len(vectors[0]) if batch.num_rows else 1
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(1, STEP_CELLS // width)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, batch.num_rows, step):
            scaled = np.floor(SCALE * flat[at : at + step])
            whole = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max - OFFSET, np.where(scaled < -(2.0**63), np.iinfo(np.int64).min, scaled.clip(-(2.0**63), 2.0**63 - 2048))).astype(np.int64)
            yield batch.column(0).slice(at, step), np.where(whole > np.iinfo(np.int64).max - OFFSET, np.iinfo(np.int64).max, whole + OFFSET)


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: str) -> list:
    """Sums, place by place, of the vectors that tasks make; doubles, or integers as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task(batches)
        if made is not None:
            values = [int(x) for x in made.ravel()] if shape != "double" else made.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(made.size), pa.int64()), pa.array(values, pa.float64() if shape == "double" else pa.decimal128(38, 0))], ["place", "value"])

    parts = rows.mapInArrow(run, f"place long, value {shape}")
    # A task's sums are few; they meet by place, in as many tasks as there are places.
    return [r.value for r in parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()]


class Sums:
    """Rows n and the sums S of each dimension; what follows from them for some rows of integers."""

    def __init__(self, sums: list[int], n: int):
        self.sums, self.n, self.width = sums, n, len(sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs if they hold it."""
        if max(abs(int(x.min())), abs(int(x.max()))) * self.n < 2**62 and max(map(abs, self.sums)) < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of the squared deviations, exactly."""
        d = self.deviations(x)
        if d.dtype != object and float(np.abs(d).max()) < 2**31 / np.sqrt(self.width):
            return (d * d).sum(1)
        d = d.astype(object)
        return (d * d).sum(1)


def sums_of(rows: DataFrame) -> Sums:
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for _, x in integers(batch):
                # Python's integers where longs might not hold the sum.
                part = x.astype(object).sum(0) if np.abs(x.astype(float)).max() > 2.0**62 / len(x) else x.sum(0).astype(object)
                part = np.append(part, len(x))
                total = part if total is None else total + part
        return total

    found = [int(v) for v in summed(rows, run, "decimal(38,0)")]
    return Sums(found[:-1], found[-1]) if found else Sums([], 0)


def trace_of(rows: DataFrame, fit: Sums) -> float:
    """The trace of the covariance from exact deviations: their sum over n cubed."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, any_rows = 0, False
        for batch in batches:
            for _, x in integers(batch):
                total, any_rows = total + sum(map(int, fit.spread(x))), True
        # Thirty digits at a time, as a decimal holds 38.
        return np.array([total % 10**30, total // 10**30 % 10**30, total // 10**60], object) if any_rows else None

    parts = [int(v) for v in summed(rows, run, "decimal(38,0)")]
    return sum(v * 10 ** (30 * i) for i, v in enumerate(parts)) / fit.n**3 if parts else 0.0


def product_sum(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over the rows of the matrices that `part` makes of some rows of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for _, x in integers(batch):
                total = part(x) if total is None else total + part(x)
        return total

    return np.array(summed(rows, run, "double")).reshape(shape)


def covariance_times(rows: DataFrame, fit: Sums) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance times a block of vectors, by a pass over the rows."""

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = fit.centred(x)
            return c.T @ (c @ block)

        return product_sum(rows, part, block.shape) / fit.n

    return times


def projected_covariance(rows: DataFrame, fit: Sums, projection: np.ndarray) -> np.ndarray:
    def part(x: np.ndarray) -> np.ndarray:
        p = fit.centred(x) @ projection
        return p.T @ p

    return product_sum(rows, part, (projection.shape[1],) * 2) / fit.n


def orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, draw: np.random.Generator) -> np.ndarray:
    """Orthonormal directions of the block beyond the basis; lost ones are replaced by random directions, while there are any."""
    out = np.zeros((basis.shape[0], 0))
    for column in block.T:
        floor = 1e-12 * scale
        for _ in range(8):
            if basis.shape[1] + out.shape[1] >= basis.shape[0]:
                return out
            for _ in range(3):
                column = column - basis @ (basis.T @ column)
                column = column - out @ (out.T @ column)
            length = np.linalg.norm(column)
            if length > floor:
                column = column / length
                column = column - basis @ (basis.T @ column)
                column = column - out @ (out.T @ column)
                out = np.column_stack([out, column / np.linalg.norm(column)])
                break
            column, floor = draw.standard_normal(len(column)), 1e-6
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0, most_passes: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and their vectors of a symmetric positive semidefinite matrix that is known by its products alone."""
    wanted, draw = min(wanted, width), np.random.default_rng(seed)
    most = min(width, max(MOST_BASIS * wanted, wanted + 2 * block))
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    grown, scale, doubted = orthonormal(draw.standard_normal((width, block)), basis, 1.0, draw), 0.0, None
    for _ in range(most_passes):
        image = times(grown)
        basis, images = np.column_stack([basis, grown]), np.column_stack([images, image])
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, mix = values[order], mix[:, order]
        vectors = basis @ mix
        residual = np.linalg.norm(images @ mix - vectors * values, axis=0)
        scale = max(values[0], 0.0)
        converged = len(values) >= wanted and residual[:wanted].max() <= tolerance * scale
        if basis.shape[1] >= width or (converged and doubted == 0):
            break
        lead = image
        if converged and doubted is None:
            lead, doubted = draw.standard_normal((width, block)), DOUBTED
        elif doubted:
            doubted -= 1
        if basis.shape[1] + block > most < width:
            # The best Ritz vectors stay, with their images; the residuals of those that have not converged lead on.
            keep = min(wanted + block, basis.shape[1] - block)
            basis, images = vectors[:, :keep], images @ mix[:, :keep]
            behind = np.argsort(-residual[:keep])[:block]
            if lead is image:
                lead = images[:, behind] - basis[:, behind] * values[behind]
        grown = orthonormal(lead, basis, scale, draw)
    return values[:wanted], vectors[:, :wanted]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """WHITENED of each usable row (vec_id, vector) and component."""
    fit = sums_of(rows)
    trace = trace_of(rows, fit)
    if not trace:
        return rows.sparkSession.createDataFrame([], WHITENED)
    values, vectors = lanczos(covariance_times(rows, fit), fit.width, components)
    full = values > LEAST_SHARE * trace
    values, vectors = values[full], vectors[:, full]
    projection = vectors / np.sqrt(values)
    error = float(np.abs(projected_covariance(rows, fit, projection) - np.eye(len(values))).max())
    shares, k = values / trace, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in integers(batch):
                deviation = pa.array([d if d < 2**63 else None for d in map(int, fit.spread(x))], pa.int64())
                place, n = np.repeat(np.arange(len(x)), k), len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, fit.n)), deviation.take(pa.array(place)),
                        pa.array((fit.centred(x) @ projection).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(n, error)),
                    ],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(run, WHITENED)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(usable(table(spark, sf_dir, "embeddings")))
