"""Edit distance of word sequences by bit-parallel rows, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words of the first sequence that one integer holds a bit each of: memory grows with this, not with the sequences' product.
BITS = 4096
#: Pairs whose words are held as Python integers at a time.
STEP = 128


def edits(a: list[int], b: list[int], bits: int = BITS) -> int:
    """Edit distance of two sequences: a column of the usual table is two integers of up to `bits` bits, its steps up and down.

    Blocks of `a` come one after another; each leaves the steps along its lower edge for the next.
    """
    if not a:
        return len(b)
    edge, total = [1] * len(b), len(a)
    for at in range(0, len(a), bits):
        block = a[at : at + bits]
        full, top, places = (1 << len(block)) - 1, 1 << (len(block) - 1), {}
        for i, word in enumerate(block):
            places[word] = places.get(word, 0) | 1 << i
        up, down = full, 0
        for j, word in enumerate(b):
            same, enters = places.get(word, 0), edge[j]
            level = same | down
            if enters < 0:
                same |= 1
            free = (((same & up) + up) ^ up) | same
            right, left = down | (full & ~(free | up)), up & free
            edge[j] = 1 if right & top else -1 if left & top else 0
            right, left = (right << 1 | (enters > 0)) & full, (left << 1 | (enters < 0)) & full
            up, down = left | (full & ~(level | right)), right & level
    return total + sum(edge)


@F.arrow_udf(IntegerType())
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([n for at in range(0, len(a), STEP) for n in _some_distances(a.slice(at, STEP), b.slice(at, STEP))], pa.int32())


def _some_distances(a: pa.Array, b: pa.Array) -> list[int | None]:
    sizes = [x.value_lengths().to_pylist() for x in (a, b)]
    words = [x.flatten() for x in (a, b)]
    codes = pa.concat_arrays(words).dictionary_encode("encode").indices.to_pylist()
    at, out = [0, len(words[0])], []
    for m, n in zip(*sizes, strict=True):
        out.append(None if m is None or n is None else edits(codes[at[0] : at[0] + m], codes[at[1] : at[1] + n]))
        at = [at[0] + (m or 0), at[1] + (n or 0)]
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings, case ignored; null where either is null, a null element is a word of its own.

    No bound on distinct words: work is the product of the lengths over the bits of a machine word.
    """
    return _distances(F.transform(a, F.lower), F.transform(b, F.lower))
