"""Evidence pictures as baseline JPEG files: colour transform, 8 x 8 cosine transform, quantisation, codes made for each picture.

Colour isn't subsampled. Each picture carries the Huffman codes of its own symbols, at most 16 bits long, so no code tables are
stated here. Files are written by the tasks that made them, under names that a second attempt writes again.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUALITY = 95
# The quantisation tables of the format's informative annex, in rows; colour differences are 99 beyond the 4 x 4 corner.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_CORNER = [17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99]
#: Places of a block by diagonals, each in the other direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))))
COSINES = np.sqrt(np.where(np.arange(8)[:, None] == 0, 1, 2) / 8) * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)


def tables(quality: int) -> list[np.ndarray]:
    """Divisors of brightness and colour coefficients, in rows."""
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.reshape(CHROMA_CORNER, (4, 4))
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip(np.floor((np.asarray(t, float).ravel() * scale + 50) / 100), 1, 255).astype(np.int64) for t in (LUMA, chroma)]


def components(rgb: np.ndarray) -> np.ndarray:
    """Brightness and two colour differences around 0."""
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])


def coefficients(plane: np.ndarray, divisors: np.ndarray) -> np.ndarray:
    """Quantised blocks of a plane in order, each by diagonals; edges go on to full blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    spectrum = COSINES @ blocks @ COSINES.T
    return np.rint(spectrum.reshape(-1, 64) / divisors).astype(np.int64)[:, ZIGZAG]


def code_lengths(counts: Counter) -> dict[int, int]:
    """Lengths of at most 16 bits for each symbol; one more symbol takes the code of ones alone, which the format forbids."""
    weights = dict(counts)
    while True:
        heap = [(1, -1, (-1,))] + [(n, s, (s,)) for s, n in weights.items()]
        heapq.heapify(heap)
        depth = Counter({s: 0 for s in (-1, *weights)})
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(depth.values()) <= 16:
            # Of the longest codes the last one goes to the symbol that never comes.
            order = sorted(depth, key=lambda s: (depth[s], s == -1, s))
            lengths = sorted(depth.values())
            order.remove(-1)
            return dict(zip(order, lengths, strict=False))
        weights = {s: n // 2 + 1 for s, n in weights.items()}


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical (code, length) of symbols in order of length."""
    out, code, before = {}, 0, 0
    for s, n in lengths.items():
        code <<= n - before
        out[s], before = (code, n), n
        code += 1
    return out


def _sized(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each value and how many; negative ones as the format says them."""
    n = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    return np.where(v >= 0, v, v + (1 << n) - 1), n


def tokens(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (place, symbol, value bits, how many) of the first coefficients as differences, and of the others after runs of zeros.

    place: the block, the coefficient and the token before it, as one number that grows in the order of the file.
    """
    bits, n = _sized(np.diff(blocks[:, 0], prepend=0))
    first = np.stack([np.arange(len(blocks)) * 256, n, bits, n], 1)
    block, at = np.nonzero(blocks[:, 1:])
    before = np.where(np.diff(block, prepend=-1) == 0, np.concatenate([[0], at[:-1]]), -1)
    run, (bits, n) = at - before - 1, _sized(blocks[block, at + 1])
    place = block * 256 + (at + 1) * 4
    rest = [np.stack([place + 3, run % 16 << 4 | n, bits, n], 1)]
    for k in range(3):
        long = place[run >= 16 * (k + 1)] + k
        rest.append(np.stack([long, np.full_like(long, 0xF0), 0 * long, 0 * long], 1))
    # A block whose last coefficient is zero says that it ends.
    ends = np.flatnonzero(blocks[:, 63] == 0) * 256 + 255
    rest.append(np.stack([ends, 0 * ends, 0 * ends, 0 * ends], 1))
    return first, np.concatenate(rest)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def encode(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """A picture (height x width x 3 bytes, each side 1 to 65 535) as a JPEG file."""
    height, width = rgb.shape[:2]
    divisors = tables(quality)
    parts = [tokens(coefficients(plane, divisors[min(i, 1)])) for i, plane in enumerate(components(rgb))]
    lengths, said = [], []
    for planes in ((0,), (1, 2)):
        for kind in (0, 1):
            symbols = np.concatenate([parts[i][kind][:, 1] for i in planes])
            counts = np.bincount(symbols, minlength=256)
            lengths.append(code_lengths(Counter({int(k): int(counts[k]) for k in np.flatnonzero(counts)})))
            table = np.zeros((256, 2), np.int64)
            for symbol, code in codes(lengths[-1]).items():
                table[symbol] = code
            for i in planes:
                place, symbol, value, n = parts[i][kind].T
                code, size = table[symbol].T
                # Blocks of the three planes take turns.
                said.append(np.stack([(place // 256 * 3 + i) * 256 + place % 256, code << n | value, size + n], 1))
    _, value, size = np.concatenate(said)[np.argsort(np.concatenate([x[:, 0] for x in said]))].T
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    bits = (np.repeat(value, size) >> left & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    out += [_segment(0xDB, bytes([i, *t[ZIGZAG].tolist()])) for i, t in enumerate(divisors)]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for i, n in enumerate(lengths):
        counts = Counter(n.values())
        out.append(_segment(0xC4, bytes([(i % 2) << 4 | i // 2, *[counts[k] for k in range(1, 17)], *n])))
    out.append(_segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join([*out, data, b"\xff\xd9"])


def jpeg(rows: DataFrame, pixels: str, height: str, width: str, name: str = "jpeg", quality: int = QUALITY) -> DataFrame:
    """rows with a picture's file in column `name`; null where the bytes don't fit the size or there is no picture."""
    schema = rows.withColumn(name, F.lit(None).cast("binary")).schema
    names = rows.columns
    at = [names.index(c) for c in (pixels, height, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A picture at a time in Python: the columns beside it stay as they are.
            files = []
            for i in range(batch.num_rows):
                block, h, w = (batch.column(k)[i].as_py() for k in at)
                fits = block is not None and h and w and len(block) == h * w * 3
                files.append(encode(np.frombuffer(block, np.uint8).reshape(h, w, 3), quality) if fits else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*names, name])

    return rows.mapInArrow(run, schema)


def write_files(rows: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """Writes each row's bytes to folder/name, in the tasks; returns name and size of what was written, once it is acted on.

    folder: a URI of a store that all executors share. A file is written aside and moved to its place, so it is whole or not there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            names, sizes = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is None or data is None:
                    continue
                place = f"{root}/{path}"
                parent = place.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                aside = f"{parent}/.{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as f:
                    f.write(data)
                store.move(aside, place)
                names.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    return rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "name string, size long")
