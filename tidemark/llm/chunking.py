"""Substring dedup by content-defined chunking: a gear rolling hash cuts texts, equal chunks are kept once.

A text is cut after a white-space byte where the gear hash of the last 32 bytes has its highest CUT_BITS bits zero,
but not before LEAST_CHUNK bytes; from USUAL_CHUNK bytes on EASY_BITS zero bits will do. Where the last 32 bytes hold no white space (scripts without it, minified code, base64) any
character may end a chunk by the first rule; a stretch without cuts is cut after MOST_CHUNK bytes. Where bytes are inserted, cuts come back in step within a chunk or two. Chunks are compared by a 96-bit digest; the first one by
(doc_id, text_crc, start) stays, later ones go if the run of them has LEAST_RUN bytes or more, so that common short
lines stay. First places come from a map-side combined minimum, and later ones from a join that may be split by skew.

Defined results: null or empty text has no chunks and nothing removed; rows equal in doc_id and text count as one
document and are treated alike; the smallest doc_id (null first) keeps a repeated passage; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import steps, table, utf8, written
from tidemark.llm.shingles import SPACE, mix
from tidemark.llm.spans import remove_spans, text_crc

CUT_BITS = 4
EASY_BITS = 1
LEAST_CHUNK = 24
USUAL_CHUNK = 40
MOST_CHUNK = 1024
LEAST_RUN = 80
WINDOW = 32
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted by its distance."""
    h = GEAR[data]
    for k in range(5):
        shifted = np.zeros_like(h)
        shifted[1 << k :] = h[: -(1 << k) or None][: max(0, len(h) - (1 << k))]
        h = h + (shifted << np.uint32(1 << k))
    return h


def unspaced(text: np.ndarray) -> np.ndarray:
    """The bytes that end a character and, like all that the gear hash sees there, are no white space."""
    out = np.zeros(len(text), bool)
    spaces = np.concatenate([[0], np.cumsum(SPACE[text])])
    out[WINDOW - 1 :] = spaces[WINDOW:] == spaces[:-WINDOW]
    out[:-1] &= text[1:] & 0xC0 != 0x80
    return out


def cuts(text: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(text)
    if not n:
        return []
    # The lowest bits depend on the last few bytes alone, so the highest of the 32 decide.
    h = gear_hashes(text) >> np.uint32(32 - CUT_BITS)
    wanted = np.flatnonzero((SPACE[text] & (h < 1 << CUT_BITS - EASY_BITS)) | (unspaced(text) & (h == 0)))
    out, last = [], 0
    for end, hard in zip([*(wanted + 1).tolist(), n], [*h[wanted].tolist(), 0], strict=True):
        if end - last < (LEAST_CHUNK if hard == 0 else USUAL_CHUNK) and end != n:
            continue
        while end - last > MOST_CHUNK:
            last += MOST_CHUNK
            while text[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk: doc_id, text_crc, start, end and its digest as a long and an int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, starts = utf8(batch.column(1))
            rows, begin, end, digests = [], [], [], []
            for i in range(batch.num_rows):
                text = data[starts[i] : starts[i + 1]]
                raw, ends = text.tobytes(), cuts(text)
                rows.append(len(ends))
                at = 0
                for stop in ends:
                    begin.append(at)
                    digests.append(hashlib.blake2b(raw[at:stop], digest_size=12).digest())
                    at = stop
                end += ends
            row = pa.array(np.repeat(np.arange(batch.num_rows), rows))
            two = np.frombuffer(b"".join(digests), np.dtype([("high", "<i8"), ("low", "<i4")]))
            columns = [batch.column(0).take(row), batch.column(2).take(row), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(two["high"].copy()), pa.array(two["low"].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_crc", "start", "end", "high", "low"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_crc(F.col("text")).alias("text_crc"))
    return rows.mapInArrow(run, "doc_id long, text_crc long, start int, end int, high long, low int")


def later_chunks(found: DataFrame) -> DataFrame:
    """Chunks that an earlier place has too: doc_id, text_crc, start, end."""
    place = F.struct("doc_id", "text_crc", "start")
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return found.join(first, ["high", "low"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_crc", "start", "end")


def repeated_spans(docs: DataFrame) -> DataFrame:
    return written(later_chunks(written(chunks(docs), "chunks")), "chunk-spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_spans(docs, repeated_spans(docs), LEAST_RUN).select("doc_id", "cut.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of `text`; rows and other columns stay."""
    cut = remove_spans(docs, repeated_spans(docs), LEAST_RUN, keep_text=True, result="removal result")
    return cut.withColumn("text", F.col("removal result")["kept_text"]).select(*docs.columns)
