"""Removal of byte spans from texts: the spans of a row and its compressed text meet in one shuffle."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.llm.common import utf8

ROW_KEY = ["doc_id", "text_crc"]


def text_crc(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their texts (null: as empty)."""
    return F.crc32(F.encode(F.coalesce(text.cast("string"), F.lit("")), "utf-8"))


@arrow_udf(T.BinaryType())
def pack(text: pa.Array) -> pa.Array:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    data, starts = utf8(text)
    return pa.array([press(data[starts[i] : starts[i + 1]].tobytes()) for i in range(len(text))], pa.binary())


def merged(spans: list[dict] | None, least: int) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, those of at least `least` bytes."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= least]


def cutter(least: int, keep_text: bool):
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    kinds |= {"kept_text": T.StringType()} if keep_text else {}

    @arrow_udf(T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    def cut(packed: pa.Array, spans: pa.Array) -> pa.Array:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = []
        for blob, found in zip(packed.to_pylist(), spans.to_pylist(), strict=True):
            text = unpack(blob)
            gone, kept, at = merged(found, least), [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            row = [len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest()]
            rows.append([*row, left.decode(errors="replace")] if keep_text else row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
        columns = list(zip(*rows, strict=True)) or [[]] * (4 + keep_text)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return cut


def remove_spans(docs: DataFrame, spans: DataFrame, least: int = 1, *, keep_text: bool = False, result: str = "cut") -> DataFrame:
    """docs without `text`, and a struct `result` of what the removal of spans(doc_id, text_crc, start, end) leaves.

    A row's spans lie in its own text, so their list is as bounded as the text is. Columns added on the way have names
    that no table of ours has.
    """
    lists = spans.groupBy("doc_id", "text_crc").agg(F.collect_list(F.struct("start", "end")).alias("removal spans"))
    lists = lists.withColumnsRenamed({"doc_id": "removal doc", "text_crc": "removal crc"})
    rows = docs.withColumn("removal own", text_crc(F.col("text"))).withColumn("removal packed", pack(F.col("text").cast("string"))).drop("text")
    same = rows["doc_id"].cast("long").eqNullSafe(lists["removal doc"]) & (rows["removal own"] == lists["removal crc"])
    out = rows.join(lists, same, "left").withColumn(result, cutter(least, keep_text)(F.col("removal packed"), F.col("removal spans")))
    return out.drop("removal doc", "removal crc", "removal spans", "removal own", "removal packed")
