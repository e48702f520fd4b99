"""Byte-level BPE through a sentencepiece model that is serialised straight from the vocabulary.

Each vocabulary entry becomes a piece whose bytes are mapped to printable characters, one for one; its score is
its negative rank, so sentencepiece merges the pair of lowest rank first and the leftmost of equals, as byte-level
BPE does. The normaliser is the identity. A text is split into pre-tokens by the tokenizer's pattern, each is
encoded alone, and ids are decoded by the inverse byte mapping.

Defined results: null or empty text has no tokens and decodes to nothing; a null doc_id stays null; repeated rows
are encoded each; extra columns are ignored. Every text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Pre-tokens that a worker remembers; the memory is emptied when full, which changes no result.
CACHE = 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 ones stand for themselves, the rest follow from U+0100."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(spare)) for b in range(256)]


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for Python's faster `re`, right for texts of Latin-1 characters; None if it can't be put so."""
    kinds = {kind: "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind) for kind in "LN"}
    space = r"\t-\r \x85\xa0"

    def in_class(m: re.Match) -> str:
        return m[0].replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", space)

    out = re.sub(r"\[\^?[^\]]*\]", in_class, pattern)
    for short, long in ((r"\p{L}", f"[{kinds['L']}]"), (r"\p{N}", f"[{kinds['N']}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        out = out.replace(short, long)
    return None if r"\p" in out or "(?i" in out else out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i, the unknown piece comes last."""
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))

    pieces = [piece("".join(chars[b] for b in token), -float(rank), 1) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, 2))
    # model type BPE, vocabulary size, id of the unknown piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes and decodes whole texts; built once in each Python worker."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.any_split = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_split = re.compile(latin).findall if latin else self.any_split
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.token = [*tokens, b""].__getitem__
        self.table = {i: c for i, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_split(text)
        return self.latin_split(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pre-tokens not met before are encoded once for all."""
        words = [self.split(text) for text in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = set().union(*words)
        new = list(new)
        mapped = [w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.table) for w in new]
        ids = self.pieces.encode(mapped, out_type=int, num_threads=1) if new else []
        self.known.update(zip(new, [array("I", x).tobytes() for x in ids], strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4") for x in words]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token, ids.tolist()))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): count of tokens and digests of the ids and of the decoded bytes.

    keep_ids adds the ids themselves as array<int>. The vocabulary (a bounded file, about 1 MB here) is read on the
    driver and broadcast.
    """
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((serialise_model(tokens), tokens, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            doc_id, text = batch.columns
            for at in range(0, batch.num_rows, 64):
                ids = coder.encode([x or "" for x in text.slice(at, 64).to_pylist()])
                out = [
                    doc_id.slice(at, 64),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
