"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's features are its 3- and 4-byte substrings after lower-casing A to Z, hashed into buckets; their embeddings
are averaged, multiplied by the class matrix and put through a softmax whose temperature is fitted on a part of the
sample kept aside. A prediction whose calibrated probability lies under the rejection threshold is rejected; the
threshold is the highest that rejects at most REJECT of the kept-aside labelled texts, and at most 0.5.

The classifier is fitted on a bounded sample, which the driver holds: about SAMPLE rows of each language and about
LANGUAGE_CHARS characters of it (ALL_CHARS of all), taken by a hash of the id, of texts up to SAMPLE_CHARS characters, and of
the MAX_LANGUAGES most frequent languages; at most twice as many rows as that is about, those of the least hashes. A language beyond these is never predicted. Everything else reads every whole text.

Defined results: text that is null or has no letter is `und` with score 0 and rejected; where no labelled row can be
learned from, every text is `und`; equal texts get equal predictions; repeated rows are each predicted; a null
doc_id counts as held out = null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import steps, table, utf8

SAMPLE = 400
SAMPLE_CHARS = 20_000
LANGUAGE_CHARS = 2_000_000
MAX_LANGUAGES = 256
#: Characters of all languages together that the driver holds, about.
ALL_CHARS = 64_000_000
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
RATE = 20.0
REJECT = 0.002
SCHEMA = "doc_id long, lang_pred string, score double, accepted boolean"


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and of the 4-byte substrings that start at each byte but the last two or three."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    low = np.where((low <= 32), np.uint32(32), low)
    three = (low[:-2] << np.uint32(16)) + (low[1:-1] << np.uint32(8)) + low[2:]
    four = three[:-1] * np.uint32(0x85EBCA6B) + low[3:] * np.uint32(0xC2B2AE35)
    three = three * np.uint32(0x9E3779B1)
    return (three >> np.uint32(16)).astype(np.int32), ((four ^ four >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32)


def text_features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    if len(data) < 4:
        data = np.concatenate([data, np.full(4 - len(data), 32, np.uint8)])
    found, counts = np.unique(np.concatenate(subwords(data)), return_counts=True)
    return found, (counts / counts.sum()).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 11) -> dict:
    """The model: language names, a (bucket, language) matrix of embeddings times class weights, temperature, threshold."""
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels], np.int64)
    features = [text_features(np.frombuffer(t, np.uint8)) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside = order[: len(order) // 5]
    learn = order[len(order) // 5 :]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), np.float32)
    weight = np.bincount(target, minlength=len(names)).astype(np.float64)
    weight = np.where(weight > 0, weight.sum() / np.maximum(weight, 1) / len(names), 0)
    total, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            rate = RATE * (1 - done / total) * weight[target[i]]
            done += 1
            bucket, share = features[i]
            mean = share @ embed[bucket]
            p = _softmax(mean @ out)
            p[target[i]] -= 1
            back = out @ p
            out -= rate * 0.05 * np.outer(mean, p)
            embed[bucket] -= np.float32(rate) * share[:, None] * back.astype(np.float32)
    scores = (embed @ out).astype(np.float32)
    model = {"names": names, "scores": scores, "temperature": 1.0, "threshold": 0.0}
    if len(aside):
        logits = np.array([share @ scores[bucket] for bucket, share in (features[i] for i in aside)])
        losses = {t: -np.log(_softmax(logits / t)[np.arange(len(aside)), target[aside]] + 1e-9).mean() for t in np.geomspace(0.05, 5, 25)}
        model["temperature"] = float(min(losses, key=losses.get))
        top = np.sort(_softmax(logits / model["temperature"]).max(1))
        model["threshold"] = float(min(0.5, top[int(REJECT * len(top))]))
    return model


def sample(docs: DataFrame, eligible: Column) -> tuple[list[bytes], list[str]]:
    """At most SAMPLE texts for each language, the same at every run, brought to the driver (a bounded number of bytes)."""
    fit = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS))
    found = fit.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    most = min(LANGUAGE_CHARS, ALL_CHARS / max(len(found), 1))
    counts = {r.lang: max(r["count"], SAMPLE * r.chars / most) for r in found}
    if not counts:
        return [], []
    # A uniform hash of the id and text picks about SAMPLE rows of each language before texts are gathered.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, SAMPLE / n))])
    draw = (F.xxhash64(F.lit(7), "doc_id", F.crc32(F.encode("text", "utf-8"))).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    rows = fit.withColumn("draw", draw).filter(F.try_element_at(share, F.col("lang")) > F.col("draw")).select("draw", "lang", "text")
    # Rows of one draw (equal id and text) are alike, so it makes no difference which of them the bound leaves out.
    rows = sorted(rows.orderBy("draw", "lang", "text").limit(2 * SAMPLE * len(counts)).collect(), key=lambda r: (r.lang, r.draw, r.text))
    return [r.text.encode() for r in rows], [r.lang for r in rows]


def classify(data: np.ndarray, starts: np.ndarray, letters: np.ndarray, model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label, score and acceptance of each text."""
    n = len(starts) - 1
    label, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
    if model is not None and letters.any():
        p = _softmax(_logits(data, starts, model["scores"]) / model["temperature"])
        best = p.argmax(1)
        label = np.where(letters, np.array(model["names"], object)[best], label)
        score = np.where(letters, p[np.arange(n), best], 0.0)
        accepted = letters & (score >= model["threshold"])
    return label, score, accepted


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each row of docs(doc_id, text); the model is a few MB at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            letters = np.array(batch.column(2).to_pylist(), bool)
            label, score, accepted = classify(*utf8(batch.column(1)), letters, shared.value)
            out = [batch.column(0), pa.array(label.tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "accepted"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), has_letter(text).alias("letters"))
    return rows.mapInArrow(run, SCHEMA)


def keep_accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs whose prediction is accepted, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=1 << 20):
            letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            text = batch.column(batch.schema.get_field_index("text"))
            accepted = classify(*utf8(text), letters, shared.value)[2]
            yield batch.filter(pa.array(accepted)).select(batch.schema.names[:-1])

    return docs.withColumn("langid has letter", has_letter(F.col("text").cast("string"))).mapInArrow(run, docs.schema)


def _logits(data: np.ndarray, starts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    n = len(starts) - 1
    sizes = np.diff(starts)
    sums, counts = np.zeros((n, scores.shape[1])), np.zeros(n)
    if len(data) >= 4:
        for width, bucket in zip((3, 4), subwords(data), strict=True):
            hits = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[bucket], 0, dtype=np.float64)])
            ends = np.maximum(starts[:-1], starts[1:] - (width - 1))  # substrings stay within one text
            sums += hits[np.minimum(ends, len(bucket))] - hits[np.minimum(starts[:-1], len(bucket))]
            counts += ends - starts[:-1]
    for i in np.flatnonzero((sizes < 4) & (sizes > 0)):
        bucket, share = text_features(data[starts[i] : starts[i + 1]])
        sums[i], counts[i] = share @ scores[bucket], 1
    return sums / np.maximum(counts, 1)[:, None]


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2


def fit(docs: DataFrame) -> dict | None:
    texts, labels = sample(docs, ~held_out())
    return train(texts, labels) if texts else None


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
