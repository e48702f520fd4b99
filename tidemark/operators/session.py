"""Sessions and challenges: consent, admission, expiry, phrases and colour sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
WORDS = {
    "b": ["Banana", "Bottle", "Blanket", "Bridge", "Button", "Basket"],
    "p": ["Paper", "Pencil", "Pocket", "Pillow", "Purple", "Planet"],
    "m": ["Mountain", "Mango", "Marble", "Mirror", "Monkey", "Morning"],
}
COLOURS = ["#ff4d4d", "#4d79ff", "#4dff88", "#ffb84d", "#b84dff", "#4dffff", "#ff4da6", "#ffe04d"]
WHITE = "#ffffff"
LEAST_STEP_MS = 333


def consent_state(given: Column, mock: Column, bypass: Column, env: Column) -> Column:
    return F.when(given, "consented").when(mock | (bypass & env.isin("demo", "development")), "bypassed").otherwise("rejected")


def admitted(sessions: DataFrame, host: str, key: str, start: str, end: str, most: int) -> DataFrame:
    """Sessions that a host admits: one is refused that starts while `most` admitted ones are open (those that end at its start aren't).

    A state machine over each host's sessions in order of start and key; its state is the `most` open ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, []
        for batch in batches:
            keep = []
            for of, begins, closes in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (host, start, end)), strict=True):
                if of != at:
                    at, ends = of, []
                ends = [e for e in ends if e > begins]
                keep.append(len(ends) < most)
                if keep[-1]:
                    ends.append(closes)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = sessions.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    return rows.repartition(host).sortWithinPartitions(host, start, key).mapInArrow(run, rows.schema)


def unexpired(rows: DataFrame, created: str, ttl_sec: int, now: Column) -> DataFrame:
    return rows.filter(F.col(created) + ttl_sec >= now)


def phrase(seed: Column) -> Column:
    """One word of each list in an order of its own, all drawn from hashes of the seed."""
    pick = lambda k, i: F.element_at(F.array(*[F.lit(w) for w in WORDS[k]]), (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(6)) + 1).cast("int"))
    drawn = [F.struct(F.xxhash64(seed, F.lit(f"order {k}")).alias("order"), pick(k, k).alias("word")) for k in WORDS]
    return F.array_join(F.transform(F.array_sort(F.array(*drawn)), lambda x: x["word"]), " ")


def hmac_pads(secret: str, block: int = 64) -> tuple[bytes, bytes]:
    """The secret's inner and outer pads, that a keyed digest puts before what it digests."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > block else key).ljust(block, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a string column: two digests over pads and bytes; null for null."""
    inner, outer = (F.lit(bytearray(p)) for p in hmac_pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def light_sequences(rows: DataFrame, nonce: str, secret: str, steps: int = 7, step_ms: int = 350) -> DataFrame:
    """rows with `sequence`, an array of (color, ms): white, then colours by the bytes of HMAC-SHA256(secret, nonce), none twice in a row."""
    if not 6 <= steps <= 8 or step_ms < LEAST_STEP_MS:
        raise ValueError("6 to 8 steps of at least 333 ms")

    # Bytes as numbers; the fold sees the colour before.
    digits = hmac_sha256(secret, F.col(nonce))
    places = F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda i: F.conv(F.substring(digits, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int"))
    palette = F.array(*[F.lit(c) for c in COLOURS])

    def step(out: Column, byte: Column) -> Column:
        at = lambda k: F.get(palette, (byte + k) % len(COLOURS))
        return F.concat(out, F.array(F.when(at(0) == F.element_at(out, -1), at(1)).otherwise(at(0))))

    colours = F.aggregate(places, F.array(F.lit(WHITE)), step)
    sequence = F.transform(colours, lambda c: F.struct(c.alias("color"), F.lit(step_ms).alias("ms")))
    return rows.withColumn("sequence", F.when(F.col(nonce).isNotNull(), sequence))


def challenge_of(challenges: Column, kind: str) -> Column:
    """The first challenge of a kind in an array; null where there is none."""
    return F.get(F.filter(challenges, lambda c: c["kind"] == kind), F.lit(0))


def opened(requests: DataFrame, key: str, secret: str, now: Column, ttl_sec: int = 300) -> DataFrame:
    """A session for each request (its key is the nonce's seed): nonce, phrase, light sequence and expiry."""
    rows = requests.withColumn("nonce", F.substring(F.sha2(F.concat_ws("/", F.lit(secret), F.col(key).cast("string")), 256), 1, 32))
    rows = light_sequences(rows.withColumn("phrase", phrase(F.col("nonce"))), "nonce", secret)
    return rows.withColumn("expires_at", now.cast("long") + ttl_sec).withColumn("used", F.lit(False))
