"""Exact dedup as a stateful stream: texts met before are known by keyed state on disk, and hits are checked byte by byte.

A stream over the table's files turns each row into a digest, its identifier and the place of its content (file and row
in it). The state, in RocksDB and without expiry, holds for each digest the row that stays (largest identifier, ties by
place) and how many rows have come. Rows of one digest are combined before they are shuffled, so a text with very many
copies costs a task of the state no more than one row a task that read it. A later call with the same checkpoint takes
new files alone and goes on with the same state.

After the stream has taken all there is, `confirmed` looks at every digest that was hit: the full texts meet as grouping
keys, so that bytes are compared, and the row at the held place has to be one of them. A digest that has several texts, or
whose held row no longer has the text, is settled anew from the texts themselves.

Null counts as an empty text. A null doc_id is smaller than any other. Of rows that agree in doc_id and text one stays:
the last in order of file and row. An empty table gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, written

#: Bytes of files that one micro-batch takes, at least a file.
BYTES_A_BATCH = 64 << 30
#: Digests that were hit, up to which they are sent to all tasks to choose the texts to compare; beyond that they are joined by a shuffle.
BROADCAST_HITS = 2_000_000

STORE = "spark.sql.streaming.stateStore"
STREAM_CONF = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    # Else each of a state's partitions takes 4 MB of disk ahead.
    f"{STORE}.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rows_of(table: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, held (identifier and place) and text of each row of a table of files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return table.select(digest(text).alias("digest"), held.alias("held"), text.alias("text"))


def absorb(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, bytes_a_batch: int = BYTES_A_BATCH) -> None:
    """Take the files under path that the checkpoint has not seen yet into its state."""
    session = spark.newSession()
    for key, value in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STREAM_CONF}.items():
        session.conf.set(key, value)
    # As a pattern, a path may be a folder or one file.
    found = session.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    state = rows_of(found, digest).groupBy("digest").agg(F.max("held").alias("held"), F.count("*").alias("n"))
    state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the state holds: digest, held, n."""
    return written(spark.read.format("statestore").load(checkpoint).select("key.digest", F.col("value.max").alias("held"), F.col("value.count").alias("n")), "exact-state")


def confirmed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Classes of equal texts among the digests that were hit: digest, text, held, n, sound (the state says the same)."""
    hit = state.filter("n > 1").select("digest", F.col("held").alias("known"), F.col("n").alias("known_n"))
    met = rows.join(F.broadcast(hit.select("digest")) if hit.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else hit.select("digest"), "digest", "left_semi")
    classes = met.groupBy("digest", "text").agg(F.max("held").alias("held"), F.count("*").alias("n"))
    return classes.join(hit, "digest").select("digest", "text", "held", "n", ((F.col("held") == F.col("known")) & (F.col("n") == F.col("known_n"))).alias("sound"))


def deduplicated(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row under path, by the state at the checkpoint."""
    state, rows = state_of(spark, checkpoint), rows_of(spark.read.parquet(path), digest)
    unsound = written(confirmed(rows, state).filter(~F.col("sound")).select("digest", "text", "held", "n"), "exact-unsound")
    narrow = rows.select("digest", F.col("held").alias("own"), F.sha2("text", 256).alias("text_sha256"))
    out = narrow.join(state, "digest")
    if not unsound.isEmpty():
        digests = unsound.select("digest").distinct()
        again = rows.join(digests, "digest", "left_semi").withColumnRenamed("held", "own").join(unsound, ["digest", "text"])
        out = out.join(digests, "digest", "left_anti").unionByName(again.select("digest", "own", F.sha2("text", 256).alias("text_sha256"), "held", "n"))
    return out.select(
        F.col("own.doc_id").alias("doc_id"), F.col("held.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("own") == F.col("held")).alias("kept"), "text_sha256"
    )


def op12_stateful_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = f"{sf_dir}/documents.parquet", new_path(spark, "exact-checkpoint")
    absorb(spark, path, checkpoint)
    return deduplicated(spark, path, checkpoint)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
