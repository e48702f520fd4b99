"""Sources and sinks: guarded uploads, JSON sidecars and configuration, manifests, case documents and their eviction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import params as P

CASE = """session_id string, created_at long, consent_status string, stubs_in_use boolean, risk_score double, category string, summary string,
findings array<struct<id:string,severity:string,title:string,detail:string,t:double>>, windows array<struct<window_id:int,risk:double>>, window_count int, evidence array<string>"""
#: Folders of a batch of stored cases at most.
BUCKETS = 128
MESSAGE = """type string, client_time long, consent boolean, camera_label string, frame_intervals_ms array<double>, kind string, t0 long, expected string,
sequence array<struct<color:string,ms:int>>"""


def guarded(files: DataFrame, content: str = "content", most: int = P.MAX_UPLOAD) -> DataFrame:
    """files with `verdict`: accepted up to `most` bytes."""
    return files.withColumn("verdict", F.when(F.octet_length(content) <= most, "accepted").otherwise("too large"))


def uploads(spark: SparkSession, path: str, most: int = P.MAX_UPLOAD, strict: bool = False) -> DataFrame:
    """Files under a path with their bytes; longer ones are left out before they are read, or raise if strict."""
    files = spark.read.format("binaryFile").load(path)
    if strict:
        return files.filter(F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("too large: "), "path"))).otherwise(F.lit(True)))
    return files.filter(F.col("length") <= most)


def sidecar(text: Column, schema: str) -> Column:
    """JSON by a schema; null where it can't be parsed."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def challenges(text: Column) -> Column:
    """A sidecar's challenges: a list gives each, an object itself, anything else none."""
    one = "kind string, t0 long, expected string, sequence array<struct<color:string,ms:int>>"
    head = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 1)
    listed = F.from_json(text, f"array<struct<{_inline(one)}>>")
    single = F.from_json(text, f"struct<{_inline(one)}>")
    found = F.when(head == "[", listed).when((head == "{") & single["kind"].isNotNull(), F.array(single))
    return F.coalesce(found, F.array().cast(f"array<struct<{_inline(one)}>>"))


def _inline(fields: str) -> str:
    depth, parts, at = 0, [], ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(at)
            at = ""
        else:
            at += c
    return ",".join(":".join(p.strip().split(" ", 1)) for p in [*parts, at])


def messages(text: Column) -> Column:
    return F.from_json(text, MESSAGE)


def read_weights(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """feature: (weight, neutral) from a JSON object of weights and neutral_values: a file of a few dozen numbers."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "weights map<string,double>, neutral_values map<string,double>").alias("c")).select("c.*").first()
    return {k: (w, (row["neutral_values"] or {}).get(k, 0.0)) for k, w in (row["weights"] or {}).items()}


def read_knots(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "points array<array<double>>").alias("c")).first()
    return sorted(tuple(p) for p in row["c"]["points"] or [])


def manifest(parts: DataFrame) -> DataFrame:
    """file, label and original from manifest documents (part, value): later parts win, a file without original is its own."""
    rows = parts.select("part", F.explode(F.from_json("value", "map<string,struct<label:string,split:string,original:string>>")).alias("file", "m"))
    last = rows.groupBy("file").agg(F.max_by("m", "part").alias("m"))
    return last.select("file", F.col("m.label").alias("label"), F.coalesce("m.original", "file").alias("original"))


def existing(rows: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """Rows whose file is there (semi join on names)."""
    return rows.join(files.select(F.col("file").alias(key)).distinct(), key, "left_semi")


def pending(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows without output yet (anti join)."""
    return rows.join(done.select(key), key, "left_anti")


def write_cases(cases: DataFrame, path: str) -> None:
    """Case documents as JSON, a folder for each session; a session's new document replaces its old one."""
    rows = cases.withColumn("risk_score", F.bround("risk_score", 4)).withColumn("window_count", F.size("windows")).withColumn("evidence", F.array_sort("evidence"))
    rows.repartition("session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(path)


def bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id.cast("string")), F.lit(BUCKETS)).cast("int")


def write_buckets(cases: DataFrame, path: str) -> None:
    """Case documents as JSON lines, a folder and a file for each bucket of sessions: as many at most, whatever the sessions."""
    cases.withColumn("bucket", bucket(F.col("session_id"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_cases(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Case documents; the folders of one session, or of its bucket, alone if asked for."""
    rows = spark.read.schema(CASE).json(path)
    if session_id is None:
        return rows
    rows = rows.filter(F.col("session_id") == session_id)
    return rows.filter(F.col("bucket") == bucket(F.lit(session_id))) if "bucket" in rows.columns else rows


def expired_cases(cases: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    return cases.filter(F.col("created_at") < now - F.lit(ttl_hours * 3600))


def evict_cases(spark: SparkSession, path: str, now: float, ttl_hours: float) -> int:
    """Takes expired case documents away, and nothing else; returns how many went.

    A session's own folder is deleted. A bucket's file that has others too is written anew without the expired, and the old
    file is deleted when the new one is in its place: a failure between leaves some expired cases, or documents twice, for
    the next run, and the newest of a session counts. Files' names come to the driver a row at a time, as only the driver deletes.
    """
    cases = read_cases(spark, path)
    rows = cases.withColumn("file", F.input_file_name())
    gone = expired_cases(rows, F.lit(now), ttl_hours).groupBy("file").agg(F.count("*").alias("n"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, n, root = spark.sparkContext._jsc.hadoopConfiguration(), 0, hadoop.Path(path)
    if "bucket" not in cases.columns:
        for row in gone.toLocalIterator():
            folder = hadoop.Path(row.file).getParent()
            n += int(folder.getFileSystem(conf).delete(folder, True))
        return n
    # What goes is fixed before a file changes.
    gone = staged(gone, "expired")
    kept = rows.join(gone, "file", "left_semi").filter(~F.coalesce(F.col("created_at") < now - ttl_hours * 3600, F.lit(False))).drop("file")
    places = [c for c in ("batch", "bucket") if c in kept.columns]
    fresh = hadoop.Path(f"{path}/_staged/kept-{uuid.uuid4().hex}")
    files = fresh.getFileSystem(conf)
    kept.repartition(*places).write.partitionBy(*places).json(fresh.toString())
    found, made = files.listFiles(fresh, True), []
    while found.hasNext():
        made.append(found.next().getPath())
    for file in made:
        if file.getName().startswith("part-"):
            folder = "/".join([root.toString(), *file.toString().split("/")[-1 - len(places) : -1]])
            if not files.rename(file, hadoop.Path(f"{folder}/{file.getName()}")):
                raise OSError(f"{file} can't be renamed into {folder}")
    for row in gone.toLocalIterator():
        if files.delete(hadoop.Path(row.file), False):
            n += row.n
    files.delete(fresh, True)
    return n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; a temporary one in local mode alone, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it is computed once, and lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str, name: str, batch: int, write) -> bool:
    """Have write(folder) make a batch's files and rename them to their place; False if they are there already."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staged, place = hadoop.Path(f"{path}/_staged/{name}-{batch}"), hadoop.Path(f"{path}/batch={name}-{batch}")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place):
        return False
    write(staged.toString())
    if not any(f.isDirectory() for f in files.listStatus(staged)):
        files.delete(staged, True)  # no session ended
        return False
    if not files.rename(staged, place) and not files.exists(place):
        raise OSError(f"{staged} can't be renamed to {place}")
    return True
