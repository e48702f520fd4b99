"""Signals and pictures made of the driver's tables, and streams over its events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import augment as A
from tidemark.operators import jpeg as J
from tidemark.operators import pixels as X
from tidemark.operators import preprocess as PP
from tidemark.operators import signals as G
from tidemark.operators import tensors as TE
from tidemark.operators import windows as W
from tidemark.plans.base_queries import events, windows_sql
from tidemark.plans import params as P  # noqa: F401
from tidemark.plans.registry import query, table
from tidemark.sources.io import shared_folder, staged
from tidemark.streaming import live as L
from tidemark.streaming import streams as R

COLOURS = ["#ffffff", "#ff4d4d", "#4d79ff", "#4dff88", "#ffb84d", "#b84dff"]


LIGHT_FRAMES = 16


def light_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a user's events as answers to coloured light: even users' faces follow the colours, with the events' values as noise; odd users' are noise alone."""
    e = events(spark, sf_dir).withColumn("noise", (F.coalesce("value", F.lit(0.0)) % 10 - 5) / 5)
    w = W.window_arrays(W.count_windows(e, "user_id", ["ts", "event_id"], LIGHT_FRAMES, LIGHT_FRAMES), "user_id", ["noise", "event_id"])
    sequence = F.array(*[F.struct(F.lit(c).alias("color"), F.lit(350).alias("ms")) for c in COLOURS])
    rows = w.withColumn("sequence", sequence).withColumn("real", F.col("user_id") % 2 == 0)
    weight, spread = F.when(F.col("real"), 0.2).otherwise(0.0), F.when(F.col("real"), 0.01).otherwise(0.04)
    rows = rows.withColumn("target", G.target_series(F.col("sequence"), F.lit(LIGHT_FRAMES)))
    # Each channel has the noise of another place, so that channels disagree.
    noise = {p: C.roll(F.col("noise"), k) for p, k in (("cr", 0), ("cg", 5), ("luma", 9))}

    def made(part: str, centre: float, middle: float, scale: float) -> Column:
        return F.zip_with(F.col("target")[part], noise[part], lambda t, x: centre + weight * (t - middle) + spread * scale * x)

    face = F.arrays_zip(made("cr", 0.38, 0.333, 1.0).alias("cr"), made("cg", 0.33, 0.333, 1.0).alias("cg"), made("luma", 120.0, 128.0, 300.0).alias("y"))
    face = F.transform(face, lambda f: F.struct(f["cr"].alias("cr"), f["cg"].alias("cg"), *[f["y"].alias(f"mean_{c}") for c in "rgb"]))
    rows = rows.withColumn("face", face)
    neck = F.transform(F.col("face"), lambda f, i: F.struct((0.3 + 0.5 * (f["cr"] - 0.38) + 0.002 * (i % 3)).alias("cr"), *[f[c].alias(c) for c in ("cg", "mean_r", "mean_g", "mean_b")]))
    return rows.select("user_id", "window_id", "real", "face", F.when(F.col("user_id") % 3 > 0, neck).alias("neck"), "sequence")


@query()
def light_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.light_response(light_cases(spark, sf_dir), F.col("face"), F.col("neck"), F.col("sequence"), F.lit("agent"), "l").select("user_id", "window_id", "real", "l.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("score", "corr_face", "lag_ms", "neck_face_corr", "neck_face_ratio", "snr")}).withColumn("flags", F.array_join("flags", ","))


SOUND_RATE, SOUND_FPS = 60, 15


def sounding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sound of four samples a frame, with a mouth that opens as loud as the sound, -4 to 4 frames late by vec_id."""
    v = F.transform(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: F.coalesce(x, F.lit(0.0)).cast("double"))
    pcm = F.transform(v, lambda x: F.floor(x * 8000).cast("int"))
    frames = F.floor(F.size(v) / (SOUND_RATE // SOUND_FPS)).cast("int")
    loud = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.sqrt(C.mean(F.transform(F.slice(v, i * 4 + 1, F.lit(4)), lambda x: x * x))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 9 - 4).cast("int").alias("lag"), pcm.alias("pcm"), F.when(frames > 0, loud).alias("loud"))
    return rows.select("vec_id", "lag", "pcm", C.roll(F.col("loud"), F.col("lag")).alias("mouth"))


@query()
def av_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sounding_vectors(spark, sf_dir).withColumn("s", G.av_sync(F.col("pcm"), F.col("mouth"), SOUND_RATE, SOUND_FPS))
    return rows.select("vec_id", "lag", F.round("s.conf", 6).alias("conf"), F.round("s.offset_ms", 6).alias("offset_ms"), "s.in_sync")


@query("""WITH q AS (SELECT user_id, avg(value) AS blur, 2 * avg(value) AS brightness, count(*) / 1000.0::DOUBLE AS face, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS drop_ FROM events GROUP BY 1)
SELECT user_id, round((0.4 * greatest(least((blur - 25) / 95, 1), 0) + 0.3 * (1 - least(abs(brightness - 128) / 100, 1)) + 0.2 * least(face, 1) + 0.1 * (1 - drop_)) * CASE WHEN face < 0.08 THEN 0.4 ELSE 1 END, 6) AS trust,
array_to_string(list_filter([CASE WHEN blur < 40 THEN 'MOTION_BLUR' END, CASE WHEN brightness < 35 THEN 'POOR_LIGHTING_DARK' END, CASE WHEN brightness > 225 THEN 'POOR_LIGHTING_OVEREXPOSED' END, CASE WHEN face < 0.08 THEN 'FACE_NOT_VISIBLE' END], lambda f: f IS NOT NULL), ',') AS flags FROM q""")
def quality_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("blur"), (2 * F.avg("value")).alias("brightness"), (F.count("*") / 1000.0).alias("face"), F.avg((F.col("event_type") == "error").cast("double")).alias("drop"))
    q = e.select("user_id", G.quality(F.col("blur"), F.col("brightness"), F.col("face"), F.col("drop")).alias("q"))
    return q.select("user_id", F.round("q.trust", 6).alias("trust"), F.array_join("q.flags", ",").alias("flags"))


@query("""WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value > 40 AS s FROM events),
v AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS walk FROM w)
SELECT event_id, CAST(walk - least(0, min(walk) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS frozen FROM v""")
def static_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("still", F.col("value") > 40)
    return G.frozen_count(e, "user_id", "event_id", "still").select("event_id", "frozen")


#: Windows that a Python worker is given at a time: one is 48 kB and its crops may be six times that.
WINDOWS_A_BATCH = 64
#: The same for windows without their repetitions, which have 4 kB in the middle.
TEXTS_A_BATCH = 128


def picture_session(spark: SparkSession, windows: int = WINDOWS_A_BATCH) -> SparkSession:
    """A session with spark's settings whose Arrow batches are small, since rows hold pictures."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", windows)
    return own


def page_texts(spark: SparkSession, sf_dir: str, windows: int = TEXTS_A_BATCH) -> DataFrame:
    """page_pictures, but a page shorter than a window is there once.

    A window takes so much longer to look at than to read that a file's windows are dealt to all cores.
    """
    box = F.struct((12 + F.col("page_id") % 5).cast("int").alias("x"), F.lit(12).alias("y"), F.lit(36).alias("w"), F.lit(36).alias("h"))
    own = picture_session(spark, windows)
    parts = max(4 * own.sparkContext.defaultParallelism, int(own.conf.get("spark.sql.shuffle.partitions")))
    return X.cut_windows(table(own, sf_dir, "pages").select("page_id", "html"), "html", 4, 64).drop("html").repartition(parts, "page_id", "window").withColumn("box", box)


def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of pictures from the bytes of pages, with a face box that moves with the page."""
    return X.filled(page_texts(spark, sf_dir, WINDOWS_A_BATCH))


@query()
def preprocessed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = PP.preprocessed(page_pictures(spark, sf_dir), ["page_id", "window"])
    parts = [F.round(F.col(f"{r}.{c}"), 9).alias(f"{r}_{c}") for r in ("face", "neck", "background") for c in ("cr", "cg", "mean_r", "mean_g", "mean_b")]
    return frames.select("page_id", "window", "frame", F.round("blur", 6).alias("blur"), F.round("brightness", 6).alias("brightness"), *parts, F.sha2("crop", 256).alias("crop_digest"))


@query()
def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps of pages' middle pictures as JPEG files in the shared folder, with the files' digests."""
    rows = page_pictures(spark, sf_dir).withColumn("heat", TE.evidence(F.col("rgb"), 64, F.lit(1.0)))
    files = J.jpeg(rows.select("page_id", "window", "heat", "height", "width"), "heat", "height", "width").drop("heat", "height", "width")
    files = staged(files.withColumn("name", F.format_string("%d/evidence/heatmap_w%03d.jpg", "page_id", "window")), "evidence")
    written = J.write_files(files, "name", "jpeg", f"{_scratch(spark)}/cases")
    # The digests meet the sizes; the files themselves aren't shuffled.
    digests = files.select("page_id", "window", "name", F.sha2("jpeg", 256).alias("digest"))
    return digests.join(written, "name").select("page_id", "window", "name", "size", "digest")


@query()
def augmented_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded and blended windows of pages, as digests with what was drawn for them."""
    rows = A.augmented(page_pictures(spark, sf_dir), ["page_id", "window"])
    drawn = [F.round(c, 9).alias(c) for c in ("rescale", "contrast", "brightness", "noise")]
    return rows.select("page_id", "window", *drawn, "quality", "gauss", "motion", "freeze", "long_freeze", F.sha2("degraded", 256).alias("degraded"), F.sha2("blended", 256).alias("blended"))


@query()
def picture_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = X.picture_cues(page_texts(spark, sf_dir), ["page_id", "window"], repeated=True)
    return cues.withColumn("r", X.replay()).withColumn("s", X.static_face()).select("page_id", "window", *[F.round(c, 6).alias(c) for c in X.CUES], "r.*", "s.static").withColumn("flags", F.array_join("flags", ","))


@query("""SELECT h.s AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events,
LATERAL (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS s) h GROUP BY 1, 2""")
def stream_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hopping windows of the batch query from a stream over the table's files: each trigger writes the windows that it changed, the last writing counts."""
    own, at = L.stateful_session(spark), _scratch(spark)
    out = R.hopping(L.table_stream(own, f"{sf_dir}/events.parquet"), "ts", "event_type", "value", "3 hours", "1 hour", "400 days")
    # A trigger that is run again writes its own folder again.
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
    out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("last"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "last.n", F.round("last.mean_value", 6).alias("mean_value"))


@query(f"WITH {windows_sql(45, 15)} SELECT user_id, window_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n, round(avg(value), 6) AS mean_value FROM x GROUP BY 1, 2")
def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as a stream of the events makes them, each as soon as it is complete."""
    own, at = L.stateful_session(spark), _scratch(spark)
    windows = L.live_windows(L.table_stream(own, f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], ["value"])
    R.drained(windows, f"{at}/out", f"{at}/state")
    rows = spark.read.schema(windows.schema).parquet(f"{at}/out")
    mean = C.mean(F.filter("value", lambda x: x.isNotNull()))
    return rows.select("user_id", "window_id", F.array_min("event_id").alias("first_event"), F.array_max("event_id").alias("last_event"), F.size("event_id").cast("long").alias("n"), F.round(mean, 6).alias("mean_value"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, count(*) AS n, min(event_id) AS least_event, round(sum(value), 6) AS total FROM r WHERE back <= {L.RETAINED} GROUP BY 1""")
def live_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's ring holds when the stream has taken all events."""
    own, at = L.stateful_session(spark), _scratch(spark)
    R.drained(L.live_windows(L.table_stream(own, f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], ["value"]), f"{at}/out", f"{at}/state")
    return L.ring_rows(own, f"{at}/state").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"), F.round(F.sum("value"), 6).alias("total"))


@query()
def overload_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as windows for a consumer that needs their value in minutes: which it takes and which are dropped."""
    own, at = L.stateful_session(spark), _scratch(spark)
    rows = L.table_stream(own, f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.coalesce("value", F.lit(0.0)) * 60 * 60).alias("cost"))
    fates = L.bounded_queue(rows, "user_id", "at", "cost", "event_id")
    R.drained(fates, f"{at}/out", f"{at}/state")
    return spark.read.schema(fates.schema).parquet(f"{at}/out")


def _scratch(spark: SparkSession) -> str:
    """A new folder for a stream's files and state."""
    return f"{shared_folder(spark)}/tidemark-streams/run-{uuid.uuid4().hex}"
