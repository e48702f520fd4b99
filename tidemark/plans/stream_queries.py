"""Metrics and stored cases from streams over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import params as P
from tidemark.plans.registry import query
from tidemark.plans.signal_queries import _scratch
from tidemark.streaming import cases as K
from tidemark.streaming import live as L
from tidemark.streaming import metrics as Q
from tidemark.streaming import streams as R

LATENCY_BOUNDS = [5.0, 25.0, 50.0, 100.0, 200.0]
MEASURED = [
    "SELECT 'errors' AS name, NULL::VARCHAR AS le, count(*) FILTER (event_type = 'error')::DOUBLE AS value FROM events",
    "SELECT 'stream_rows', NULL, count(*) FROM events",
    "SELECT 'latency_sum', NULL, round(sum(value), 4) FROM events",
    *[f"SELECT 'latency_bucket', '{b}', count(*) FILTER (value <= {b}) FROM events" for b in LATENCY_BOUNDS],
    "SELECT 'latency_bucket', '+Inf', count(value) FROM events",
]


@query(" UNION ALL ".join(MEASURED))
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream over the events, taken while its windows are made."""
    own, meter = L.stateful_session(spark), Q.Meter()
    taken = Q.measures({"errors": F.col("event_type") == "error"}, {"latest": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6}, {"latency": (F.col("value"), LATENCY_BOUNDS)})
    rows = L.table_stream(own, f"{sf_dir}/events.parquet").observe("events", *taken)
    own.streams.addListener(meter)
    try:
        out = R.hopping(rows, "ts", "event_type", "value", "3 hours", "1 hour", "400 days")
        out.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{_scratch(spark)}/state").trigger(availableNow=True).start().awaitTermination()
        meter.ended()
    finally:
        own.streams.removeListener(meter)
    # A few numbers, whatever the table.
    found = [(n, b, round(v, 4)) for kind, n, b, v in meter.rows() if kind == "counter"]
    return spark.createDataFrame(found, "name string, le string, value double")


CASE_SQL = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
z AS (SELECT user_id, least(value / 100, 1.0::DOUBLE) AS risk FROM e WHERE back = 1),
f AS (SELECT user_id, count(*) AS windows, count(*) FILTER (event_type = 'error') AS findings, count(*) FILTER (event_type = 'error' AND value > 100) AS high FROM e GROUP BY 1),
c AS (SELECT *, CASE WHEN risk >= {P.ENTER} THEN '{P.LIKELY}' WHEN risk >= 0.4 THEN '{P.DOUBTFUL}' ELSE '{P.GENUINE}' END AS category FROM z JOIN f USING (user_id))
SELECT CAST(user_id AS VARCHAR) AS session_id, round_even(risk, 4) AS risk_score, category, windows AS window_count, findings,
'Verification session completed with an assessed deepfake risk of ' || CAST(round_even(round_even(risk, 4) * 100, 0) AS INTEGER) || '% (' || category || '). ' ||
CASE WHEN findings = 0 THEN '{P.NO_FINDINGS}' ELSE 'Primary anomalies observed include ''' || CASE WHEN high > 0 THEN 'Slow errors' ELSE 'Errors' END || ''' across active analysis windows.' END || ' ' ||
CASE category WHEN '{P.LIKELY}' THEN '{P.ADVICE[P.LIKELY]}' WHEN '{P.DOUBTFUL}' THEN '{P.ADVICE[P.DOUBTFUL]}' ELSE '{P.ADVICE[P.GENUINE]}' END AS summary FROM c"""


@query(CASE_SQL)
def session_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as a stream of session rows; a user's last event ends the session, and the stored cases are read back."""
    own, at = L.stateful_session(spark), _scratch(spark)
    last = own.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("user_id", F.col("last.event_id").alias("last_id"))
    rows = R.with_known(L.table_stream(own, f"{sf_dir}/events.parquet"), last, "user_id")
    risk, error = F.least(F.col("value") / 100, F.lit(1.0)), F.col("event_type") == "error"
    severity = F.when(error & (F.col("value") > 100), "high").when(error, "medium")
    rows = rows.select(
        F.col("user_id").cast("string").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("window_id"), risk.alias("risk"),
        F.when(risk >= P.ENTER, P.LIKELY).when(risk >= 0.4, P.DOUBTFUL).otherwise(P.GENUINE).alias("category"), F.lit("consented").alias("consent"), F.when(error, "error").alias("id"), severity.alias("severity"),
        F.when(severity == "high", "Slow errors").when(error, "Errors").alias("title"), F.lit(None).cast("string").alias("detail"), (F.col("event_id") == F.col("last_id")).alias("ended"),
    )
    K.store_cases(K.case_documents(rows), f"{at}/cases", f"{at}/state", "session_cases")
    return K.stored_cases(spark, f"{at}/cases").select("session_id", "risk_score", "category", F.col("window_count").cast("long").alias("window_count"), F.size("findings").cast("long").alias("findings"), "summary")
