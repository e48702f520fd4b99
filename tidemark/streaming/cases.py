"""From a session's last row to its stored case: documents from keyed state, and a sink that takes each batch once.

The sink writes a batch to a folder that readers don't see and renames it to its place, named by the query and the batch's
number; a batch whose place is taken is done already. So whatever point a run is killed at, running it again leaves
one document for each end of a session. The newest document of a session counts. A batch has at most `io.BUCKETS` folders,
by a hash of the session, however many sessions end in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tidemark.operators.explain import summary
from tidemark.sources import io
from tidemark.streaming.live import IdleKeys

FINDING = ["id", "severity", "title", "detail"]
#: at, risk, category and consent of a session without rows
NEW = (0.0, None, None, None)
ENDED = """session_id string, created_at long, consent_status string, stubs_in_use boolean, risk_score double, category string,
findings array<struct<id:string,severity:string,title:string,detail:string,t:double>>, windows array<struct<window_id:int,risk:double>>"""


class Sessions(IdleKeys):
    def __init__(self, idle_ms: int | None, stubs: bool):
        self.idle_ms, self.stubs = idle_ms, stubs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", "window_id int, risk double")
        self.findings = handle.getListState("findings", "id string, severity string, title string, detail string, t double")
        self.last = handle.getValueState("last", "at double, risk double, category string, consent string")

    def ended(self, session: str, last: tuple, windows: list[tuple], findings: list[tuple], known: bool) -> Row:
        """The case of a session: what its state has (nothing if it isn't known), then the rows that state hasn't seen."""
        at, risk, category, consent = last
        if known:
            windows, findings = [*self.windows.get(), *windows], [*self.findings.get(), *findings]
            for state in (self.windows, self.findings, self.last):
                state.clear()
        windows = [{"window_id": w, "risk": r} for w, r in windows]
        findings = [dict(zip([*FINDING, "t"], f, strict=True)) for f in findings]
        return Row(
            session_id=session, created_at=int(at), consent_status=consent or "consented", stubs_in_use=self.stubs, risk_score=risk or 0.0, category=category or "Authentic", findings=findings, windows=windows,
        )

    def handleInputRows(self, key, rows, timerValues):
        old = self.last.get()
        windows, findings, last, over = [], [], old or NEW, False
        known = lambda new, old: old if new is None or new != new else new
        # A trigger's rows of one session, in their order; of rows at one time that which ends it is the last.
        for _, at, window_id, risk, category, consent, finding, ended in sorted(rows, key=lambda r: (r[1], r[7])):
            last = (max(at, last[0]), known(risk, last[1]), known(category, last[2]), known(consent, last[3]))
            if window_id is not None:
                windows.append((window_id, known(risk, None)))
            if finding is not None:
                findings.append((*[finding[c] for c in FINDING], at))
            over = over or ended
        if over:
            # Rows that end their session need not pass through its state.
            self.untimed()
            yield self.ended(key[0], last, windows, findings, old is not None)
            return
        if windows:
            self.windows.appendList(windows)
        if findings:
            self.findings.appendList(findings)
        self.last.update(last)
        self.touched(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.last.get()
        yield self.ended(key[0], old or NEW, [], [], old is not None)

    def close(self) -> None:
        pass


def case_documents(stream: DataFrame, idle_ms: int | None = None, stubs: bool = False) -> DataFrame:
    """A case for each session at its end: a row that says so, or no row for idle_ms.

    stream: session_id, at (seconds), window_id, risk, category, consent, a finding's id, severity, title and detail, ended;
    all but the first two may be null. The last known risk and category stand; a session has as many windows as its length
    bounds. Rows after the end begin a new case. The summary names at most two titles of the highest severity there is.
    """
    kinds = {"session_id": "string", "at": "double", "window_id": "int", "risk": "double", "category": "string", "consent": "string"}
    finding = F.when(F.col("id").isNotNull(), F.struct(*[F.col(c).cast("string").alias(c) for c in FINDING])).alias("finding")
    rows = stream.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], finding, F.coalesce(F.col("ended"), F.lit(False)).alias("ended"))
    cases = rows.groupBy("session_id").transformWithState(Sessions(idle_ms, stubs), ENDED, "append", "ProcessingTime" if idle_ms else "None")
    titles = lambda s: F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"] == s), lambda f: f["title"]))
    cases = cases.withColumn("summary", summary(F.col("risk_score"), F.col("category"), titles("high"), titles("medium")))
    return cases.withColumn("risk_score", F.bround("risk_score", 4)).withColumn("window_count", F.size("windows")).withColumn("evidence", F.array().cast("array<string>"))


def store_cases(cases: DataFrame, path: str, checkpoint: str, name: str) -> None:
    """Run a stream of case documents into a folder over all there is. name: the query's, the same at every run."""

    def take(rows: DataFrame, batch: int) -> None:
        # One action alone: another would run the batch's state a second time.
        io.committed(rows.sparkSession, path, name, batch, lambda folder: io.write_buckets(rows, folder))

    cases.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored_cases(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """The newest document of each session (or of one: the folders of its bucket alone are read)."""
    rows = io.read_cases(spark, path, session_id)
    names = [f.name for f in spark.createDataFrame([], io.CASE).schema if f.name != "session_id"]
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*names), F.struct("created_at", "batch")).alias("case"))
    return newest.select("session_id", "case.*")
