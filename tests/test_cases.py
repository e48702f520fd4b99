"""A session's end reaches the store once, wherever a run is killed."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.streaming import cases, live, streams

KINDS = "session_id string, at double, window_id int, risk double, category string, consent string, id string, severity string, title string, detail string, ended boolean"


@pytest.fixture
def own(spark):
    session = live.stateful_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


@pytest.fixture
def folder(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def window(s, i, risk, ended=None, **finding):
    f = {"id": None, "severity": None, "title": None, "detail": None} | finding
    return (s, float(i), i, risk, "Suspicious" if risk and risk > 0.5 else "Authentic", "consented", *f.values(), ended)


FILES = [
    [window("a", 0, 0.2), window("b", 1, 0.61, id="face", severity="high", title="Face", detail="d")],
    [window("a", 2, None), window("b", 3, 0.7, ended=True), window("c", 4, 0.1)],
    [window("a", 5, 0.30004, id="lips", severity="medium", title="Lips", detail="d"), ("a", 6.0, *[None] * 8, True), window("b", 7, 0.1)],
]


def put(spark, folder, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(folder("in"))


def run(own, spark, folder, **more):
    stream = streams.read_events(own, folder("in"), spark.createDataFrame([], KINDS).schema)
    cases.store_cases(cases.case_documents(stream, **more), folder("cases"), folder("state"), "ends")


def documents(spark, folder):
    return spark.read.schema(io.CASE).json(folder("cases")).groupBy("session_id").count().collect()


@pytest.mark.parametrize("killed", ["before", "after", None])
def test_one_document_a_session(spark, own, folder, monkeypatch, killed):
    for rows in FILES:
        put(spark, folder, rows)
    real = io.committed

    def dies(session, path, name, batch, write):
        if killed == "after":
            real(session, path, name, batch, write)
        else:
            write(f"{path}/_staged/{name}-{batch}")
        raise RuntimeError("killed")

    if killed:
        monkeypatch.setattr(io, "committed", dies)
        for _ in range(2):
            with pytest.raises(Exception, match="killed"):
                run(own, spark, folder)
        monkeypatch.setattr(io, "committed", real)
    run(own, spark, folder)
    run(own, spark, folder)
    assert {(r.session_id, r["count"]) for r in documents(spark, folder)} == {("a", 1), ("b", 1)}
    a, b = sorted(cases.stored_cases(spark, folder("cases")).collect())
    assert (a.risk_score, a.category, a.window_count, a.created_at, a.consent_status) == (0.3, "Authentic", 3, 6, "consented")
    assert [w.risk for w in a.windows] == [0.2, None, 0.30004] and [f.title for f in a.findings] == ["Lips"] and "risk of 30% (Authentic)" in a.summary and "'Lips'" in a.summary
    assert (b.risk_score, b.category, b.window_count) == (0.7, "Suspicious", 2) and "'Face'" in b.summary
    # A session that comes again has a newer document, which counts; expired ones go.
    put(spark, folder, [("b", 9.0, *[None] * 8, True)])
    run(own, spark, folder)
    assert {(r.session_id, r["count"]) for r in documents(spark, folder)} == {("a", 1), ("b", 2)}
    assert cases.stored_cases(spark, folder("cases"), "b").select("created_at", "window_count").collect() == [(9, 1)]
    assert io.evict_cases(spark, folder("cases"), 3600 + 7, 1.0) == 2
    assert [r.session_id for r in cases.stored_cases(spark, folder("cases")).collect()] == ["b"]


def test_idle_sessions_end(spark, own, folder):
    put(spark, folder, FILES[0])
    run(own, spark, folder, idle_ms=300)
    time.sleep(1)
    put(spark, folder, [window("z", 9, 0.1)])
    run(own, spark, folder, idle_ms=300)
    assert {r.session_id for r in cases.stored_cases(spark, folder("cases")).collect()} >= {"a", "b"}


def test_folders_are_bounded_whatever_the_sessions(spark, own, folder, tmp_path):
    """A folder a session made folders, files and listings grow with the sessions (F9)."""
    many = io.BUCKETS * 4
    put(spark, folder, [window(f"s{i:04d}", i, 0.2, ended=True) for i in range(many)])
    run(own, spark, folder)
    (batch,) = (tmp_path / "cases").glob("batch=*")
    names = sorted(p.name for p in batch.iterdir() if p.is_dir())
    assert 0 < len(names) <= io.BUCKETS and all(n.startswith("bucket=") for n in names) and len(list(batch.rglob("*.json"))) == len(names)
    assert {(r.session_id, r["count"]) for r in documents(spark, folder)} == {(f"s{i:04d}", 1) for i in range(many)}
    one = cases.stored_cases(spark, folder("cases"), "s0007")
    assert [(r.session_id, r.created_at) for r in one.collect()] == [("s0007", 7)]
    own_file = [p for p in batch.rglob("*.json") if '"s0007"' in p.read_text()]
    assert [p.parent.name for p in own_file] == [f"bucket={spark.range(1).select(io.bucket(F.lit('s0007'))).first()[0]}"]
    for p in batch.rglob("*.json"):
        if p not in own_file:
            p.write_text("no file that this session needs")
    assert [(r.session_id, r.created_at) for r in cases.stored_cases(spark, folder("cases"), "s0007").collect()] == [("s0007", 7)]


def test_expired_documents_leave_the_others_of_their_file(spark, own, folder):
    many = io.BUCKETS * 2
    put(spark, folder, [window(f"s{i:04d}", i, 0.2, ended=True, id="face", severity="high", title="Face") for i in range(many)])
    run(own, spark, folder)
    before = {r.session_id: r for r in cases.stored_cases(spark, folder("cases")).collect()}
    assert len(before) == many
    assert io.evict_cases(spark, folder("cases"), 3600 + 100, 1.0) == 100
    assert {r.session_id: r for r in cases.stored_cases(spark, folder("cases")).collect()} == {k: r for k, r in before.items() if k >= "s0100"}
    assert {r["count"] for r in documents(spark, folder)} == {1}
    assert io.evict_cases(spark, folder("cases"), 3600 + 100, 1.0) == 0


class State:
    """Keeps nothing and says what was asked of it."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a: self.calls.append(name)


def test_rows_that_end_their_session_dont_pass_through_state():
    s = cases.Sessions(None, False)
    s.windows, s.findings, s.last = State(), State(), State()
    finding = {"id": "lips", "severity": "medium", "title": "Lips", "detail": None}
    # Of two rows at one time that which ends the session has the last word.
    rows = [("a", 2.0, 3, 0.7, "x", None, None, True), ("a", 2.0, 2, 0.1, "y", None, finding, False), ("a", 1.0, 1, None, None, "given", None, False)]
    (got,) = s.handleInputRows(("a",), iter(rows), None)
    assert (got.session_id, got.created_at, got.risk_score, got.category, got.consent_status) == ("a", 2, 0.7, "x", "given")
    assert [(w["window_id"], w["risk"]) for w in got.windows] == [(1, None), (2, 0.1), (3, 0.7)] and got.findings == [finding | {"t": 2.0}]
    assert s.last.calls == ["get"] and not s.windows.calls and not s.findings.calls
