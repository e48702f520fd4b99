"""Scores, verdicts, findings, signals and sources on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluation, events, explain, fusion, joins, modules, session, signals, tensors, text
from tidemark.operators import windows as W
from tidemark.plans import params as P
from tidemark.sources import io


def one(spark, column, row=None):
    frame = spark.range(1) if row is None else row
    return frame.select(column.alias("x")).first().x


def test_even_sample_places(spark):
    got = one(spark, C.even_sample(F.sequence(F.lit(0), F.lit(44)), 45, 16))
    assert got == [k * 44 // 15 for k in range(16)]


def test_twenty_seconds_give_eighteen_windows(spark):
    frames = spark.range(300).select(F.lit("s").alias("session"), "id")
    w = W.count_windows(frames, "session", ["id"]).groupBy("window_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).orderBy("window_id").collect()
    assert [x.window_id for x in w] == list(range(1, 19)) and all(x.n == 45 and x.first == 15 * (x.window_id - 1) for x in w)
    kept = W.count_windows(frames, "session", ["id"], retain=75)
    assert kept.select("window_id").distinct().count() == 3 and kept.agg(F.min("id")).first()[0] == 225


def test_word_error_rate(spark):
    cases = [("a b c", "a b c", 0.0), ("a b c", "a x c", 1 / 3), ("a b", "a q b r", 1.0), ("", "", 0.0), ("", "x", 1.0), ("A b", "a B", 0.0), ("a a a", "a", 2 / 3)]
    rows = spark.createDataFrame(cases, "e string, h string, want double")
    for r in rows.select("want", C.word_error_rate(C.words(F.col("e")), C.words(F.col("h"))).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
    # More distinct words than there are code points below the surrogates.
    many = F.transform(F.sequence(F.lit(1), F.lit(57_000)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    other = F.transform(F.sequence(F.lit(3), F.lit(57_000)), lambda i: F.concat(F.lit("W"), F.when(i % 1000 == 0, -i).otherwise(i).cast("string")))
    assert one(spark, C.edit_distance(many, other)) == 2 + 57
    assert one(spark, C.edit_distance(many, F.array(F.lit("x")))) == 57_000
    assert one(spark, C.edit_distance(many, F.lit(None).cast("array<string>"))) is None
    m = one(spark, text.phrase_match(F.lit("blue paper moon"), F.lit(None).cast("string"), F.lit(False)))
    assert m.wer == 0 and m.matched


def test_neutral_windows_are_genuine(spark):
    rows = fusion.scored(fusion.imputed(fusion.complete(spark.range(1)))).first()
    assert rows.logit == pytest.approx(-1.25) and rows.probability == pytest.approx(0.12 + 0.25 / 0.7 * 0.10) and len(rows.missing) == len(P.FEATURES)
    bad = spark.range(1).withColumns({"source_risk": F.lit(0.9), "edge_logit": F.lit(2.0), "spoof_max": F.lit(float("nan")), "replay_score": F.lit(0.8)})
    row = fusion.scored(fusion.imputed(fusion.complete(bad))).withColumn("gates", fusion.gates()).first()
    assert row.logit > 3 and "spoof_max" in row.missing and row.gates == ["replay"] and row.contributions[0].name == "edge_logit"


def test_poor_pictures_dampen(spark):
    base = spark.range(1).withColumns({"edge_logit": F.lit(1.0), "quality_trust": F.lit(0.1)})
    row = fusion.scored(fusion.imputed(fusion.complete(base))).first()
    assert row.logit == pytest.approx(-1.25 + 1.45 * 0.35 - 0.70 * (0.1 - 0.85))


def test_latch_enters_keeps_and_leaves():
    latch = fusion.Latch(alpha=1.0)
    seen = [latch.step(p, []) for p in (0.8, 0.65, 0.8, 0.65, 0.5, 0.5, 0.5, 0.3)]
    assert [s[3] for s in seen] == [False, False, True, True, True, True, False, False]
    assert [s[4] is not None for s in seen] == [False, False, True, False, False, False, False, False]
    assert [s[2] for s in seen][-2:] == [P.DOUBTFUL, P.GENUINE]
    gate = fusion.Latch().step(0.2, ["replay"])
    assert gate[0] == gate[1] == P.GATE_FLOOR and gate[2] == P.LIKELY and gate[4] == P.ACTIONS["replay"]


def test_batch_and_folded_verdicts_agree(spark):
    rows = spark.range(400).select((F.col("id") % 7).alias("key"), F.col("id").alias("n"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("probability"), F.array().cast("array<string>").alias("gates"))
    a = {(r.key, r.n): (round(r.smoothed, 9), r.in_state) for r in fusion.verdicts(rows, "key", "n").collect()}
    b = {(r.key, r.n): (round(r.smoothed, 9), r.in_state) for r in fusion.verdicts_folded(rows, "key", "n").collect()}
    assert a == b and len(a) == 400


def test_findings_escalate_and_rearm():
    m = explain.Memory()
    assert [m.admits("source", s, t) for s, t in ((2, 0), (2, 5), (3, 6), (2, 10), (2, 21), (3, 22))] == [True, False, True, False, True, True]


def test_summary_sentences(spark):
    got = one(spark, explain.summary(F.lit(0.845), F.lit(P.LIKELY), F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array(F.lit("D"))))
    assert "84%" in got and "'A' and 'B'" in got and "'C'" not in got and got.endswith(P.ADVICE[P.LIKELY])
    assert P.NO_FINDINGS in one(spark, explain.summary(F.lit(0.1), F.lit(P.GENUINE), F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert one(spark, explain.acceptable(F.lit("a summary that names 84% of risk"), F.lit(84)))


def test_provenance(spark):
    none = F.lit(None)
    intervals = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    virtual = one(spark, signals.provenance(F.lit(" OBS Virtual Camera"), none, none, none, none))
    assert virtual.risk == 0.85 and virtual.flags == ["VIRTUAL_CAMERA"]
    assert one(spark, signals.provenance(F.lit("Webcam"), intervals(66, 70, 61, 64, 72, 66, 68, 63, 66, 71), none, none, none)).risk == 0
    assert one(spark, signals.provenance(none, intervals(*[66.7] * 30), F.lit(30.0), F.lit(640), F.lit(480))).flags == ["JITTER_TOO_SMOOTH"]
    assert one(spark, signals.provenance(none, intervals(*[10, 10, 10, 10, 10, 10, 40, 40, 40, 40]), F.lit(500.0), F.lit(0), F.lit(480))).flags == ["HIGH_FRAME_DROPS", "ANOMALOUS_FPS", "INVALID_RESOLUTION"]


def test_quality(spark):
    q = lambda *v: one(spark, signals.quality(*[F.lit(float(x)) for x in v]))
    assert q(120, 130, 1, 0).trust > 0.75 and q(15, 130, 1, 0).flags == ["MOTION_BLUR"] and q(120, 20, 1, 0).flags == ["POOR_LIGHTING_DARK"] and q(120, 240, 1, 0).flags == ["POOR_LIGHTING_OVEREXPOSED"] and q(120, 130, 0, 0).trust < 0.60


def test_lip_closure(spark):
    def run(opened, word):
        a = F.array(*[F.lit(0.5 if i == opened else 0.05) for i in range(7)])
        t = F.array(*[F.lit(0.5 * i) for i in range(7)])
        w = F.array(F.struct(F.lit(word).alias("word"), F.lit(1.0).alias("start_sec"), F.lit(1.4).alias("end_sec")))
        return one(spark, signals.lip_closure(a, t, w))

    assert run(5, "paper").passed and not run(2, "Moon").passed and run(2, "Moon").err == pytest.approx(0.38) and run(2, "zebra").passed


def test_modules_missing_is_never_fake(spark):
    skipped = signals.audio_module(F.lit(100), F.lit(900.0), F.lit(9.0))
    ran = signals.appearance_module(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.1), F.lit(0.9))
    got = one(spark, signals.admissible(F.array(skipped, ran)))
    assert "spoof_max" not in got and got["edge_logit"] == 1.0 and got["identity_flicker"] == 0.1


def test_calibration_is_monotone_and_clamped(spark):
    rows = spark.range(-60, 61).select(joins.calibrated(F.col("id") / 10.0).alias("p")).collect()
    values = [r.p for r in rows]
    assert values == sorted(values) and values[0] == 0.02 and values[-1] == 0.98


def test_light_sequences(spark):
    rows = session.light_sequences(spark.createDataFrame([("n1",), ("n2",), ("n1",), (None,)], "nonce string"), "nonce", "secret").collect()
    assert rows[0].sequence == rows[2].sequence != rows[1].sequence and rows[3].sequence is None
    for r in rows[:2]:
        c = [s.color for s in r.sequence]
        assert c[0] == "#ffffff" and len(c) == 7 and all(a != b for a, b in zip(c, c[1:], strict=False)) and all(s.ms >= 333 for s in r.sequence)
    phrase = one(spark, session.phrase(F.lit(5))).split()
    assert {w[0] for w in phrase} == {"B", "P", "M"}


def test_cases_write_read_and_evict(spark, tmp_path):
    path = f"file://{tmp_path}/cases"
    row = lambda s, t: (s, t, "consented", False, 0.123456, "Authentic", "fine", [("face", "high", "T", "D", 1.0)], [(1, 0.5), (2, 0.6)], ["b.jpg", "a.jpg"])
    schema = ", ".join(f.strip() for f in io.CASE.replace("\n", " ").replace("window_count int, ", "").split(" , "))
    io.write_cases(spark.createDataFrame([row("s1", 1000), row("s2", 900_000)], schema), path)
    got = io.read_cases(spark, path, "s1").first()
    assert got.risk_score == 0.1235 and got.window_count == 2 and got.evidence == ["a.jpg", "b.jpg"] and got.findings[0].title == "T"
    assert io.evict_cases(spark, path, 900_100, 1.0) == 1 and [r.session_id for r in io.read_cases(spark, path).collect()] == ["s2"]


def test_sidecars(spark):
    one_light = {"kind": "light", "t0": 5, "sequence": [{"color": "#fff", "ms": 350}]}
    texts = [json.dumps([one_light, {"kind": "phrase", "expected": "x"}]), json.dumps(one_light), "{broken", None, "[]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", io.challenges(F.col("t")).alias("c")).orderBy("i").collect()
    assert [len(r.c) for r in rows] == [2, 1, 0, 0, 0] and rows[0].c[1].expected == "x"


def test_uploads_are_guarded(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 200)
    assert [r.path.rsplit("/", 1)[1] for r in io.uploads(spark, f"file://{tmp_path}/*.bin", 100).collect()] == ["a.bin"]
    with pytest.raises(Exception, match="too large"):
        io.uploads(spark, f"file://{tmp_path}/*.bin", 100, strict=True).collect()


def test_manifest(spark):
    parts = [(0, json.dumps({"a.mp4": {"label": "FAKE", "original": "z.mp4"}, "b.mp4": {"label": "REAL"}})), (1, json.dumps({"a.mp4": {"label": "REAL"}}))]
    got = {r.file: (r.label, r.original) for r in io.manifest(spark.createDataFrame(parts, "part int, value string")).collect()}
    assert got == {"a.mp4": ("REAL", "a.mp4"), "b.mp4": ("REAL", "b.mp4")}


def test_novelty_of_whole_vectors(spark, tmp_path):
    import numpy as np

    from __spark_entry__ import queries
    from tidemark.operators import vectors as V

    x = np.random.default_rng(4).normal(5, 2, (300, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame([*rows, (300, [1.0] * 3), (301, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, cov = x.astype(float) - x.astype(float).mean(0), np.cov(x.astype(float), rowvar=False)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov + 1e-4 * np.eye(64)), d))
    got = {r.vec_id: r.distance for r in queries()["novelty_distance"](spark, str(tmp_path)).collect()}
    assert got.pop(300) is None and got.pop(301) is None
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-6)
    cells = queries()["covariance_whole"](spark, str(tmp_path)).collect()
    assert len(cells) == 64 * 65 // 2 and all(abs(c.covariance - cov[c.i, c.j]) < 1e-6 for c in cells)
    with pytest.raises(ValueError):
        V.moments(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding", 16)


def test_edits_in_blocks():
    import random

    from tidemark.functions.edits import edits

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = random.Random(8)
    for _ in range(400):
        a, b = ([r.randrange(r.choice((2, 9))) for _ in range(r.randrange(40))] for _ in "ab")
        assert {edits(a, b, bits) for bits in (1, 2, 7, 4096)} == {table(a, b)}


def test_word_error_rate_of_whole_turns(spark, tmp_path):
    import random

    from __spark_entry__ import queries

    r = random.Random(2)
    same = [f"w{i}" for i in range(8)]
    turns = [same + [r.choice("abcdefgh") for _ in range(n)] for n in (0, 5, 40, 39, 120, 1)] + [[], ["x"], []]
    rows = [(1, t, "user", " ".join(w)) for t, w in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    want = {t: round(edits(a, b) / len(a), 6) if a else float(bool(b)) for t, (a, b) in enumerate(zip(turns, turns[1:]))}
    assert {x.turn: x.wer for x in queries()["word_error_rate"](spark, str(tmp_path)).collect()} == want


def test_running_totals_of_many_rows(spark):
    """Over a million distinct scores, with columns that either use may do without: ranks and areas equal numpy's."""
    n = 1_200_000
    rows = spark.range(n).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(n * 50)) / 7.0).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).cast("int").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("score") > n * 5, F.col("label")).otherwise(0))
    frame = rows.toPandas()
    score, label = frame["score"].to_numpy(), frame["label"].to_numpy()
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    _, first, counts = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(first + (counts + 1) / 2, counts)
    p = y.sum()
    want = (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    assert evaluation.rank_auc(rows, "score", "label").first().auc == pytest.approx(want, abs=1e-12)
    run = evaluation.running_totals(rows, [F.asc("score"), F.asc("id")], {"seq": F.lit(1), "tp": F.col("label")}).agg(F.countDistinct("seq").alias("n"), F.max("seq").alias("last"), F.max("tp").alias("p")).first()
    assert (run.n, run.last, run.p) == (n, n, p)
    split = evaluation.group_split(rows.select("id"), "id").groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    assert {r.fold: (r.n, r.low, r.high) for r in split.collect()} == {"train": (960_000, 0, 959_999), "test": (240_000, 960_000, n - 1)}
    assert evaluation.roc_by_score(rows, "score", "label").agg(F.countDistinct("seq").alias("a"), F.count("*").alias("b")).first() == (len(first), len(first))


def test_geometry_counter(spark):
    """Frozen windows score .75, then .88; a card at once; a window without crops changes nothing; a lively one takes one off."""
    still, lively, card, none = (1.0, 1.0, 0.1, 0.5), (5.0, 9.0, 0.0, 0.5), (1.0, 9.0, 0.5, 0.5), (None,) * 4
    rows = [(1, i, 0.0, 0.0, float(i), *w) for i, w in enumerate([still, none, still, lively, lively, still, card])]
    windows = spark.createDataFrame(rows, "s int, w int, landmark_jitter double, occlusion double, t double, nonrigid double, eye double, rigid double, corr double")
    got = [(r.geometry.static_face_risk, [f.title for f in r.geometry.findings]) for r in modules.geometry(windows, "s", "w").orderBy("w").collect()]
    static, moved = ["Static 2D Photo Attack Detected"], ["Rigid 2D Photo Motion Detected"]
    assert got == [(0.75, static), (0.0, []), (0.88, static), (0.0, []), (0.0, []), (0.75, static), (0.88, moved)]


def test_findings_of_modules(spark):
    corr, none = F.lit(0.1), F.lit(None).cast("double")
    found = one(spark, F.struct(modules.source_findings(F.lit(0.8), F.lit(0.4), F.lit(3.0), corr, F.lit(True), F.lit(1.005)).alias("f"))).f
    assert [(f.id, f.severity) for f in found] == [("source", "high"), ("source", "medium"), ("light", "high")] and found[0].detail.startswith("Software capture") and found[0].t == 1.0
    assert one(spark, F.struct(modules.source_findings(F.lit(0.1), none, none, none, F.lit(False), none).alias("f"))).f == []
    assert one(spark, F.struct(modules.speech_findings(F.lit("skipped"), F.lit(0.9), F.lit(2.0), F.lit(300.0), none).alias("f"))).f == []
    assert [f.severity for f in one(spark, F.struct(modules.speech_findings(F.lit("ok"), F.lit(0.0), F.lit(2.0), F.lit(130.0), none).alias("f"))).f] == ["medium"]
    assert one(spark, modules.identity_score(F.lit(0.5), F.lit(0.0), F.lit(0), F.lit(0.2))).flags == ["IDENTITY_FLICKER", "LANDMARK_JITTER"]


def test_sessions_opened_and_admitted(spark):
    rows = spark.createDataFrame([("h", i, i, i + 10) for i in range(6)] + [("h", 6, 10, 20), ("g", 7, 0, 1), ("g", 8, None, 3)], "host string, id int, a int, b int")
    got = sorted(r.id for r in session.admitted(rows, "host", "id", "a", "b", 4).collect())
    assert got == [0, 1, 2, 3, 6, 7]
    made = session.opened(spark.range(3), "id", "secret", F.lit(1000)).collect()
    assert all(r.expires_at == 1300 and not r.used and len(r.nonce) == 32 and len(r.phrase.split()) == 3 and r.sequence[0].color == "#ffffff" for r in made) and len({r.nonce for r in made}) == 3


def test_small_forms(spark):
    row = one(spark, F.struct(events.clock_text(F.lit(3661)).alias("a"), events.numbered_name(F.lit("w"), F.lit(1234)).alias("b"), events.listed_names(F.lit(" a, ,b")).alias("c"), events.tail(F.array(F.lit(1), F.lit(2)), 3).alias("d"), events.middle(F.array().cast("array<int>")).alias("e"), events.patch_colour(*[F.lit(None).cast("double")] * 3).alias("f")))
    assert (row.a, row.b, row.c, row.d, row.e) == ("61:01", "w_1234", ["a", "b"], [1, 2], None) and (row.f.r, row.f.mean_g) == (0.333, 128.0)
    text = json.dumps({"stubs_in_use": False, "models": {"edge": {"file": "e.onnx", "version": "1"}}})
    assert [tuple(r) for r in events.models(spark.createDataFrame([(text,), ("{}",)], "d string"), "d").collect()] == [("edge", "e.onnx", "1", False), (None, None, None, True)]
    cases = spark.createDataFrame([("s", None, None, None, 0.5, None, None)], "session_id string, created_at long, consent_status string, stubs_in_use boolean, risk_score double, summary string, findings array<string>")
    assert tuple(events.case_view(cases).first()) == ("s", 0, "consented", True, 0.5, "", [])


def test_feature_tensors(spark):
    r = np.random.default_rng(3)
    pcm = r.integers(-3000, 3000, 20_000)
    got = tensors.acoustic(pcm)
    part = pcm[-16_000:].astype(np.float32) / np.float32(np.abs(pcm[-16_000:]).max() + 1e-6)
    size = np.log(np.abs(np.fft.rfft(part[640:960] * np.hanning(320))) + 1e-6)
    assert got.shape == (50, 768) and np.allclose(got[2, :161], (size - size.mean()) / (size.std() + 1e-6), atol=1e-3) and np.array_equal(got[:, 161:322], got[:, :161])
    assert np.isfinite(tensors.acoustic(np.zeros(0))).all()
    crops = r.integers(0, 256, (10, 32, 32, 3)).astype(np.uint8)
    seen = tensors.visual(crops)
    assert seen.shape == (8, 512) and np.allclose(np.linalg.norm(seen, axis=1), 1, atol=1e-4)
    assert np.allclose(tensors.shrunk(np.arange(32.0)[None] + np.zeros((32, 1))), np.arange(0.5, 32, 2)[None])
    flat = np.full((8, 8, 3), 90, np.uint8)
    flat[4, 4] = 250
    hot = tensors.heat_map(flat)
    assert hot.shape == (8, 8, 3) and hot[0, 0, 2] > hot[0, 0, 0] and hot[4, 4, 0] > hot[4, 4, 2]
    row = spark.createDataFrame([(1, bytearray(crops.tobytes()), [int(x) for x in pcm[:400]]), (2, bytearray(crops[:3].tobytes()), None)], "i int, crops binary, pcm array<int>")
    found = row.select("i", tensors.acoustic_tensor("pcm").alias("a"), tensors.visual_tensor(F.col("crops"), 32).alias("v"), tensors.evidence(F.col("crops"), 32, F.lit(0.5)).alias("e"), tensors.evidence(F.col("crops"), 32, F.lit(0.3)).alias("n")).orderBy("i").collect()
    assert len(found[0].a) == 38_400 and len(found[0].v) == 4096 and found[1].v is None and found[0].n is None and found[1].n is None
    assert bytes(found[0].e) == tensors.heat_map(crops[5]).tobytes()
    assert tuple(one(spark, tensors.guarded_spoof(F.lit(1.5), F.array(*[F.lit(x) for x in (-100, 100)])))) == (0.5, 0.375) and one(spark, tensors.guarded_spoof(F.lit(1.5), F.array(F.lit(3), F.lit(3)))).spoof_max == 0


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(5)
    values = np.round(r.normal(0, 3, 5001), 1)  # many ties
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.25, 0.5, 0.9501, 1.0):
        assert evaluation.quantile(rows, "v", share).first().cut == pytest.approx(np.quantile(values, share), abs=1e-9)
    assert evaluation.quantile(rows.limit(0), "v", 0.5).first().cut is None


def test_group_quantiles(spark):
    import numpy as np

    from tidemark.operators import evaluation

    r = np.random.default_rng(3)
    groups = {"hot": r.integers(0, 50, 4000).tolist(), "one": [7.0], "two": [1.0, 2.0], None: [5.0, 6.0, 9.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    got = {x.g: (x.low, x.mid, x.top) for x in evaluation.group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    assert got == {g: pytest.approx(tuple(np.quantile(vs, [0.05, 0.5, 1.0]))) for g, vs in groups.items()}


def test_stored_moments(spark, tmp_path):
    import numpy as np

    from tidemark.operators import moments as M
    from tidemark.operators import vectors as V

    r = np.random.default_rng(6)
    x = r.standard_normal((300, 12)) @ r.standard_normal((12, 12)) + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None] * 6), (402, [1.0, 2.0]), (403, [])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(9)
    path = f"file://{tmp_path}/moments"
    halves = [frame.filter("id % 3 = 0"), frame.filter("id % 3 > 0")]
    assert M.update(spark, path, halves[0], "v", 1) and M.update(spark, path, halves[1], "v", 2)
    assert not M.update(spark, path, halves[1], "v", 2)  # there already
    n, mean, products = M.state(M.stored(spark, path, 2))
    whole = M.state(M.states_of(frame, "v"))
    assert n == whole[0] == 300 and np.abs(mean - whole[1]).max() < 1e-9 and np.abs(products - whole[2]).max() < 1e-9 * np.abs(whole[2]).max()
    np.testing.assert_allclose(M.covariance((n, mean, products)), np.cov(x.T), rtol=1e-7, atol=1e-6)
    assert M.state(M.stored(spark, path, 2), 2)[0] == 1
    fitted = {d.id: d.distance for d in V.novelty(frame, "id", "v", fitted=(n, mean, products)).collect()}
    fresh = {d.id: d.distance for d in V.novelty(frame, "id", "v").collect()}
    assert fitted[401] is None and all(fitted[i] == pytest.approx(fresh[i], rel=1e-6) for i in range(300))
    assert M.state(M.states_of(frame.filter("id < 0"), "v")) is None


def test_weights_knots_and_existing_files(spark, tmp_path):
    import json

    from tidemark.sources import io

    (tmp_path / "weights.json").write_text(json.dumps({"weights": {"edge": 0.9, "lips": -0.4}, "neutral_values": {"edge": 0.2}, "other": [1]}, indent=2))
    (tmp_path / "knots.json").write_text(json.dumps({"points": [[1.0, 0.9], [-1.0, 0.1], [0.0, 0.5]]}))
    assert io.read_weights(spark, f"file://{tmp_path}/weights.json") == {"edge": (0.9, 0.2), "lips": (-0.4, 0.0)}
    assert io.read_knots(spark, f"file://{tmp_path}/knots.json") == [(-1.0, 0.1), (0.0, 0.5), (1.0, 0.9)]
    (tmp_path / "none.json").write_text("{}")
    assert io.read_weights(spark, f"file://{tmp_path}/none.json") == {}
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "clip string, n int")
    files = spark.createDataFrame([("a",), ("a",), ("c",)], "file string")
    assert sorted(r.n for r in io.existing(rows, "clip", files).collect()) == [1, 3]
    assert [r.n for r in io.pending(rows, "clip", spark.createDataFrame([("a",)], "clip string")).collect()] == [2]
