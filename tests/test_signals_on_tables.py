"""Light and sound signals over the driver's tables against numpy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.plans import signal_queries as S


def corr(a, b):
    return np.corrcoef(a, b)[0, 1] if np.std(a) > 0 and np.std(b) > 0 else None


def lagged(a, b, lags, least):
    """Correlation by lag: b's frame lies `lag` frames after a's for positive lags."""
    out = {}
    for k in lags:
        n = len(a) - abs(k)
        x, y = (a[k:], b[:n]) if k >= 0 else (a[:n], b[-k:])
        if n >= least and (r := corr(x, y)) is not None:
            out[k] = r
    return out


def test_sound_against_numpy(spark, sf_dir):
    got = {r.vec_id: r for r in entry.queries()["av_sync"](spark, sf_dir).collect()}
    rows = S.sounding_vectors(spark, sf_dir).collect()
    assert len(got) == len(rows) > 100
    seen = set()
    for r in rows:
        pcm, mouth = np.array(r.pcm, float), np.array(r.mouth)
        envelope = np.sqrt((pcm.reshape(-1, 4) ** 2).mean(1) + 1e-6)
        found = lagged(envelope, mouth, range(-4, 5), 4)
        best = max(found, key=lambda k: found[k])
        conf = max(0.0, found[best] / (np.mean(np.abs(list(found.values()))) + 1e-6))
        x = got[r.vec_id]
        assert x.conf == pytest.approx(conf, abs=2e-6) and abs(x.offset_ms) == pytest.approx(abs(best) * 1000 / 15, abs=1e-5)
        # Turning the series wraps a few frames round, so most, not all, find the lag that was made.
        seen.add((r.lag, round(x.offset_ms * 15 / 1000)))
    assert len({a for a, b in seen if a == -b or a == b}) == 9


def test_light_against_numpy(spark, sf_dir):
    got = {(r.user_id, r.window_id): r for r in entry.queries()["light_response"](spark, sf_dir).collect()}
    rows = S.light_cases(spark, sf_dir).collect()
    assert len(got) == len(rows) > 20
    colours = np.array([[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in S.COLOURS], float)
    steps = np.repeat(np.arange(6), 5)[:16]  # 350 ms at 15 a second, rounded half to even
    rgb = colours[steps]
    target = {"cr": rgb[:, 0] / (rgb.sum(1) + 1e-6), "cg": rgb[:, 1] / (rgb.sum(1) + 1e-6), "y": rgb @ (0.299, 0.587, 0.114)}
    scores = {True: [], False: []}
    for r in rows:
        face = {"cr": np.array([f.cr for f in r.face]), "cg": np.array([f.cg for f in r.face]), "y": np.array([0.299 * f.mean_r + 0.587 * f.mean_g + 0.114 * f.mean_b for f in r.face])}
        peak = int(np.argmax(np.diff(face["y"])))
        shift = peak if peak < 8 else 0
        total = weight = 0.0
        lag = {}
        for part, w in (("cr", 0.6), ("cg", 0.2), ("y", 0.2)):
            a, b = face[part] - face[part].mean(), np.roll(target[part] - target[part].mean(), shift)
            found = lagged(a, b, range(S.P.LAG_FRAMES + 1), 8)
            best = max(found, key=lambda k: found[k])
            lag[part] = best
            total, weight = total + w * found[best], weight + w
        x = got[r.user_id, r.window_id]
        assert x.corr_face == pytest.approx(np.clip(total / weight, -1, 1), abs=2e-6) and x.lag_ms == pytest.approx(lag["cr"] * 1000 / 15, abs=1e-5)
        if r.neck:
            neck = np.array([f.cr for f in r.neck])
            assert x.neck_face_corr == pytest.approx(corr(neck, face["cr"]), abs=2e-6)
        else:
            assert x.neck_face_corr == 0.8
        scores[r.real].append(x.score)
    assert np.mean(scores[True]) > np.mean(scores[False]) + 0.1


def test_queue_over_events(spark, sf_dir):
    from test_live import simulated

    events = sorted(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) / 1e6 AS at", "coalesce(value, 0) * 3600 AS cost", "event_id").collect(), key=lambda r: (r.user_id, r.at, r.event_id))
    got = {r.event_id: (r.outcome, r.started_at, r.dropped) for r in entry.queries()["overload_queue"](spark, sf_dir).collect()}
    want = {}
    for user in {r.user_id for r in events}:
        want |= simulated([(r.at, r.cost, r.event_id) for r in events if r.user_id == user], 2)
    assert got == want and len({f[0] for f in want.values()}) == 2
