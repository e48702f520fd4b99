"""Correlations at lags over odd series, and how much work a window's response to light is (F12)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import series
from tidemark.operators import signals as G

KINDS = "id int, a array<double>, b array<double>"
LAGS = range(-2, 4)


def plain(a, b, k, least):
    if a is None or b is None:
        return None
    size, i, j = len(a) - abs(k), max(k, 0), max(-k, 0)
    x, y = a[i : i + max(size, 0)], b[j : j + max(size, 0)]
    if size < least or len(y) != len(x) or None in x or None in y or min(np.std(x), np.std(y)) <= 1e-5:
        return None
    return np.corrcoef(x, y)[0, 1]


def test_lagged_correlations_of_odd_series(spark, monkeypatch):
    rng = np.random.default_rng(7)
    some = lambda n: rng.normal(size=n).round(3).tolist()
    rows = [(i, some(8), some(8)) for i in range(40)] + [(100 + i, some(5 + i % 4), some(9 - i % 4)) for i in range(20)]
    rows += [(200, None, some(8)), (201, some(8), None), (202, [], []), (203, [1.0] * 8, some(8)), (204, some(8), [2.0] * 7 + [3.0]), (205, [None, *some(7)], some(8)), (206, some(8), [*some(7), None]), (207, some(3), some(3))]
    # Blocks of a few series, so that a batch takes several.
    monkeypatch.setattr(series, "STEP", 16)
    series._at_lags.cache_clear()
    found = spark.createDataFrame(rows, KINDS).repartition(3).select("id", series.lagged_correlations(F.col("a"), F.col("b"), LAGS, 4).alias("c")).collect()
    series._at_lags.cache_clear()
    got = {r.id: [(c.lag, c.corr) for c in r.c] for r in found if r.c is not None}
    seen = set()
    for i, a, b in rows:
        assert [k for k, _ in got[i]] == list(LAGS)
        for k, r in got[i]:
            want = plain(a, b, k, 4)
            assert (r is None) == (want is None) and (r is None or r == pytest.approx(want, abs=1e-12)), (i, k)
            seen.add(want is None)
    assert seen == {True, False}


def test_light_response_of_odd_windows(spark):
    """Short, empty and missing windows are neutral; faces without colour, necks of another length and codes that aren't colours drop out."""
    frame = "struct<cr:double,cg:double,mean_r:double,mean_g:double,mean_b:double>"
    kinds = f"id int, face array<{frame}>, neck array<{frame}>, sequence array<struct<color:string,ms:int>>"
    face = [(0.3 + 0.01 * (i % 5), 0.33, 100.0 + i % 3, 100.0, 100.0) for i in range(16)]
    flat, dark, steps = [(0.3, 0.3, 1.0, 1.0, 1.0)] * 16, [(None,) * 5] * 16, [("#ff4d4d", 350), ("bad", 350), ("#4dff88", 350)]
    rows = [(0, face, face, steps), (1, face[:5], face[:5], steps), (2, [], [], steps), (3, None, None, steps), (4, face, face[:9], steps), (5, face, None, steps), (6, flat, face, steps), (7, dark, dark, steps), (8, face, face, []), (9, face, face, None)]
    got = {r.id: r.l for r in G.light_response(spark.createDataFrame(rows, kinds), F.col("face"), F.col("neck"), F.col("sequence"), F.lit("agent"), "l").collect()}
    assert {i for i, r in got.items() if (r.score, r.corr_face, r.snr) == (0.5, 0.5, 3.0)} == {1, 2, 3, 8, 9}
    assert got[0].neck_face_corr == pytest.approx(1.0) and got[0].neck_face_ratio == pytest.approx(1.0, abs=0.05)
    assert {(got[i].neck_face_corr, got[i].neck_face_ratio) for i in (4, 5, 6, 7)} == {(0.80, 0.85)}
    assert got[6].corr_face == got[7].corr_face == -1.0 and "NO_LIGHT_REACTION" in got[6].flags


def test_a_windows_light_is_little_work(spark, sf_dir):
    """Work grows with the loops over frames that a row goes through outside generated code; there were 1 109 of them."""
    plan = entry.queries()["light_response"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") < 200
