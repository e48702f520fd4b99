"""The risk timeline over `events`: windows, features, scores, verdicts, findings and summaries.

Features of an event window are stand-ins that exercise the operators; they say nothing about detection quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import explain as X
from tidemark.operators import fusion as U
from tidemark.operators import windows as W
from tidemark.plans import params as P
from tidemark.plans.base_queries import KNOTS_SQL, ORDER, events, windows_sql
from tidemark.plans.registry import query

SIZE, STRIDE = 15, 5


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, window_id, t (seconds at its end) and stand-in features of windows of 15 events every 5."""
    x = W.count_windows(events(spark, sf_dir), "user_id", ORDER, SIZE, STRIDE).withColumn("bad", (F.col("event_type") == "error").cast("double"))
    w = W.window_arrays(x, "user_id", ["at", "value", "bad"])
    gaps = F.zip_with(F.slice("at", 2, SIZE - 1), F.slice("at", 1, SIZE - 1), lambda b, a: b - a)
    w = w.withColumn("gaps", gaps).withColumn("middle", C.median(F.col("gaps")))
    drop = F.size(F.filter("gaps", lambda g: g > P.DROP_FACTOR * F.col("middle"))) / F.lit(float(SIZE - 1))
    w = w.withColumn("drop", drop).withColumn("err", C.mean(F.col("bad"))).withColumn("mean", C.mean(F.col("value")))
    w = w.withColumn("top", F.array_max("value"))
    return w.select(
        "user_id",
        "window_id",
        F.element_at("at", SIZE).alias("t"),
        F.least(F.lit(1.0), 2.5 * F.col("err")).alias("source_risk"),
        F.when(F.col("drop") < 0.3, 1 - 2 * F.col("err")).alias("light_corr_face"),
        C.clip((F.col("mean") - 50) / 25, -2, 2).alias("edge_logit"),
        F.col("drop").alias("identity_flicker"),
        (1 - F.col("drop")).alias("quality_trust"),
        F.when(F.col("top") > 250, F.col("top") / 500).alias("replay_score"),
        F.when(F.col("err") == 0, C.clip(F.col("mean") / 100, 0, 1)).alias("static_face_risk"),
        F.when(F.col("mean") > 45, C.clip((F.col("mean") - 45) / 60, 0, 1)).alias("spoof_max"),
    )


FEATURES_SQL = f"""{windows_sql(SIZE, STRIDE)},
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id, window_id ORDER BY place) AS gap FROM x),
m AS (SELECT user_id, window_id, median(gap) AS middle FROM g GROUP BY 1, 2),
a AS (SELECT g.user_id, g.window_id, max(sec) AS t, count(*) FILTER (gap > 2.2 * middle) / 14.0::DOUBLE AS drop_, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0 END) AS err, avg(value) AS mean, max(value) AS top
  FROM g JOIN m ON g.user_id = m.user_id AND g.window_id = m.window_id GROUP BY 1, 2),
f AS (SELECT user_id, window_id, t, least(1.0::DOUBLE, 2.5 * err) AS source_risk, CASE WHEN drop_ < 0.3 THEN 1 - 2 * err END AS light_corr_face, greatest(least((mean - 50) / 25, 2.0::DOUBLE), -2.0::DOUBLE) AS edge_logit, drop_ AS identity_flicker,
  1 - drop_ AS quality_trust, CASE WHEN top > 250 THEN top / 500 END AS replay_score, CASE WHEN err = 0 THEN greatest(least(mean / 100, 1.0::DOUBLE), 0.0::DOUBLE) END AS static_face_risk,
  CASE WHEN mean > 45 THEN greatest(least((mean - 45) / 60, 1.0::DOUBLE), 0.0::DOUBLE) END AS spoof_max FROM a)"""
USED = ["source_risk", "light_corr_face", "edge_logit", "identity_flicker", "quality_trust", "replay_score", "static_face_risk", "spoof_max"]
FULL_SQL = f"i AS (SELECT user_id, window_id, t, {', '.join(f'coalesce({k}, {P.FEATURES[k][1]}) AS {k}' for k in USED)}, {', '.join(f'{k} IS NULL AS no_{k}' for k in USED)} FROM f)"
DAMP = "(CASE WHEN quality_trust >= 0.5 THEN 1.0::DOUBLE ELSE greatest(0.35::DOUBLE, quality_trust / 0.5) END)"
PART_SQL = {k: f"({P.FEATURES[k][0]} * ({k} - {P.FEATURES[k][1]})::DOUBLE{' * ' + DAMP if k in P.DAMPENED else ''})" for k in USED}
SCORE_SQL = f"""{FEATURES_SQL}, {FULL_SQL},
l AS (SELECT *, {P.BIAS}::DOUBLE + {' + '.join(PART_SQL[k] for k in P.FEATURES if k in USED)} AS l FROM i),
s AS (SELECT *, {KNOTS_SQL} AS p, NOT no_source_risk AND source_risk >= 0.7 AND NOT no_light_corr_face AND light_corr_face < 0.2 AS g1, NOT no_replay_score AND replay_score >= 0.7 AS g2,
  NOT no_static_face_risk AND static_face_risk >= 0.7 AS g3 FROM l)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.scored(U.imputed(U.complete(window_features(spark, sf_dir)))).withColumn("gates", U.gates())


def near(name: str) -> F.Column:
    return F.round(F.col(name) + 1e-9, 6).alias(name)


@query(f"WITH {SCORE_SQL} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, round(l + 1e-9, 6) AS logit, round(1 / (1 + exp(-l)) + 1e-9, 6) AS raw_probability, round(p + 1e-9, 6) AS probability, CAST(16 + {' + '.join(f'no_{k}::INT' for k in USED)} AS INTEGER) AS n_missing FROM s")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("user_id", "window_id", near("logit"), near("raw_probability"), near("probability"), F.size("missing").alias("n_missing"))


@query(f"""WITH {SCORE_SQL}, cc AS (SELECT user_id, window_id, unnest([{', '.join(f"struct_pack(place := {i}, name := '{k}', value := {PART_SQL[k] if k in USED else '0.0::DOUBLE'})" for i, k in enumerate(P.FEATURES))}]) AS c FROM s)
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, CAST(row_number() OVER w AS INTEGER) AS place, c.name AS name, round(c.value + 1e-9, 6) AS value FROM cc WINDOW w AS (PARTITION BY user_id, window_id ORDER BY abs(c.value) DESC, c.place) QUALIFY row_number() OVER w <= 5""")
def top_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("user_id", "window_id", F.posexplode("contributions").alias("place", "c"))
    return rows.select("user_id", "window_id", (F.col("place") + 1).alias("place"), F.col("c.name").alias("name"), F.round(F.col("c.value") + 1e-9, 6).alias("value"))


STATES_SQL = {
    "source": "CASE WHEN greatest(source_risk, replay_score) > 0.5 THEN 'bad' WHEN greatest(source_risk, replay_score) > 0.2 THEN 'warn' ELSE 'ok' END",
    "light": "CASE WHEN light_corr_face < 0.2 THEN 'bad' WHEN light_corr_face < 0.35 THEN 'warn' ELSE 'ok' END",
    "face": "CASE WHEN edge_logit > 0.8 OR identity_flicker > 0.5 OR static_face_risk > 0.6 THEN 'bad' WHEN edge_logit > 0.3 OR identity_flicker > 0.25 OR static_face_risk > 0.35 THEN 'warn' ELSE 'ok' END",
    "voice": "CASE WHEN spoof_max > 0.6 THEN 'bad' WHEN spoof_max > 0.3 THEN 'warn' ELSE 'ok' END",
    "lips": "'ok'",
}


@query(f"WITH {SCORE_SQL} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, {', '.join(f'{v} AS {k}' for k, v in STATES_SQL.items())} FROM s")
def check_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("user_id", "window_id", *[v.alias(k) for k, v in U.check_states().items()])


VERDICT_SQL = f"""{SCORE_SQL},
r(user_id, window_id, s, high, low, latched, acted, act) AS (
  SELECT user_id, window_id, p, CASE WHEN p >= 0.7 THEN 1 ELSE 0 END, CASE WHEN p < 0.6 THEN 1 ELSE 0 END, false, g1 OR g2 OR g3, CASE WHEN g1 THEN 'camera' WHEN g2 THEN 'replay' WHEN g3 THEN 'static' END FROM s WHERE window_id = 1
  UNION ALL SELECT user_id, window_id, v, high, low, latched, was OR latched OR g1 OR g2 OR g3, CASE WHEN was THEN NULL WHEN latched THEN 'latch' WHEN g1 THEN 'camera' WHEN g2 THEN 'replay' WHEN g3 THEN 'static' END FROM (
    SELECT *, CASE WHEN v >= 0.7 AND high >= 2 THEN true WHEN v < 0.6 AND low >= 3 THEN false ELSE on_ END AS latched, CASE WHEN v < 0.6 AND low >= 3 THEN false ELSE acted_ END AS was FROM (
      SELECT *, CASE WHEN v >= 0.7 THEN high_ + 1 WHEN v < 0.6 THEN 0 ELSE high_ END AS high, CASE WHEN v >= 0.7 THEN 0 WHEN v < 0.6 THEN low_ + 1 ELSE low_ END AS low FROM (
        SELECT s.user_id, s.window_id, s.g1, s.g2, s.g3, 0.5 * s.p + 0.5 * r.s AS v, r.high AS high_, r.low AS low_, r.latched AS on_, r.acted AS acted_ FROM r JOIN s ON s.user_id = r.user_id AND s.window_id = r.window_id + 1)))),
v AS (SELECT s.*, r.s AS ema, latched, act FROM r JOIN s ON s.user_id = r.user_id AND s.window_id = r.window_id)"""
VERDICT_ROWS = f"""SELECT user_id, CAST(window_id AS INTEGER) AS window_id, round(CASE WHEN g2 OR g3 THEN greatest(ema, 0.85) ELSE ema END + 1e-9, 6) AS smoothed, round(CASE WHEN g2 OR g3 THEN greatest(p, 0.85) ELSE p END + 1e-9, 6) AS calibrated,
CASE WHEN latched OR g1 OR g2 OR g3 THEN '{P.LIKELY}' WHEN ema >= 0.4 THEN '{P.DOUBTFUL}' ELSE '{P.GENUINE}' END AS category, latched OR g1 OR g2 OR g3 AS in_state,
CASE act {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in P.ACTIONS.items())} END AS action FROM v"""


@query(f"WITH RECURSIVE {VERDICT_SQL} {VERDICT_ROWS}")
def risk_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.verdicts(scored(spark, sf_dir), "user_id", "window_id")
    return out.select("user_id", "window_id", near("smoothed"), near("calibrated"), "category", "in_state", "action")


@query(f"WITH RECURSIVE {VERDICT_SQL} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, round(ema + 1e-9, 6) AS smoothed, latched AS in_state FROM v")
def smoothed_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("gates", F.array().cast("array<string>"))
    return U.verdicts(rows, "user_id", "window_id").select("user_id", "window_id", near("smoothed"), "in_state")


def _case(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


def _finding(place: int, check: str, kind: str, severity: str) -> str:
    return f"struct_pack(place := {place}, id := '{check}', severity := '{severity}', title := '{P.TITLES[check, kind, severity]}')"


FINDINGS_SQL = f"""{SCORE_SQL}, q AS (SELECT user_id, window_id, t, unnest(list_filter([
{_case(("replay_score >= 0.6", _finding(0, "source", "replay", "high")), ("replay_score >= 0.35", _finding(0, "source", "replay", "medium")), ("source_risk >= 0.7", _finding(0, "source", "camera", "high")), ("source_risk >= 0.35", _finding(0, "source", "camera", "medium")))},
{_case(("light_corr_face < 0.15", _finding(1, "light", "", "high")), ("light_corr_face < 0.3", _finding(1, "light", "", "medium")))},
{_case(("edge_logit >= 1.4 OR identity_flicker >= 0.6", _finding(2, "face", "artifacts", "high")), ("edge_logit >= 0.8 OR identity_flicker >= 0.35", _finding(2, "face", "artifacts", "medium")))},
{_case(("static_face_risk >= 0.7", _finding(3, "face", "static", "high")), ("static_face_risk >= 0.35", _finding(3, "face", "static", "medium")))},
{_case(("spoof_max >= 0.65", _finding(4, "voice", "", "high")), ("spoof_max >= 0.4", _finding(4, "voice", "", "medium")))}], lambda z: z IS NOT NULL)) AS z FROM s),
fd AS (SELECT user_id, window_id, t, z.place AS place, z.id AS id, z.severity AS severity, z.title AS title FROM q)"""


def window_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.findings(scored(spark, sf_dir), ["user_id", "window_id", "t"])


@query(f"WITH {FINDINGS_SQL} SELECT user_id, CAST(window_id AS INTEGER) AS window_id, id, severity, title FROM fd")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_findings(spark, sf_dir).select("user_id", "window_id", "id", "severity", "title")


REARM = 1_000_000.0  # events are hours apart, so the re-arming time of 15 s becomes days


@query(f"""WITH RECURSIVE {FINDINGS_SQL},
n AS (SELECT *, CASE severity WHEN 'high' THEN 3 ELSE 2 END AS rank, row_number() OVER (PARTITION BY user_id, id ORDER BY t, place) AS k FROM fd),
r(user_id, id, k, window_id, severity, title, emitted, seen, at_) AS (SELECT user_id, id, k, window_id, severity, title, true, rank, t FROM n WHERE k = 1
  UNION ALL SELECT n.user_id, n.id, n.k, n.window_id, n.severity, n.title, n.rank > seen OR n.t - at_ >= {REARM}, CASE WHEN n.rank > seen OR n.t - at_ >= {REARM} THEN n.rank ELSE seen END, CASE WHEN n.rank > seen OR n.t - at_ >= {REARM} THEN n.t ELSE at_ END
  FROM r JOIN n ON n.user_id = r.user_id AND n.id = r.id AND n.k = r.k + 1)
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, id, severity, title FROM r WHERE emitted""")
def emitted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deduplicated(window_findings(spark, sf_dir), "user_id", "t", REARM).select("user_id", "window_id", "id", "severity", "title")


@query(f"""WITH {FINDINGS_SQL}
SELECT user_id, id, title, CAST(min(window_id) AS INTEGER) AS first_window, count(*) AS n FROM fd GROUP BY 1, 2, 3""")
def distinct_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_findings(spark, sf_dir).groupBy("user_id", "id", "title").agg(F.min("window_id").alias("first_window"), F.count("*").alias("n"))
    return rows


@query(f"""WITH {FINDINGS_SQL}, md AS (SELECT user_id, window_id, title FROM fd WHERE id IN ('source', 'face')), u AS (SELECT user_id, window_id, title, 'module' AS origin FROM md UNION ALL
SELECT user_id, window_id, title, 'explainer' FROM fd WHERE NOT EXISTS (SELECT 1 FROM md WHERE md.user_id = fd.user_id AND md.window_id = fd.window_id AND md.title = fd.title))
SELECT user_id, CAST(window_id AS INTEGER) AS window_id, title, origin FROM u""")
def united_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_findings(spark, sf_dir).select("user_id", "window_id", "id", "title")
    module = found.filter(F.col("id").isin("source", "face")).drop("id")
    rest = found.drop("id").join(module, ["user_id", "window_id", "title"], "left_anti")
    return module.withColumn("origin", F.lit("module")).unionByName(rest.withColumn("origin", F.lit("explainer"))).select("user_id", "window_id", "title", "origin")


@query(f"""WITH RECURSIVE {VERDICT_SQL.replace(SCORE_SQL, FINDINGS_SQL)}, o AS ({VERDICT_ROWS}),
z AS (SELECT user_id, max(window_id) AS w FROM o GROUP BY 1),
tt AS (SELECT user_id, severity, title, row_number() OVER (PARTITION BY user_id, severity ORDER BY min(window_id), min(place)) AS k FROM fd WHERE severity IN ('high', 'medium') GROUP BY user_id, severity, title),
hh AS (SELECT user_id, string_agg('''' || title || '''', ' and ' ORDER BY k) FILTER (severity = 'high' AND k <= 2) AS h, string_agg('''' || title || '''', ' and ' ORDER BY k) FILTER (severity = 'medium' AND k <= 2) AS md FROM tt GROUP BY 1)
SELECT o.user_id, 'Verification session completed with an assessed deepfake risk of ' || CAST(round(smoothed * 100) AS INTEGER) || '% (' || category || '). ' ||
CASE WHEN coalesce(h, md) IS NULL THEN '{P.NO_FINDINGS}' ELSE 'Primary anomalies observed include ' || coalesce(h, md) || ' across active analysis windows.' END || ' ' ||
CASE category WHEN '{P.LIKELY}' THEN '{P.ADVICE[P.LIKELY]}' WHEN '{P.DOUBTFUL}' THEN '{P.ADVICE[P.DOUBTFUL]}' ELSE '{P.ADVICE[P.GENUINE]}' END AS summary
FROM o JOIN z ON o.user_id = z.user_id AND o.window_id = z.w LEFT JOIN hh ON o.user_id = hh.user_id""")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    last = U.verdicts(rows, "user_id", "window_id").groupBy("user_id").agg(F.max_by(F.struct("smoothed", "category"), "window_id").alias("v"))
    # Distinct titles: the catalogue bounds them, whatever the number of windows.
    found = X.findings(rows, ["user_id", "window_id"]).groupBy("user_id", "severity", "title").agg(F.min("window_id").alias("w"), F.min("place").alias("p"))
    found = found.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("w", "p", "severity", "title"))).alias("found"))
    of = lambda s: F.transform(F.filter(F.coalesce("found", F.array().cast("array<struct<w:int,p:int,severity:string,title:string>>")), lambda f: f["severity"] == s), lambda f: f["title"])
    out = last.join(found, "user_id", "left")
    # Percents of the six places that are shown, halves away from zero, as in the SQL.
    percent = F.round(F.round(F.col("v.smoothed") + 1e-9, 6) * 100)
    return out.select("user_id", X.summary(F.col("v.smoothed"), F.col("v.category"), of("high"), of("medium"), percent).alias("summary"))
