"""Modules of a window as columns: status, risk, confidence, features, and findings by each module's own ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.signals import frozen_count
from tidemark.plans import params as P

FINDING = "array<struct<id:string,severity:string,title:string,detail:string,t:double>>"


def finding(check: str, severity: str, title: str, t: Column) -> Column:
    """A finding with the fixed detail of its title, and the time to two places (half to even)."""
    values = {"id": check, "severity": severity, "title": title, "detail": P.DETAILS[title]}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()], F.bround(t.cast("double"), 2).alias("t"))


def ladder(check: str, kind: str, high: Column, medium: Column, t: Column) -> Column:
    """One finding at most: high before medium."""
    return F.when(high, finding(check, "high", P.TITLES[check, kind, "high"], t)).when(medium, finding(check, "medium", P.TITLES[check, kind, "medium"], t))


def listed(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(FINDING)


def source_findings(source: Column, replay: Column, light_snr: Column, light_corr: Column, challenged: Column, t: Column) -> Column:
    """Camera, replay and light have a ladder each, so a window may have all three. Without a challenge light has none."""
    lit = F.coalesce(challenged & (light_snr >= 2.0), F.lit(False))
    return listed(
        ladder("source", "camera", source >= 0.70, source >= 0.35, t),
        ladder("source", "replay", replay >= 0.60, replay >= 0.35, t),
        ladder("light", "", lit & (light_corr < 0.15), lit & (light_corr < 0.30), t),
    )


def audio_findings(status: Column, spoof: Column, t: Column) -> Column:
    return F.when(status == "ok", listed(ladder("voice", "", spoof >= 0.65, spoof >= 0.40, t))).otherwise(listed())


def appearance_findings(edge: Column, flicker: Column, t: Column) -> Column:
    high, medium = (edge >= 1.4) | (flicker >= 0.50), (edge >= 0.80) | (flicker >= 0.35)
    return listed(ladder("face", "artifacts", F.coalesce(high, F.lit(False)), medium, t))


def speech_findings(status: Column, lips: Column, sync_conf: Column, offset_ms: Column, t: Column) -> Column:
    synced = sync_conf >= P.SYNC_CONF_LEAST
    high, medium = (lips >= 0.35) | synced & (offset_ms >= 200.0), (lips >= 0.18) | synced & (offset_ms >= 120.0)
    return F.when(status == "ok", listed(ladder("lips", "", F.coalesce(high, F.lit(False)), medium, t))).otherwise(listed())


def geometry(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows(landmark_jitter, occlusion, nonrigid, eye, rigid, corr, t) with `geometry`: the module's result.

    A window whose four motion columns are null has no usable crops: it is no static one and leaves the counter as it
    is. A card that moves rigidly scores 0.88 at once; a frozen face 0.75, and 0.88 from the second static window of the counter on.
    """
    usable = F.col("nonrigid").isNotNull()
    frozen = ((F.col("nonrigid") < 1.70) & (F.col("eye") < 2.8)) | ((F.col("corr") >= 0.985) & (F.col("eye") < 3.0))
    card = (F.col("rigid") >= 0.4) & (F.col("nonrigid") < 1.70)
    rows = rows.withColumn("geometry card", F.coalesce(card, F.lit(False))).withColumn("geometry still", F.when(usable, F.coalesce(card | frozen, F.lit(False))))
    rows = frozen_count(rows, key, order, "geometry still")
    still = F.coalesce(F.col("geometry still"), F.lit(False))
    static = F.when(F.col("geometry card"), 0.88).when(still & (F.col("frozen") >= 2), 0.88).when(still, 0.75).otherwise(0.0)
    jitter, occlusion, t = F.coalesce("landmark_jitter", F.lit(0.0)), F.coalesce("occlusion", F.lit(0.0)), F.col("t")
    found = listed(
        F.when(jitter >= 0.08, finding("face", "medium", "Facial Landmark Jitter Anomaly", t)),
        F.when(occlusion >= 0.60, finding("face", "medium", "Occlusion Reconstruction Seams", t)),
        F.when(F.col("geometry card"), finding("face", "high", "Rigid 2D Photo Motion Detected", t)).when(still, finding("face", "high", P.TITLES["face", "static", "high"], t)),
    )
    risk = F.greatest(C.clip(jitter / 0.10, 0, 1), 0.7 * C.clip(occlusion, 0, 1), static)
    out = F.struct(risk.alias("risk"), F.lit(0.80).alias("confidence"), static.alias("static_face_risk"), found.alias("findings"))
    return rows.withColumn("geometry", out).drop("geometry card", "geometry still")


def identity_score(min_similarity: Column, std: Column, jumps: Column, jitter: Column) -> Column:
    """Joint score of flicker and jitter with its flags."""
    score = C.clip(0.6 * F.greatest(F.lit(0.0), 1 - min_similarity) + 0.4 * F.least(F.lit(1.0), jitter / (0.08 + 1e-6)), 0, 1)
    flicker = (min_similarity < 0.60) | (std > 0.15) | (jumps >= 2)
    flags = F.array_compact(F.array(F.when(flicker, F.lit("IDENTITY_FLICKER")), F.when(jitter > 0.08, F.lit("LANDMARK_JITTER"))))
    return F.struct(score.alias("score"), flags.alias("flags"))


def united(modules: Column, explained: Column) -> Column:
    """All findings of the modules, then those of the explainer whose title none of them has."""
    return F.concat(modules, F.filter(explained, lambda e: ~F.exists(modules, lambda m: m["title"] == e["title"])))
