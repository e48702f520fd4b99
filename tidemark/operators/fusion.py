"""Scoring of windows: imputation, weighted logit, calibration, smoothing, latch, gates and check states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import calibrated
from tidemark.plans import params as P

NAMES = list(P.FEATURES)


def complete(rows: DataFrame) -> DataFrame:
    """rows with all feature columns, those that lack as null doubles."""
    have = set(rows.columns)
    return rows.withColumns({k: F.lit(None).cast("double") for k in NAMES if k not in have})


def imputed(rows: DataFrame) -> DataFrame:
    """Missing (null or NaN) features become neutral and are named in `missing`."""
    names = F.array(*[F.when(C.number(F.col(k)).isNull(), F.lit(k)) for k in NAMES])
    rows = rows.withColumn("missing", F.array_compact(names))
    return rows.withColumns({k: F.coalesce(C.number(F.col(k)), F.lit(n)) for k, (_, n) in P.FEATURES.items()})


def dampener() -> Column:
    trust = F.col("quality_trust")
    return F.when(trust >= P.TRUST_FULL, 1.0).otherwise(F.greatest(F.lit(P.DAMPEN_LEAST), trust / P.TRUST_FULL))


def contribution(name: str) -> Column:
    weight, neutral = P.FEATURES[name]
    out = F.lit(weight) * (F.col(name) - neutral)
    return out * dampener() if name in P.DAMPENED else out


def scored(rows: DataFrame) -> DataFrame:
    """Logit, raw and calibrated probability and the five largest contributions of imputed rows."""
    parts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("name"), contribution(k).alias("value")) for i, k in enumerate(NAMES)])
    rows = rows.withColumn("contributions", parts)
    rows = rows.withColumn("logit", F.aggregate("contributions", F.lit(P.BIAS), lambda s, c: s + c["value"]))
    by_size = F.array_sort(F.transform("contributions", lambda c: F.struct((-F.abs(c["value"])).alias("order"), c["place"].alias("place"), c["name"].alias("name"), c["value"].alias("value"))))
    rows = rows.withColumn("contributions", F.transform(F.slice(by_size, 1, 5), lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"))))
    return rows.withColumn("raw_probability", C.sigmoid(F.col("logit"))).withColumn("probability", calibrated(F.col("logit")))


def check_states() -> dict[str, Column]:
    """Badge of each check from imputed features."""
    f = F.col
    ladder = lambda bad, warn: F.when(bad, "bad").when(warn, "warn").otherwise("ok")
    source = F.greatest("source_risk", "replay_score")
    lit = f("light_snr") >= 2.0
    synced = f("sync_conf") >= P.SYNC_CONF_LEAST
    return {
        "source": ladder(source > 0.50, source > 0.20),
        "light": ladder(lit & (f("light_corr_face") < 0.20), lit & (f("light_corr_face") < 0.35)),
        "face": ladder(
            (f("edge_logit") > 0.80) | (f("identity_flicker") > 0.50) | (f("static_face_risk") > 0.60),
            (f("edge_logit") > 0.30) | (f("identity_flicker") > 0.25) | (f("landmark_jitter") > 0.06) | (f("static_face_risk") > 0.35),
        ),
        "voice": ladder(f("spoof_max") > 0.60, f("spoof_max") > 0.30),
        "lips": ladder(
            (f("bilabial_aperture_err") > 0.30) | synced & (f("sync_offset_ms") > 180.0), (f("bilabial_aperture_err") > 0.15) | synced & (f("sync_offset_ms") > 100.0)
        ),
    }


def gates() -> Column:
    """Hard gates of a window, in order: names of those that hold. Only features that were measured count."""
    have = lambda k: ~F.array_contains("missing", k)
    # The missing light correlation counts as 0.5, so a camera gate needs a measured one.
    camera = have("source_risk") & (F.col("source_risk") >= P.GATE_RISK) & have("light_corr_face") & (F.col("light_corr_face") < P.GATE_LIGHT)
    replay = have("replay_score") & (F.col("replay_score") >= P.GATE_RISK)
    static = have("static_face_risk") & (F.col("static_face_risk") >= P.GATE_RISK)
    return F.array_compact(F.array(F.when(camera, "camera"), F.when(replay, "replay"), F.when(static, "static")))


@dataclass
class Latch:
    """State of a key between windows: one step function for batch and stream alike."""

    smooth: float | None = None
    high: int = 0
    low: int = 0
    latched: bool = False
    acted: bool = False
    alpha: float = field(default=P.ALPHA, repr=False)

    def step(self, probability: float, gates: list[str]) -> tuple[float, float, str, bool, str | None]:
        """Smoothed and calibrated probability, category, latch and action of the next window; gates last one window."""
        self.smooth = smooth = probability if self.smooth is None else self.alpha * probability + (1 - self.alpha) * self.smooth
        if smooth >= P.ENTER:
            self.high, self.low = self.high + 1, 0
            self.latched |= self.high >= P.ENTER_AFTER
        elif smooth < P.LEAVE:
            self.high, self.low = 0, self.low + 1
            if self.low >= P.LEAVE_AFTER:
                self.latched = self.acted = False
        shown, category = self.latched, P.LIKELY if self.latched else P.DOUBTFUL if smooth >= P.SUSPICIOUS else P.GENUINE
        action = None
        for gate in ["latch"] * self.latched + list(gates):
            shown, category = True, P.LIKELY
            if gate in ("replay", "static"):
                smooth, probability = max(smooth, P.GATE_FLOOR), max(probability, P.GATE_FLOOR)
            if not self.acted:
                action, self.acted = P.ACTIONS[gate], True
        return smooth, probability, category, shown, action

    def dump(self) -> tuple:
        return self.smooth, self.high, self.low, self.latched, self.acted


VERDICT = "smoothed double, calibrated double, category string, in_state boolean, action string"


def verdicts(rows: DataFrame, key: str, order: str, alpha: float = P.ALPHA) -> DataFrame:
    """Runs each key's windows through its latch in order; rows(key, order, probability, gates).

    Rows are sorted by key within partitions and streamed, so a key's windows are never gathered in memory.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {order} {rows.schema[order].dataType.simpleString()}, {VERDICT}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, latch = None, None
        for batch in batches:
            out = []
            for k, p, g in zip(batch[key], batch["probability"], batch["gates"], strict=True):
                if latch is None or k != at:
                    at, latch = k, Latch(alpha=alpha)
                out.append(latch.step(p, list(g)))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])
            yield pd.concat([batch[[key, order]].reset_index(drop=True), found], axis=1)

    dealt = rows.select(key, order, "probability", "gates").repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(run, schema)


def verdicts_folded(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The smoothing and latch without gates as one expression over a key's array: for keys of bounded length."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "probability"))).alias("w"))
    kind = f"array<struct<{order}:{rows.schema[order].dataType.simpleString()},smoothed:double,in_state:boolean>>"
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(0).alias("high"), F.lit(0).alias("low"), F.lit(False).alias("on"), F.array().cast(kind).alias("out"))

    def step(a: Column, w: Column) -> Column:
        smooth = F.when(a["s"].isNull(), w["probability"]).otherwise(P.ALPHA * w["probability"] + (1 - P.ALPHA) * a["s"])

        def after(s: Column) -> Column:
            high = F.when(s >= P.ENTER, a["high"] + 1).when(s < P.LEAVE, 0).otherwise(a["high"])
            low = F.when(s >= P.ENTER, 0).when(s < P.LEAVE, a["low"] + 1).otherwise(a["low"])
            on = F.when((s >= P.ENTER) & (high >= P.ENTER_AFTER), True).when((s < P.LEAVE) & (low >= P.LEAVE_AFTER), False).otherwise(a["on"])
            row = F.struct(w[order].alias(order), s.alias("smoothed"), on.alias("in_state"))
            return F.struct(s.alias("s"), high.alias("high"), low.alias("low"), on.alias("on"), F.concat(a["out"], F.array(row)).alias("out"))

        return F.element_at(F.transform(F.array(smooth), after), 1)

    return lists.select(key, F.explode(F.aggregate("w", start, step)["out"]).alias("r")).select(key, "r.*")
