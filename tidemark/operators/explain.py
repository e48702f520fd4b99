"""Findings of windows, their deduplication with escalation and re-arming, and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans import params as P

RANKS = {"low": 1, "medium": 2, "high": 3}


def rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), severity), F.lit(1))


def candidates() -> Column:
    """Array of findings (place, id, severity, title) of imputed features, in catalogue order."""
    f = F.col

    def found(place: int, check: str, kind: str, severity: str) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(check).alias("id"), F.lit(severity).alias("severity"), F.lit(P.TITLES[check, kind, severity]).alias("title"))

    def ladder(place: int, check: str, kind: str, high: Column, medium: Column) -> Column:
        return F.when(high, found(place, check, kind, "high")).when(medium, found(place, check, kind, "medium"))

    replay, camera = f("replay_score"), f("source_risk")
    source = F.coalesce(ladder(0, "source", "replay", replay >= 0.60, replay >= 0.35), ladder(0, "source", "camera", camera >= 0.70, camera >= 0.35))
    lit, corr = f("light_snr") >= 2.0, f("light_corr_face")
    edge, flicker = f("edge_logit"), f("identity_flicker")
    lips, offset = f("bilabial_aperture_err"), f("sync_offset_ms")
    synced = f("sync_conf") >= P.SYNC_CONF_LEAST
    return F.array_compact(
        F.array(
            source,
            ladder(1, "light", "", lit & (corr < 0.15), lit & (corr < 0.30)),
            ladder(2, "face", "artifacts", (edge >= 1.4) | (flicker >= 0.60), (edge >= 0.80) | (flicker >= 0.35) | (f("landmark_jitter") >= 0.08)),
            ladder(3, "face", "static", f("static_face_risk") >= 0.70, f("static_face_risk") >= 0.35),
            ladder(4, "voice", "", f("spoof_max") >= 0.65, f("spoof_max") >= 0.40),
            ladder(5, "lips", "", (lips >= 0.35) | synced & (offset >= 200.0), (lips >= 0.18) | synced & (offset >= 120.0)),
        )
    )


def findings(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each finding of each window of imputed rows."""
    return rows.select(*keep, F.explode(candidates()).alias("finding")).select(*keep, "finding.*")


class Memory:
    """Emissions of a key by check: emit what is new, more severe than remembered, or REARM_SEC old; remember each emission."""

    def __init__(self, rearm: float = P.REARM_SEC):
        self.rearm, self.last = rearm, {}

    def admits(self, check: str, severity: int, t: float) -> bool:
        before = self.last.get(check)
        if before is not None and severity <= before[0] and t - before[1] < self.rearm:
            return False
        self.last[check] = (severity, t)
        return True


def deduplicated(rows: DataFrame, key: str, time: str, rearm: float = P.REARM_SEC) -> DataFrame:
    """Findings(key, time, place, id, severity, ...) that are emitted, by each key's memory, streamed in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, memory = None, None
        for batch in batches:
            keep = []
            for k, check, severity, t in zip(batch[key], batch["id"], batch["severity"], batch[time], strict=True):
                if memory is None or k != at:
                    at, memory = k, Memory(rearm)
                keep.append(memory.admits(check, RANKS.get(severity, 1), t))
            yield batch[keep]

    return rows.repartition(key).sortWithinPartitions(key, time, "place").mapInPandas(run, rows.schema)


def summary(risk: Column, category: Column, high: Column, medium: Column, percent: Column | None = None) -> Column:
    """Three sentences from a risk in [0, 1], a category and arrays of titles of high and medium findings.

    percent: the risk in whole percents; if not given, halves go to even.
    """
    percent = F.bround(risk * 100) if percent is None else percent
    first = F.format_string("Verification session completed with an assessed deepfake risk of %d%% (%s).", percent.cast("int"), category)
    top = F.when(F.size(high) > 0, F.slice(high, 1, 2)).otherwise(F.slice(medium, 1, 2))
    titles = F.array_join(F.transform(top, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), " and ")
    second = F.when(F.size(top) > 0, F.format_string("Primary anomalies observed include %s across active analysis windows.", titles)).otherwise(F.lit(P.NO_FINDINGS))
    third = F.when(category == P.LIKELY, P.ADVICE[P.LIKELY]).when(category == P.DOUBTFUL, P.ADVICE[P.DOUBTFUL]).otherwise(P.ADVICE[P.GENUINE])
    return F.concat_ws(" ", first, second, third)


def acceptable(text: Column, percent: Column) -> Column:
    """Whether a rewritten summary may stand: 20 to 500 characters that name the risk."""
    return F.length(text).between(20, 500) & F.contains(text, F.concat(percent.cast("string"), F.lit("%")))
