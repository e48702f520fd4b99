"""What a session sends and keeps: event rows in their order, histories, answers, and small time and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ["source", "light", "face", "voice", "lips"]
EVENT = "struct<type:string,id:string,state:string,value:double,text:string>"


def event(kind: str, name: Column | None = None, state: Column | None = None, value: Column | None = None, text: Column | None = None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("type"), none(name, "string").alias("id"), none(state, "string").alias("state"), none(value, "double").alias("value"), none(text, "string").alias("text"))


def fan_out(rows: DataFrame, keep: list[str], risk: str, findings: str, action: str, evidence: str | None = None) -> DataFrame:
    """A row (seq, type, id, state, value, text) for each event of a window, in the fixed order: checks, risk (three places), findings, action, evidence.

    rows has a column for each of CHECKS, findings an array of structs with id, severity and title.
    """
    checks = F.array(*[event("check", F.lit(c), F.col(c)) for c in CHECKS], event("risk", value=F.bround(F.col(risk), 3)))
    found = F.transform(F.coalesce(F.col(findings), F.array()), lambda f: event("finding", f["id"], f["severity"], text=f["title"]))
    rest = [F.when(F.col(action).isNotNull(), event("action", text=F.col(action)))]
    if evidence:
        rest.append(F.when(F.col(evidence).isNotNull(), event("evidence", text=F.col(evidence))))
    every = F.concat(checks.cast(f"array<{EVENT}>"), found.cast(f"array<{EVENT}>"), F.array_compact(F.array(*rest)).cast(f"array<{EVENT}>"))
    return rows.select(*keep, F.posexplode(every).alias("seq", "event")).select(*keep, (F.col("seq") + 1).alias("seq"), "event.*")


def warm_up(sessions: DataFrame, key: str) -> DataFrame:
    """What a session sends at its start: each check as running, then risk 0."""
    every = F.array(*[event("check", F.lit(c), F.lit("running")) for c in CHECKS], event("risk", value=F.lit(0.0)))
    return sessions.select(key, F.posexplode(every).alias("seq", "event")).select(key, (F.col("seq") + 1).alias("seq"), "event.*")


def history(rows: DataFrame, keep: list[str], t: str, risk: str, trust: str) -> DataFrame:
    """The kept history of windows: time to 2 places, risk to 4, trust to 3 (0.85 where unknown), halves to even."""
    return rows.select(*keep, F.bround(F.col(t), 2).alias("t_sec"), F.bround(F.col(risk), 4).alias("risk"), F.bround(F.coalesce(F.col(trust), F.lit(0.85)), 3).alias("quality_trust"))


def case_view(cases: DataFrame) -> DataFrame:
    """What is shown of a case: without category, windows and evidence; missing fields have their defaults."""
    defaults = {"created_at": 0, "consent_status": "consented", "stubs_in_use": True, "risk_score": 0.0, "summary": ""}
    return cases.select("session_id", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()], F.coalesce("findings", F.array()).alias("findings"))


def verdict_band(risk: Column) -> Column:
    return F.when(risk < 0.40, "Looks authentic").when(risk < 0.70, "Needs closer review").otherwise("Likely a deepfake")


def clock_text(seconds: Column) -> Column:
    """Seconds as mm:ss."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def frame_time(frame: Column, fps: float, start: Column) -> Column:
    return frame / F.lit(float(fps)) + start


def clock_echo(client_ms: Column, now: Column) -> Column:
    """The client's time with the server's, in ms, and the difference."""
    server = F.unix_millis(now)
    return F.struct(client_ms.alias("client_time"), server.alias("server_time"), (server - client_ms).alias("behind_ms"))


def listed_names(text: Column) -> Column:
    """Parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def numbered_name(stem: Column, number: Column, width: int = 3) -> Column:
    """stem_007: the number padded with zeros, never cut."""
    digits = number.cast("string")
    return F.concat_ws("_", stem, F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def tail(samples: Column, n: int) -> Column:
    """The newest n elements of an array, all if there are fewer."""
    return F.slice(samples, F.greatest(F.lit(1), F.size(samples) - n + 1), F.lit(n))


def middle(frames: Column) -> Column:
    """The element in the middle of an array (the later of two); null for an empty one."""
    return F.get(frames, F.floor(F.size(frames) / 2).cast("int"))


def patch_colour(r: Column, g: Column, b: Column) -> Column:
    """Channel means of a patch and their shares; an empty patch (null means) is grey."""
    total = r + g + b + F.lit(1e-6)
    share = lambda c: F.coalesce(c / total, F.lit(0.333))
    mean = lambda c: F.when(total.isNotNull(), c).otherwise(128.0)
    return F.struct(*[share(c).alias(n) for n, c in zip("rgb", (r, g, b), strict=True)], *[mean(c).alias(f"mean_{n}") for n, c in zip("rgb", (r, g, b), strict=True)])


def first_of_kind(rows: DataFrame, key: str, kind: Column, order: list[str]) -> DataFrame:
    """Each key's first row of a kind."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(kind).withColumn("first of kind", F.row_number().over(w)).filter("`first of kind` = 1").drop("first of kind")


def latest_known(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """rows with the newest value that a key's column had up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def long_enough(frames: DataFrame, key: str, least: int) -> DataFrame:
    """Frames of those sources that have `least` or more."""
    kept = frames.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key)
    return frames.join(kept, key, "left_semi")


def models(paths: DataFrame, document: str) -> DataFrame:
    """name, file and stubs_in_use of each model of registry documents (JSON text); stubs count as in use where nothing is said."""
    kind = "struct<stubs_in_use:boolean,models:map<string,struct<file:string,version:string>>>"
    found = paths.select(F.from_json(document, kind).alias("d"))
    return found.select(F.coalesce("d.stubs_in_use", F.lit(True)).alias("stubs_in_use"), F.explode_outer("d.models").alias("name", "m")).select("name", "m.*", "stubs_in_use")
