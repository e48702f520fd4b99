"""Licence scan by canonical digest: whole texts are normalised, hashed, and hash-joined to known licences' digests.

Canonical form: lower case; comment marks and numbers or bullets of lists at the start of lines go; copyright notices
(lines with "copyright" and a year, "(c)" or the sign, never a sentence that a wrap has put there) and "all rights
reserved" lines go; anything but letters and digits becomes one space, so wraps don't matter; equivalent spellings
become one; a SHA-256 of the rest is the digest. A licence is known with each of its usual titles and without one.

Defined results: null text has a null digest and no licence; a text with nothing left has the digest of the empty
string and no licence; of known licences with one digest the smallest identifier is reported; repeated rows are each
reported; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.licence_texts import EQUIVALENT, LICENCES, TITLES

#: Known licences are broadcast up to this many; a larger list is joined by shuffling digests.
BROADCAST_LICENCES = 20_000
MARKS = r"^[ \t]*(?:<!--|/\*+|\*+/|[*#;%]+|//+|--+)+[ \t]*"
ITEM = r"^[ \t]*\(?[0-9]{1,2}[.)][ \t]+"
NOTICE = r"^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|<)|\(c\)|©)[^\n]*$"
RESERVED = r"^[ \t]*all rights reserved[. \t]*$"
#: In this order; each match goes.
DROPPED = [MARKS, ITEM, NOTICE, RESERVED]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern in DROPPED:
        out = F.regexp_replace(out, "(?md)" + pattern, "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelling, usual in EQUIVALENT:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return out


def titled(licences: dict[str, str]) -> list[tuple[str, str]]:
    """Each licence's text alone, and under each of its titles."""
    return sorted((k, head + text) for k, text in licences.items() for head in ("", *(f"{t}\n\n" for t in TITLES.get(k, ()))))


def known_digests(spark: SparkSession, licences: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(titled(licences), "licence_id string, licence_text string")
    rows = rows.select("licence_id", canonical(F.col("licence_text")).alias("form")).filter("form <> ''")
    return rows.groupBy(F.sha2("form", 256).alias("canonical_sha256")).agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, licences: dict[str, str] = LICENCES) -> DataFrame:
    """doc_id, canonical_sha256, canonical_chars and licence_id (null: no known licence) for each row of docs."""
    known = known_digests(docs.sparkSession, licences)
    if len(licences) <= BROADCAST_LICENCES:
        known = F.broadcast(known)
    forms = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    digests = forms.select("doc_id", F.sha2("form", 256).alias("canonical_sha256"), F.length("form").cast("long").alias("canonical_chars"))
    return digests.join(known, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "canonical_chars", "licence_id")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql_form(text: str) -> str:
    out = f"lower({text})"
    for pattern in DROPPED:
        out = f"regexp_replace({out}, '(?m){pattern}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelling, usual in EQUIVALENT:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return out


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in titled(LICENCES))
    return f"""
WITH known AS (SELECT sha256({_sql_form("t")}) AS d, min(id) AS licence_id FROM (VALUES {values}) AS k(id, t) GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents)
SELECT doc_id, sha256(form) AS canonical_sha256, length(form) AS canonical_chars, licence_id
FROM forms LEFT JOIN known ON d = sha256(form)"""
