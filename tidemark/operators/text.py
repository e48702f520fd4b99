"""Text operators: keyword labels, phrases against what was heard, consonants that close the lips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans import params as P


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of `keywords` that is part of the text, case and outer blanks ignored; null if none is."""
    label = F.lower(F.trim(text))
    return F.coalesce(*[F.when(F.contains(label, F.lit(k)), F.lit(k)) for k in keywords])


def phrase_match(expected: Column, heard: Column, active: Column) -> Column:
    """wer, matched and flagged; where the check is inactive or nothing is expected all is well."""
    off = ~active | (F.size(C.words(expected)) == 0)
    wer = F.when(off, 0.0).otherwise(C.word_error_rate(C.words(expected), C.words(heard)))
    return C.let(wer, lambda w: F.struct(w.alias("wer"), (w <= P.PHRASE_WER_HIGH).alias("matched"), (w > P.PHRASE_WER_HIGH).alias("flagged")))


def bilabial(word: Column) -> Column:
    return F.upper(F.left(F.trim(word), F.lit(1))).isin("B", "P", "M")


def bilabial_count(text: Column) -> Column:
    return F.size(F.filter(C.words(text), bilabial)).cast("long")
