"""Connector phrases: substring counts on lower-cased text without symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.arrays import ratio
from penmark.functions.tokens import IS_PUNCT_RE

# Fixed value: the symbols removed before counting (. , ; ! ? stay).
REMOVED_SYMBOLS = "\"#$%&'()*+-/:<=>@[\\]^_`{|}~"


def clean_phrases(phrases: Sequence[str]) -> list[str]:
    """Phrases in the given order, without empty ones and repeats."""
    return list(dict.fromkeys(p for p in phrases if p))


def strip_symbols(text: Column) -> Column:
    return F.translate(F.lower(text), REMOVED_SYMBOLS, "")


def phrase_count(stripped: Column, phrase: str) -> Column:
    """Non-overlapping substring count, as many as removing the phrase shortens the text by."""
    p = phrase.lower()
    removed = F.replace(stripped, F.lit(p), F.lit(""))
    return ((F.length(stripped) - F.length(removed)) / F.lit(len(p))).cast("int")


def connector_counts(stripped: Column, phrases: Sequence[str]) -> Column:
    """``map<phrase, count>``; a phrase without hits counts 0."""
    phrases = clean_phrases(phrases)
    return F.map_from_arrays(
        F.array(*[F.lit(p) for p in phrases]),
        F.array(*[phrase_count(stripped, p) for p in phrases]),
    )


def total_connectors(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)


def unique_connectors(counts: Column) -> Column:
    return F.size(F.filter(F.map_values(counts), lambda x: x > 0))


def connector_density(total: Column, marks: Column) -> Column:
    """Connectors per token that is not punctuation."""
    return ratio(total, F.size(F.filter(marks, lambda t: ~t.rlike(IS_PUNCT_RE))))
