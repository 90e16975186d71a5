"""Lexicon sentiment: mean over matched tokens, with negation and intensity from the tokens before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.arrays import array_mean, let
from penmark.functions.lexicon import (
    INTENSIFIERS,
    INTENSITY_FACTOR,
    NEGATION_FACTOR,
    NEGATORS,
    SENTIMENT,
)

Levels = list[tuple[float, float, list[str]]]


def sentiment(marks: Column, levels: Levels = SENTIMENT) -> Column:
    """``struct<polarity, subjectivity>`` of lower-cased tokens; 0 when no token is listed.

    The lexicon is grouped by level, so a token costs one hash lookup per level.  A negator in
    the two tokens before multiplies polarity by -0.5; an intensifier directly before
    multiplies it by 1.3, and the product stays within -1 and 1."""

    def score(tokens: Column, t: Column, i: Column) -> Column:
        level = F.lit(None).cast("struct<p:double,s:double>")
        for p, s, words in reversed(levels):
            here = F.struct(F.lit(float(p)).alias("p"), F.lit(float(s)).alias("s"))
            level = F.when(t.isin(words), here).otherwise(level)
        one, two = F.get(tokens, i - 1), F.get(tokens, i - 2)
        negated = F.coalesce(one.isin(NEGATORS), F.lit(False)) | F.coalesce(two.isin(NEGATORS), F.lit(False))
        factor = F.when(negated, F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0)) * F.when(
            one.isin(INTENSIFIERS), F.lit(INTENSITY_FACTOR)
        ).otherwise(F.lit(1.0))
        clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), level["p"] * factor))
        return F.struct(clipped.alias("p"), level["s"].alias("s"))

    listed = [w for _, _, ws in levels for w in ws]

    def of_tokens(tokens: Column) -> Column:
        hits = F.filter(
            F.transform(tokens, lambda t, i: F.when(t.isin(listed), score(tokens, t, i))),
            lambda h: h.isNotNull(),
        )
        return let(
            hits,
            lambda h: F.struct(
                array_mean(h, lambda x: x["p"]).alias("polarity"),
                array_mean(h, lambda x: x["s"]).alias("subjectivity"),
            ),
        )

    return let(marks, of_tokens)
