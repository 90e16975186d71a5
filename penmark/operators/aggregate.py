"""Grouped summaries: distributions, means, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """Rows per value, most frequent first.  Counts are combined before the shuffle, so one
    dominant value costs one row per task."""
    source = df.dropna(subset=[col]) if dropna else df
    counts = source.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last(col))


def mean_score(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.avg(col).alias(f"mean_{col}"))


def percentile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Linearly interpolated percentile of a short column (one value per feature or model).

    The exact aggregate keeps every distinct value in one buffer; that is right for a coefficient
    vector, whose length is the number of features, and wrong for a corpus column."""
    return df.agg(F.percentile(F.col(col), F.lit(q)).alias(f"{col}_percentile"))
