"""Orders, ranks and step-down corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.session import materialize

CELLS = 1 << 20  # cells per unit of value in the signed-rank sums


def value_cell(value: Column) -> Column:
    """Order-preserving cell of a value in [0, 1]: with values rounded to 12 digits a cell holds at
    most about a million distinct ones, and there are at most 2**20 cells."""
    return F.floor(value * F.lit(float(CELLS))).cast("bigint")


def average_rank(df: DataFrame, part: str, col: str, partitions: int | None = None) -> DataFrame:
    """Average rank (ties share the mean of their places) per distinct value:
    ``(part, value, ties, rank)``.

    Equal values are counted before the shuffle, so a value shared by a third of all rows is one
    row per task.  The distinct values are then range-partitioned by part and value and stored; a
    rank is the running count inside its range plus the counts of the ranges before it.  Ranges
    are of about equal size whatever the parts, the number of values or their distribution, so a
    task shrinks as ``partitions`` (default: the session's shuffle partitions) grows.
    A null part is a part of its own; null and NaN values rank last."""
    counts = df.groupBy(part, F.round(F.col(col), 12).alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    by_value = F.asc_nulls_last("value")
    many = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        counts.repartitionByRange(many, F.asc_nulls_first(part), by_value).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranged.groupBy(part, "_range").agg(F.sum("ties").alias("_size"))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(part).alias("_part"), F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    upto = Window.partitionBy(part, "_range").orderBy(by_value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_upto", F.sum("ties").over(upto)).join(
        offsets, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_at"))
    )
    rank = F.col("_offset") + F.col("_upto") - (F.col("ties") - 1) / F.lit(2).cast("double")
    return placed.select(part, "value", "ties", rank.alias("rank"))


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Adds the place of each row, from 0, in the order of a sorted table.

    The sorted partitions are stored; a place is the row's number in its partition plus the rows
    of the partitions before it, so no task sees more than its partition."""
    numbered = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()))
    # The upper bits of the id number the partition, the lower 33 the row.
    sizes = numbered.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_part"))
        .select(*[f"`{c}`" for c in ordered.columns], place.alias(name))
    )


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ("Variant", "Classifier")) -> DataFrame:
    """The k largest by ``by``; each task keeps k rows, so there is no full sort."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def rank_features(importances: DataFrame) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature")


def order_by_list(df: DataFrame, col: str, order: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Sort by a declared order of values, then by further columns; other values come last."""
    position = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        position = F.when(F.col(col) == value, F.lit(i)).otherwise(position)
    return df.orderBy(position, *then)


def holm(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Holm step-down: adds ``p_value_corrected`` and ``significant``.  The input has one row per
    compared pair.  A null p stays null, is not significant, and does not count as a test."""
    w = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p)
    every = Window.partitionBy(*by, F.col(p).isNull())
    stepped = F.least(F.lit(1.0), (F.count(p).over(every) - F.row_number().over(w) + 1) * F.col(p))
    out = tests.withColumn("_stepped", stepped).withColumn(
        "p_value_corrected",
        F.when(
            F.col(p).isNotNull(),
            F.max("_stepped").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        ),
    )
    return out.drop("_stepped").withColumn(
        "significant", F.coalesce(F.col("p_value_corrected") <= alpha, F.lit(False))
    )


def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Single-step alternative to ``holm`` with the same output columns."""
    m = F.count(p).over(Window.partitionBy())
    corrected = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m))
    return tests.withColumn("p_value_corrected", corrected).withColumn(
        "significant", F.coalesce(F.col("p_value_corrected") <= alpha, F.lit(False))
    )
