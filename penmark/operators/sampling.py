"""Seeded sampling, shuffling and splitting by hash cuts.

A row's place is decided by a hash of its key, so results do not depend on partitioning, a
retried task picks the same rows, and sizes are exact: per class the rows with the k smallest
``(hash, key)`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.functions.hashing import hash_hex, hash_key
from penmark.physical import localize

CELL_BITS = 16  # the 32-bit hash range is cut into 2**16 cells per class


def class_cuts(df: DataFrame, col: str, frac: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Per class the largest ``(hash, key)`` that belongs to the sample: one row per class.

    No task ever sorts a whole class.  Rows are counted per hash cell; a running sum over the at
    most 65,536 cells finds the cell that holds the k-th row; only that cell's rows (a
    1/65,536th of the class, hashes being uniform) are ranked."""
    hashed = df.where(F.col(col).isNotNull()).select(
        F.col(col).alias("cls"), F.col(key).alias("k"), hash_key(F.col(key), seed).alias("u")
    )
    hashed = hashed.withColumn("cell", F.shiftright("u", 32 - CELL_BITS))
    cells = hashed.groupBy("cls", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("cls")
    running = by_class.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_cells = localize(
        cells.withColumn("upto", F.sum("n").over(running))
        .withColumn("take", F.bround(F.lit(frac) * F.sum("n").over(by_class), 0).cast("bigint"))
        .where("upto - n < take AND take <= upto")
        .select("cls", "cell", (F.col("take") - (F.col("upto") - F.col("n"))).alias("rank_in_cell"))
    )
    in_cell = Window.partitionBy("cls", "cell").orderBy("u", "k")
    return (
        hashed.join(cut_cells, ["cls", "cell"])
        .withColumn("rn", F.row_number().over(in_cell))
        .where("rn = rank_in_cell")
        .select("cls", F.col("u").alias("cut_u"), F.col("k").alias("cut_k"))
    )


def _flag(df: DataFrame, col: str, frac: float, seed: int, key: str) -> tuple[DataFrame, Column]:
    """Rows with their class's cut attached and the test whether a row is below it.  The cuts
    (one row per class) are computed once and are constants in every later plan; the rows
    themselves are not shuffled."""
    cuts = localize(class_cuts(df, col, frac, seed, key))
    u = hash_key(F.col(key), seed)
    below = (u < F.col("cut_u")) | ((u == F.col("cut_u")) & (F.col(key) <= F.col("cut_k")))
    joined = df.where(F.col(col).isNotNull()).join(cuts, F.col(col) == F.col("cls"), "left")
    return joined, F.coalesce(below, F.lit(False))


def stratified_sample(
    df: DataFrame, col: str = "label", frac: float = 0.01, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """``round(frac * class size)`` rows of every class; rows without a class are left out."""
    joined, below = _flag(df, col, frac, seed, key)
    return joined.where(below).select(*[f"`{c}`" for c in df.columns])


def shuffled(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Rows in a seeded pseudo-random order (range-partitioned sort, no single task)."""
    return df.withColumn("shuffle_key", hash_hex(F.col(key), seed)).orderBy("shuffle_key")


def with_split(
    df: DataFrame, label: str = "label", test: float = 0.2, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """All rows, with ``split`` set to ``test`` for the stratified share and ``train`` otherwise."""
    joined, below = _flag(df, label, test, seed, key)
    split = F.when(below, F.lit("test")).otherwise(F.lit("train")).alias("split")
    return joined.select(*[f"`{c}`" for c in df.columns], split)


def stratified_split(
    df: DataFrame, label: str = "label", test: float = 0.2, seed: int = 42, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint and together all labelled rows."""
    marked = with_split(df, label, test, seed, key)
    return tuple(marked.where(F.col("split") == s).drop("split") for s in ("train", "test"))
