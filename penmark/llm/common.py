"""Shared parts: words, row keys, stored intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.session import ensure_checkpoint_dir

# Words are runs of anything but these six white-space characters.  ``bytes.split()`` in Python
# cuts UTF-8 at exactly the same six.
SPACE_RE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit columns that name a row by its id and text.  Never null; rows that are equal
    in both have equal keys, and every operator gives such rows equal results."""
    return [
        F.xxhash64(F.lit("id"), doc_id.cast("string")).alias("key_a"),
        F.xxhash64(F.lit("text"), text).alias("key_b"),
    ]


KEYS = ["key_a", "key_b"]


class Store:
    """Intermediate tables as Parquet below the session's shared checkpoint folder.

    A lost executor then costs the tasks it was running; what was stored stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of an id's text form modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
