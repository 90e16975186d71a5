"""Sharding through a permutation-filled lookup table, in DataFrame functions only.

Every shard orders the slots of a prime-sized table by its own permutation (an offset and a step
from a hash of its name); the shards take turns claiming the first free slot of their order.  Shards
then own slots in equal numbers, give or take one, and most slots keep their owner when a shard
comes or goes.  The table has a fixed number of small rows and is broadcast; a row's slot is a hash
of its key modulo the table size, so placement is one look-up per row, without a shuffle.

Nulls and limits: a null key is replaced by the text, so rows without id spread; rows that are null
in both go to one slot.  Equal keys share a slot.  Columns of the input that are called like an
output column are replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    """The smallest prime that is at least ``n``."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(names: list[str], size: int) -> list[int]:
    """Owner (index into ``names``) of each of ``size`` slots; ``size`` must be prime."""
    owner, left = [-1] * size, size
    at = [_number(name, "offset") % size for name in names]
    step = [_number(name, "step") % (size - 1) + 1 for name in names]
    while left:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def lookup(spark: SparkSession, shards: int = SHARDS) -> DataFrame:
    """``(slot, shard)``, ``next_prime(SLOTS_PER_SHARD * shards)`` rows."""
    owner = fill_table(shard_names(shards), next_prime(SLOTS_PER_SHARD * shards))
    return spark.createDataFrame(list(enumerate(owner)), "slot bigint, shard int")


def slot_of(key: Column, text: Column, size: int) -> Column:
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``."""
    size = next_prime(SLOTS_PER_SHARD * shards)
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(id_col), F.col(text_col), size))
    placed = keyed.join(F.broadcast(lookup(docs.sparkSession, shards)), "slot")
    return placed.select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard below ``path``, each in ``files_per_shard`` files."""
    part = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
