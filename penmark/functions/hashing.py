"""Seeded, reproducible pseudo-random keys: the same on every engine and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_key(key: Column, seed: int) -> Column:
    """32-bit integer, uniform over keys: the first 8 hex digits of the MD5 of ``key:seed``."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("bigint")
