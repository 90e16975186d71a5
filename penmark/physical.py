"""Physical helpers: size-checked broadcast, bounded driver-side tables, spread-out join keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast lookup table may hold at most this many rows and this many bytes of values.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 200_000_000
# A table whose rows pass through the driver as model parameters may hold at most this many.
MAX_LOCAL_ROWS = 100_000


def value_bytes(field: T.StructField) -> Column:
    """Bytes that a value takes, about: length of text, 8 for a number, JSON length for the rest."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        size = F.octet_length(col)
    elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        size = 8 * F.size(col)
    elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        size = F.octet_length(F.to_json(F.struct(col)))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0))


def fits(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.  Reads ``df`` once, so
    what is dear to compute is stored first."""
    size = sum((value_bytes(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and held <= max_bytes


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after rows and bytes were measured; otherwise leave the choice to Spark
    (a shuffle join, with skewed partitions split by adaptive execution)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def localize(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame:
    """Run ``df`` once and return it as a small constant table with a broadcast hint.

    Meant for per-class, per-bin or per-feature tables that later steps read several times.
    A table that turns out larger than ``max_rows`` is returned unchanged and without hint."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def at_least_top(df: DataFrame, count: str, m: int) -> DataFrame:
    """The rows that can be among the ``m`` with the largest positive ``count``: all rows of the
    highest count cells (sixteenths of an octave) that together hold ``m``.  Beyond ``m`` these are
    the rows of the last cell only, however many tasks there are.  ``df`` is read twice."""
    cell = F.floor(16 * F.log2(F.col(count)))
    left = m
    for r in df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("cell")).collect():
        left -= r["n"]
        if left <= 0:
            return df.where(cell >= r["cell"])
    return df


def at_most_top(df: DataFrame, count: str, m: int) -> DataFrame:
    """The rows of the highest count cells (as in ``at_least_top``) that together hold at most ``m``."""
    cell = F.floor(16 * F.log2(F.col(count)))
    left = m
    for r in df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("cell")).collect():
        left -= r["n"]
        if left < 0:
            return df.where(cell > r["cell"])
    return df


def join_frequent(df: DataFrame, table: DataFrame, key: str, frequent: DataFrame) -> DataFrame:
    """Inner join with a stored ``table`` of one row per ``key``.  Where it is too large to broadcast, only its
    rows with a ``frequent`` key are, and only the rows of ``df`` with another key are shuffled."""
    if fits(table, MAX_BROADCAST_ROWS):
        return df.join(F.broadcast(table), key)
    names = F.broadcast(frequent.select(F.col(frequent.columns[0]).alias(key)))
    near = F.broadcast(table.join(names, key, "left_semi"))
    return df.join(near, key).unionByName(df.join(names, key, "left_anti").join(table, key))


def collect_top(df: DataFrame, count: str, then: Sequence[Column], m: int) -> list[Row]:
    """The first ``m`` rows by falling ``count``, then by ``then``; ``df`` is a stored table.

    Rows below the last count cell stay in their tasks, so what reaches the driver does not grow
    with the number of tasks."""
    return at_least_top(df, count, m).orderBy(F.desc(count), *then).limit(m).collect()


def spread_unmatched(key: Column, can_match: Column, *row_id: Column) -> Column:
    """Non-negative integer join key that sends rows which cannot match to many partitions.

    A left join hashes all rows with the same key (for example null) to one task.  Rows known
    not to match get a private negative key that no lookup row carries."""
    private = -1 - F.pmod(F.xxhash64(*row_id), F.lit(1 << 40))
    return F.when(can_match, key.cast("bigint")).otherwise(private)


def spread_small(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Redistribute rows when the scanned table has fewer splits than the session has cores (one
    small file), so that row-local work uses them all.  A table with enough splits is left as it
    is.  ``source`` is the table whose splits decide, when ``df`` is already a join: counting the
    splits of a scan runs no job."""
    spark: SparkSession = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if (df if source is None else source).rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def explode_computed(df: DataFrame, items: Column, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``explode`` of a computed array or map, one row per element.

    For a plain explode the optimizer adds a "not empty" filter below it, which evaluates the
    whole expression a second time; the outer form followed by a null test on the first output
    column does not.  Elements must not be null."""
    exploded = df.select(*keep, F.explode_outer(items).alias(*names))
    return exploded.where(F.col(names[0]).isNotNull())


def posexplode_computed(df: DataFrame, items: Column, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``explode_computed`` with positions from 0; null elements are kept."""
    exploded = df.select(*keep, F.posexplode_outer(items).alias(*names))
    return exploded.where(F.col(names[0]).isNotNull())


def inline_computed(df: DataFrame, structs: Column, first: str, keep: Sequence[str] = ()) -> DataFrame:
    """``inline`` of a computed array of structs whose field ``first`` is never null."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(f"`{first}`").isNotNull())
