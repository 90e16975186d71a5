"""Mixing sources to target weights over fixed-length token blocks.

Style: DataFrame functions; NumPy on Arrow batches only for drawing and permuting block numbers.

1. A source's documents, in the order of a hash, form one word stream, cut into blocks of
   ``block_words`` words.  Stream offsets are prefix sums on three levels (hash bins of a source, equal
   rows of one input partition, single rows), so neither a large source nor a large group of equal
   rows is sorted in one task.
2. Targets: a source's share by weight, at most ``max_repeat`` times its size; the excess goes to
   the others by weight.  A target becomes a number of blocks.
3. Each output shard draws its block count per source from a multinomial whose probabilities are
   what is still open of the targets, so the shards' counts add up to the targets.  The driver draws
   for groups of shards only (about the square root of the number of shards); tasks draw for the
   shards of a group, with seeds fixed by the group.
4. Slot k of a source is block ``perm_e(k mod blocks)`` of pass e = k div blocks; ``perm_e`` is a
   keyed Feistel permutation with cycle walking, so slots need no shuffle to be random and reruns
   agree.  Slots meet the documents' pieces by (source, block).

A document's words are taken in at most ``ceil(target / size) <= max_repeat`` passes.

Nulls and limits: a null text has size 0; null sources form one source, placed last.  Empty texts are
never taken.  Repeated rows are separate parts of the stream.  Extra columns are ignored.  Sources
are a list of at most ``MAX_SOURCES`` (the plan and the draws hold a number for each); a table with
more raises an error that says so.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.common import KEYS, Store, row_keys, words

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
MAX_REPEAT = 3
MAX_SOURCES = 10_000
SEED = 17


def targets(sizes: list[int], weights: list[float], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Share ``sum(sizes)`` by weight; what lies above ``max_repeat`` times a size is shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > max_repeat * sizes[i]}
        for i in full or open_:
            out[i] = float(max_repeat * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def block_quota(size: int, target: float, block_words: int) -> tuple[int, int]:
    """Blocks of a source, and how many draws of them come nearest to its target."""
    blocks = -(-size // block_words)
    if not size:
        return 0, 0
    passes = int(target // size)
    rest = round((target - passes * size) / block_words)
    return blocks, passes * blocks + min(rest, blocks)


def shard_counts(quota: list[int], shard_blocks: int, seed: int) -> np.ndarray:
    """Blocks per (shard, source): multinomial draws from what is open, never above it."""
    left, rng, rows = np.array(quota, np.int64), np.random.default_rng(seed), []
    while left.sum():
        need, taken = min(shard_blocks, int(left.sum())), np.zeros(len(left), np.int64)
        while need:
            rest = left - taken
            draw = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            taken, need = taken + draw, need - int(draw.sum())
        rows.append(taken)
        left = left - taken
    return np.array(rows, np.int64).reshape(len(rows), len(quota))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under the permutation of [0, size) that its key names."""
    half = np.uint64(1)
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64)
    half = np.maximum((bits + half) // np.uint64(2), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.astype(np.uint64), np.ones(len(index), bool)
    bound = size.astype(np.uint64)
    while open_.any():
        left, right = out[open_] >> half[open_], out[open_] & mask[open_]
        for turn in range(4):
            mixed = right * np.uint64(0x9E3779B97F4A7C15) + key[open_] + np.uint64(turn * 0xD1B54A32D192ED03 % (1 << 64))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask[open_])
        out[open_] = left << half[open_] | right
        open_ &= out >= bound
    return out.astype(np.int64)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> DataFrame:
    """``doc_id, row, key_a, key_b, source, size, place`` of every row; ``row`` numbers the rows."""
    keys = row_keys(F.col(id_col), F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        *keys,
        F.col(source_col).cast("string").alias("source"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
    ).withColumn("place", F.xxhash64(F.lit("place"), *KEYS))


def source_plan(rows: DataFrame, weights: list[float], block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT) -> list[dict]:
    """One entry per source in code-point order, null last: number, size, target, blocks, quota."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; map them to fewer before mixing")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_repeat)
    plan = []
    for i, r in enumerate(found):
        blocks, quota = block_quota(sizes[i], goal[i], block_words)
        plan.append({"source": r["source"], "no": i, "source_size": sizes[i], "target": goal[i], "blocks": blocks, "quota": quota})
    return plan


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row's pieces of its source's blocks: ``no, block, row, at, len``, ``no`` the source's number."""
    some = rows.where("size > 0")
    bins = isqrt(some.count()) + 1  # bins per source and rows per bin grow alike
    # Row numbers hold the input partition in their upper bits, so equal rows of a partition lie together.
    equal = ["no", "bin", *KEYS, "part"]
    binned = some.withColumn("bin", F.pmod(F.shiftright("place", 20), F.lit(bins))).withColumn("part", F.shiftright("row", 33))
    groups = binned.groupBy(*equal).agg(F.first("place").alias("place"), F.sum("size").alias("all"))
    by_bin = groups.groupBy("no", "bin").agg(F.sum("all").alias("bin_size"))
    before = F.sum("bin_size").over(Window.partitionBy("no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    by_bin = by_bin.select("no", "bin", F.coalesce(before, F.lit(0)).alias("bin_start"))
    order = Window.partitionBy("no", "bin").orderBy("place", *KEYS, "part").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("ahead", F.sum("all").over(order) - F.col("all")).join(by_bin, ["no", "bin"])
    groups = groups.select(*equal, (F.col("bin_start") + F.col("ahead")).alias("group_start"))
    within = Window.partitionBy(*equal).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumn("own", F.sum("size").over(within) - F.col("size")).join(groups, equal)
    placed = placed.select("no", "row", "size", (F.col("group_start") + F.col("own")).alias("start"))
    blocks = F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    )
    cut = placed.select("*", F.explode(blocks).alias("block"))
    a = F.greatest(F.col("start"), F.col("block") * block_words)
    z = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.select("no", "block", "row", (a - F.col("start")).alias("at"), (z - a).alias("len"))


def slots(plan: list[dict], spark, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """``shard, no, pass, block``: one row per block that the mix takes.

    The driver draws for groups of shards, as many as a group has shards; tasks draw for the shards
    of their group from what the group drew."""
    quota = [p["quota"] for p in plan]
    in_group = isqrt(-(-sum(quota) // shard_blocks)) + 1  # shards of a group and groups grow alike
    counts = shard_counts(quota, shard_blocks * in_group, seed)
    starts = np.cumsum(counts, axis=0) - counts
    blocks = [max(1, p["blocks"]) for p in plan]
    table = [(g, counts[g].tolist(), starts[g].tolist()) for g in range(len(counts))]
    groups = spark.createDataFrame(table, "group bigint, open array<bigint>, first array<bigint>")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for group, open_, first in f.itertuples(index=False):
                n = shard_counts(list(open_), shard_blocks, seed + 1 + group)
                at = np.cumsum(n, axis=0) - n + np.asarray(first, np.int64)
                s, no = np.nonzero(n)
                columns = {"shard": group * in_group + s, "no": no, "first": at[s, no], "n": n[s, no], "blocks": np.take(blocks, no)}
                yield pd.DataFrame(columns)

    ranges = groups.mapInPandas(draw, "shard bigint, no int, first bigint, n bigint, blocks bigint")
    ks = ranges.select("shard", "no", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))
    ks = ks.select("shard", "no", "blocks", (F.col("k") / F.col("blocks")).cast("int").alias("pass"), F.expr("k % blocks").alias("i"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            key = (f["no"].to_numpy() * 1_000_003 + f["pass"].to_numpy() * 7919 + seed).astype(np.uint64)
            f["block"] = permute(f["i"].to_numpy(), f["blocks"].to_numpy(), key * np.uint64(0x9E3779B97F4A7C15))
            yield f[["shard", "no", "pass", "block"]]

    return ks.mapInPandas(run, "shard bigint, no int, pass int, block bigint")


WEIGHTS = [1.0, 2.0, 3.0]


class Mix:
    """The mix of one table: sized rows, the sources' plan, and the blocks that are drawn."""

    def __init__(
        self,
        docs: DataFrame,
        weights: list[float] = WEIGHTS,
        block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS,
        **columns,
    ):
        spark = docs.sparkSession
        self.store = Store(spark, "mix")
        self.rows = self.store.put(sized(docs, **columns), "rows")
        self.plan = source_plan(self.rows, weights, block_words)
        listed = [(p["source"], p["no"], p["source_size"], p["target"]) for p in self.plan]
        sources = F.broadcast(
            spark.createDataFrame(listed, "mixed_source string, no int, source_size bigint, target double")
        )
        self.named = self.rows.join(sources, F.col("source").eqNullSafe(F.col("mixed_source")))
        self.pieces = pieces(self.named, block_words)
        self.slots = slots(self.plan, spark, shard_blocks)

    def drawn(self) -> DataFrame:
        """Pieces with the passes that take them: ``no, block, row, at, len, passes``."""
        passes = self.slots.groupBy("no", "block").agg(F.collect_list("pass").alias("passes"))
        return self.pieces.join(passes, ["no", "block"])

    def taken(self) -> DataFrame:
        """One row per input row: ``doc_id, size, source_size, target, taken``."""
        by_row = self.drawn().groupBy("row").agg(F.sum(F.col("len") * F.size("passes")).alias("words"))
        return self.named.join(by_row, "row", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken")
        )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str = "n_chars",
    **options,
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row per document and pass that takes words of
    it, its text the words taken (unchanged where a pass takes all), ``chars_col`` its length.

    The numbered rows are stored first, so that equal rows stay apart."""
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    store = Store(docs.sparkSession, "mixed")
    numbered = store.put(docs.select(F.monotonically_increasing_id().alias("row"), struct), "numbered")
    fields = {"id_col": f"doc.{id_col}", "text_col": f"doc.{text_col}", "source_col": f"doc.{source_col}"}
    mix = Mix(numbered, row=F.col("row"), **fields, **options)
    spans = (
        mix.drawn()
        .select("row", "at", "len", F.explode("passes").alias("pass"))
        .groupBy("row", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("at", "len"))).alias("spans"), F.sum("len").alias("n"))
    )
    w = words(F.col(f"doc.{text_col}"))
    joined = numbered.join(spans, "row").select("doc", "spans", "n", w.alias("w"))
    parts = F.flatten(F.transform("spans", lambda s: F.slice("w", s["at"].cast("int") + 1, s["len"].cast("int"))))
    mixed = F.when(F.col("n") == F.size("w"), F.col(f"doc.{text_col}")).otherwise(F.array_join(parts, " "))
    out = joined.select("doc", mixed.alias("mixed"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {text_col: F.col("mixed")}
    if chars_col in columns:
        columns[chars_col] = F.length("mixed").cast(docs.schema[chars_col].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])
