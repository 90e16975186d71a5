"""SimHash near-duplicates through a Gray-order hierarchical index.

Style: Arrow batches with NumPy inside tasks; Spark does all grouping and joining.

1. One scan makes a 64-bit fingerprint per document (3-word shingles, XXH64, majority per bit).
2. Distinct fingerprints are routed by shared bits: if two differ in at most 3 of the free bits,
   they agree on at least one of 4 groups of those bits.  A routed group larger than
   ``max_group`` is routed again on its remaining bits, and so on; after five rounds 15 bits are
   free and a group of distinct fingerprints has at most 2^15 members, so groups are bounded by
   construction and nothing is dropped.
3. Inside a partition the fingerprints of each group lie in Gray order.  Runs of eight form leaf
   nodes, runs of eight nodes the nodes above.  A node holds the bits that all its members share
   and its parent does not hold yet.  A probe adds up differences on the way down and leaves
   whole groups as soon as the sum passes 3, or when the group is already in its own component.
4. Only links that join components leave a task (fewer than its rows); components are closed by
   star steps on stored edge tables.

Nulls and limits: a null text has no words (fingerprint zero), as has an empty one; all such rows
link with each other.  A null id takes part and is never a component's smallest id unless all are
null.  Repeated rows stay.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import KEYS, Store, row_keys
from penmark.llm.components import connected_components
from penmark.physical import broadcast_checked

SEED = 42
SHINGLE = 3
RADIUS = 3
FANOUT = 8
MAX_GROUP = 1 << 16
ALL_BITS = (1 << 64) - 1


def fingerprint(raw: bytes) -> int:
    """Fingerprint of one UTF-8 text, as an unsigned integer."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(tokens))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key_a, key_b, fp, rank`` per row; fp and rank hold 64 bits in a bigint."""
    keys = row_keys(F.col(id_col), F.col(text_col))
    picked = docs.select(F.col(id_col).alias("doc_id"), *keys, F.col(text_col).cast("binary").alias("raw"))
    bits = [T.StructField("fp", T.LongType()), T.StructField("rank", T.LongType())]
    schema = T.StructType([*picked.schema.fields[:3], *bits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = (x.as_py() for x in batch.column(3))
            fps = np.fromiter((fingerprint(x or b"") for x in raws), np.uint64, batch.num_rows)
            made = [pa.array(fps.view(np.int64)), pa.array(gray_rank(fps).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=schema.names)

    return picked.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def child_masks(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """``mask`` extended by each of ``parts`` groups of its free bits."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def routed(distinct: DataFrame, store: Store, max_group: int = MAX_GROUP) -> DataFrame:
    """``(fp, rank)`` -> ``(mask, pattern, fp, rank)``: pairs within the radius share a group.

    Rows of groups that are too large are stored and routed again; the masks of a round (at most
    4^5) are a small table of their own."""
    spark = distinct.sparkSession
    masks, done, rows, turn = {0}, None, distinct.select(F.lit(0).cast("bigint").alias("mask"), "fp", "rank"), 0
    while True:
        children = {m: child_masks(m) for m in masks}
        masks = {c for cs in children.values() for c in cs}
        lists = [(_signed(m), [_signed(c) for c in cs]) for m, cs in children.items()]
        if len(lists) == 1:
            rows = rows.withColumn("children", F.array(*[F.lit(c) for c in lists[0][1]]))
        else:
            rows = rows.join(F.broadcast(spark.createDataFrame(lists, "mask bigint, children array<bigint>")), "mask")
        rows = rows.select(F.explode("children").alias("mask"), "fp", "rank")
        rows = rows.withColumn("pattern", F.col("mask").bitwiseAND(F.col("fp")))
        if 1 << min(64 - m.bit_count() for m in masks) <= max_group:
            return rows if done is None else done.unionByName(rows)
        sizes = rows.groupBy("mask", "pattern").count()
        large = store.put(sizes.where(F.col("count") > max_group).select("mask", "pattern"), f"large{turn}")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, ["mask", "pattern"], "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, ["mask", "pattern"], "left_semi").select("mask", "fp", "rank")
        rows, turn = store.put(rows, f"rows{turn}"), turn + 1


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a and b; label holds each row's smallest known row."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first, first + 1, ... of each range, and the range each belongs to."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class GrayIndex:
    """Hierarchy over rows that are sorted by group and, within it, by Gray rank."""

    def __init__(self, fp: np.ndarray, group_start: np.ndarray):
        self.fp, self.levels = fp, []
        bounds, first = np.append(group_start, len(fp)), np.arange(len(fp))
        low, high, starts = fp, fp, group_start
        size = np.diff(bounds)
        while True:
            nodes = -(-size // FANOUT)
            at, group = _expand(np.zeros(len(size), np.int64), nodes)
            child = starts[group] + at * FANOUT
            count = np.minimum(FANOUT, starts[group] + size[group] - child)
            low, high = np.bitwise_and.reduceat(low, child), np.bitwise_or.reduceat(high, child)
            first = first[child]
            self.levels.append({"child": child, "count": count, "shared": ~(low ^ high), "pattern": low, "first": first})
            starts, size = np.cumsum(nodes) - nodes, nodes
            if (size <= 1).all():
                break
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            parent = np.repeat(np.arange(len(above["child"])), above["count"])
            below["own"] = below["shared"] & ~above["shared"][parent]
        self.levels[-1]["own"] = self.levels[-1]["shared"]
        for level in self.levels:
            level["last"] = np.append(level["first"][1:], len(fp)) - 1
        self.group_of = np.repeat(np.arange(len(group_start)), np.diff(bounds))

    def links(self, query: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, later row of its group) within the radius, but for groups of rows that
        are in the query's component already."""
        node, sums = self.group_of[query], np.zeros(len(query), np.int64)
        for level in reversed(self.levels):
            sums = sums + np.bitwise_count((self.fp[query] ^ level["pattern"][node]) & level["own"][node])
            low, high = np.minimum.reduceat(label, level["first"]), np.maximum.reduceat(label, level["first"])
            joined = (low[node] == high[node]) & (low[node] == label[query])
            keep = (sums <= RADIUS) & (level["last"][node] > query) & ~joined
            query, node, sums = query[keep], node[keep], sums[keep]
            rest = ~level["shared"][node]
            child, of = _expand(level["child"][node], level["count"][node])
            query, sums, rest, node = query[of], sums[of], rest[of], child
        near = (node > query) & (sums + np.bitwise_count((self.fp[query] ^ self.fp[node]) & rest) <= RADIUS)
        return query[near], node[near]


def local_links(fp: np.ndarray, group_start: np.ndarray, pairs_at_once: int = 1 << 20) -> np.ndarray:
    """For each row the first row of its component, by links within groups."""
    label = np.arange(len(fp))
    size = np.diff(np.append(group_start, len(fp)))
    live = np.repeat(size > 1, size)
    if not live.any():
        return label
    index, rows = GrayIndex(fp, group_start), np.flatnonzero(live)
    load = np.cumsum(np.repeat(size, size)[rows]) // pairs_at_once
    for part in np.split(rows, np.flatnonzero(np.diff(load)) + 1):
        _merge(label, *index.links(part, label))
    return label


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def linked(mask: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
        label = local_links(fp.view(np.uint64), np.concatenate(([0], change)))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        mask, pattern, _ = held
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
        if len(change):
            yield linked(*[x[: change[-1]] for x in held])
            held = [x[change[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield linked(*held)


def link_fingerprints(distinct: DataFrame, store: Store, max_group: int = MAX_GROUP) -> DataFrame:
    """``(fp, rank)``, distinct -> edges ``(u, v)`` whose components are those of all links."""
    groups = routed(distinct, store, max_group).repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
    return groups.select("mask", "pattern", "fp").mapInArrow(_link_batches, "u bigint, v bigint")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, key_a, key_b, root``; ``root`` is the
    smallest fingerprint of the component."""
    store = Store(docs.sparkSession, "simhash")
    rows = store.put(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = store.put(rows.groupBy("fp", "rank").agg(F.min("doc_id").alias("least")), "distinct")
    edges = link_fingerprints(distinct.select("fp", "rank"), store, max_group)
    roots = connected_components(edges, store).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    of = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    fingerprint_hex = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", fingerprint_hex, "component_id", *KEYS, "root")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per component, the one with the smallest id (of equal ids, by a hash of the
    text); all columns unchanged."""
    store = Store(docs.sparkSession, "one-per-group")
    groups = store.put(simhash_groups(docs, id_col, text_col, **options), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS)).alias("first")
    kept = groups.groupBy("root").agg(first).select("first.key_a", "first.key_b")
    by_key = groups.groupBy(*KEYS).agg(F.count("*").alias("n"))
    gone = broadcast_checked(store.put(by_key.join(kept, KEYS, "left_anti").select(*KEYS), "gone"))
    again = broadcast_checked(store.put(by_key.join(kept, KEYS, "left_semi").where("n > 1").select(*KEYS), "again"))
    names = [f"row {k}" for k in KEYS]  # not among the columns of docs
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_keys(docs[id_col], docs[text_col]), names, strict=True)])

    def on(table: DataFrame):
        return (F.col(f"`{names[0]}`") == table["key_a"]) & (F.col(f"`{names[1]}`") == table["key_b"])

    left = keyed.join(gone, on(gone), "left_anti")
    single = left.join(again, on(again), "left_anti")
    repeated = left.join(again, on(again), "left_semi").dropDuplicates(names)
    return single.unionByName(repeated).drop(*names)
