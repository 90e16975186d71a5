"""Benchmark decontamination, in DataFrame functions only.

An item of ``n`` five-word shingles is compared with document windows of ``n`` shingles.  A document
and an item match where the weighted Jaccard similarity of the two bags of shingles (sum of smaller
counts over sum of larger counts) is at least ``threshold``.

1. Anchors: positions whose shingle occurs in some item, with the sizes of those items.  If the first
   shingle of a window is not in the item, moving the window on by one never lowers the similarity,
   so only windows that start at an anchor (or end with the document) need to be looked at.  Those
   with fewer anchors than the threshold needs are left out by counting; both steps are exact.
2. The other windows get a SimHash of 64 bits, and so do the items.  Fingerprints are cut into
   ``radius + 1`` blocks; window and item of one size meet where a block is equal, which finds every
   pair of fingerprints within the radius.
3. Pairs within the radius are verified by the exact similarity.

Texts are lower-cased (A-Z).  The default radius of 20 bits lies more than three standard deviations
above the distance expected at similarity 0.8.

Nulls and limits: a null or short text (under five words) has no shingle and matches nothing; such
items neither.  A null id is kept in the result.  Repeated rows give one row.  Items with equal text
are all reported.  Extra columns are ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import KEYS, Store, lower_ascii, row_keys, words
from penmark.physical import broadcast_checked, posexplode_computed

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 20


def shingled(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` and ``sh``, the hashes of the text's shingles in order."""
    hashed = df.select(*keep, F.transform(words(lower_ascii(text)), lambda x: F.xxhash64(x)).alias("h"))
    names = [c for c in hashed.columns if c != "h"]
    return hashed.select(
        *names,
        F.transform(
            F.slice("h", 1, F.greatest(F.size("h") - (SHINGLE - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, SHINGLE)]),
        ).alias("sh"),
    )


def simhash(hashes: Column) -> Column:
    """Bit b is 1 if it is set in over half of the hashes."""
    call = F.call_function

    def ones(b: Column) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s + call("shiftrightunsigned", h, b).bitwiseAND(1))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("bigint"),
        lambda fp, b: F.when(2 * ones(b) > F.size(hashes), fp.bitwiseOR(call("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(fp),
    )


def numbered(hashes: Column) -> Column:
    """A bag as a set: each hash joined with its number among its equals."""
    return F.get(
        F.transform(
            F.array(F.sort_array(hashes)),
            lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))),
        ),
        F.lit(0),
    )


def block_masks(radius: int) -> list[int]:
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks(fp: Column, radius: int) -> Column:
    return F.array(
        *[
            F.struct(F.lit(b).alias("block"), fp.bitwiseAND(F.lit(m)).alias("bits"))
            for b, m in enumerate(block_masks(radius))
        ]
    )


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id, item_id, similarity, start, key_a, key_b``: for each document and item that match the
    best window; ``start`` is the position of its first word."""
    store = Store(docs.sparkSession, "decontaminate")
    parts = shingled(items, F.col(item_text_col), F.col(item_col).alias("item_id"))
    parts = parts.select(
        "item_id", "sh", F.size("sh").alias("n"), simhash(F.col("sh")).alias("item_fp"), numbered(F.col("sh")).alias("bag")
    )
    parts = store.put(parts, "items").where("n > 0")
    vocabulary = parts.select(F.explode("sh").alias("x"), "n").groupBy("x").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    vocabulary = broadcast_checked(store.put(vocabulary, "vocabulary"))

    keys = row_keys(F.col(id_col), F.col(text_col))
    found = posexplode_computed(shingled(docs, F.col(text_col), *keys), F.col("sh"), ["pos", "x"], KEYS)
    anchors = found.join(vocabulary, "x").groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("pos", "sizes"))).alias("m"))
    anchors = store.put(anchors, "anchors")

    a, b = keys
    few = broadcast_checked(anchors.select(F.col("key_a").alias("a_"), F.col("key_b").alias("b_")))
    hit = docs.join(few, (a == F.col("a_")) & (b == F.col("b_")), "left_semi")
    hit = shingled(hit, F.col(text_col), F.col(id_col).alias("doc_id"), *keys).join(anchors, KEYS)

    last = F.size("sh")

    def enough(j: Column, at: Column, n: Column) -> Column:
        need = F.ceil(F.lit(2 * threshold / (1 + threshold)) * n - 1e-9).cast("int")
        return (at + n > last) | (F.get("m", j + need - 1)["pos"] - at < n)

    starts = F.flatten(
        F.transform(
            "m",
            lambda x, j: F.transform(
                F.filter(x["sizes"], lambda n: enough(j, x["pos"], n)),
                lambda n: F.struct(F.least(x["pos"], F.greatest(last - n, F.lit(0))).alias("start"), n.alias("n")),
            ),
        )
    )
    spots = hit.select("doc_id", *KEYS, "sh", F.explode(F.array_distinct(starts)).alias("at"))
    windows = spots.select("doc_id", *KEYS, "at.start", "at.n", F.slice("sh", F.col("at.start") + 1, F.col("at.n")).alias("win"))
    windows = windows.withColumn("fp", simhash(F.col("win")))
    windows = windows.select("*", F.inline(blocks(F.col("fp"), radius)))

    probes = broadcast_checked(parts.select("item_id", "n", "item_fp", "bag", F.inline(blocks(F.col("item_fp"), radius))))
    met = windows.join(probes, ["n", "block", "bits"]).withColumn("differ", F.col("fp").bitwiseXOR(F.col("item_fp")))
    first = F.coalesce(*[F.when(F.col("differ").bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(block_masks(radius))])
    near = met.where((F.col("block") == first) & (F.bit_count("differ") <= radius))
    common = F.size(F.array_intersect(numbered(F.col("win")), "bag"))
    scored = near.select("doc_id", *KEYS, "item_id", "start", common.alias("common"), (F.size("win") + F.size("bag")).alias("both"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("both") - F.col("common")))
    best = scored.where(F.col("similarity") >= threshold).groupBy("doc_id", *KEYS, "item_id")
    best = best.agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), *KEYS)


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns unchanged."""
    found = matches(docs, items, id_col, text_col, **options).select(*KEYS).distinct()
    gone = broadcast_checked(Store(docs.sparkSession, "contaminated").put(found, "rows"))
    a, b = row_keys(docs[id_col], docs[text_col])
    return docs.join(gone, (a == gone["key_a"]) & (b == gone["key_b"]), "left_anti")
