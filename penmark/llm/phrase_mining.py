"""Phrase collocation mining by multikey quicksort of suffix pointers.

Style: Arrow batches with NumPy inside tasks; Spark does all grouping, routing and joining.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at
spaces and tabs.  Everything is counted per language.  Words are 64-bit hashes that include the language.

1. Routing by leading words, first word: one scan counts words (per-task sums, then Spark's).
2. Leading pair: a second scan adds up pair counts in a count-min sketch of fixed size (``bits`` cells,
   merged slice by slice).  Only one bit per cell, "reaches ``least``", goes to the tasks.  Sketches only
   overestimate: pairs under ``least`` are abandoned there and none over it is lost.
3. A third scan sends the suffixes that start with a kept pair, cut at the first pair not kept and at
   ``longest`` words, equal ones of a task combined.  They are dealt by their leading pair; pairs that
   hold a large share of the rows by three words, and such triples by four, so no pair is ever in one
   task beyond a share of a partition.  Sums for those few split prefixes are made beside it.
4. Each task sorts its suffix pointers by three-way multikey quicksort, word by word, all segments of a
   round at once.  The sizes of equal partitions are the phrase counts; partitions under ``least`` are
   abandoned at every depth.
5. Counts of the two sides of every cut are joined to the phrases, the lowest-scoring cut is kept, and
   phrases inside a longer one that nearly always surrounds them go.  The first ``top`` of a language are
   taken in levels, so no task sees more than a bounded number of lists.

Exactness: products are decimals of up to 38 digits.  Words are told apart by 64-bit hashes.

Nulls and limits: a null text is empty, a null language ``und``.  Repeated rows count each time.  Ids are
not read.  Extra columns are ignored.  An empty table, or one without a phrase of ``least`` occurrences,
gives an empty table.  A sketch full of pairs (far beyond 10^8 of them) abandons less and loses nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.common import Store
from penmark.llm.substring_dedup import mix
from penmark.physical import broadcast_checked

LEAST = 30
LONGEST = 4
TOP = 2000
INSIDE_PERCENT = 80
SCORE = 2_000_000
SKETCH_BITS = 27
# Bytes of text that a task hashes at once, and suffixes that it sorts at once.
BYTES_AT_ONCE = 16_000_000
SUFFIXES_AT_ONCE = 1_000_000
UNNAMED = "und"

_CUTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
WORDS = ["w1", "w2", "w3", "w4"]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Texts as one stream: index of each token in the list of distinct ones; ``.`` and the empty token
    end a piece, all others are words."""
    data = b".".join(texts).lower().translate(_CUTS).replace(b".", b" . ")
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    coded = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()


def hashes(language: str, words: list[bytes]) -> np.ndarray:
    """64-bit names of words in a language; 0 for tokens that end a piece."""
    base = np.uint64(xxhash.xxh3_64_intdigest(language.encode(), 1))
    out = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ base)
    out[out == 0] = 1
    out[[i for i, w in enumerate(words) if w in (b"", b".")]] = 0
    return out


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, token indices, distinct tokens) of about BYTES_AT_ONCE bytes; batches: raw, language."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for raw, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[language].append(raw or b"")
            size += len(raw or b"") + 1
            if size >= BYTES_AT_ONCE:
                for key, texts in held.items():
                    yield key, *tokens(texts)
                held, size = defaultdict(list), 0
    for key, texts in held.items():
        yield key, *tokens(texts)


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64(0x9E3779B97F4A7C15)))


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def word_counts(docs: DataFrame) -> DataFrame:
    """``language, word, h, n``; the row without a word holds the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, index, words in streams(batches):
            h, n = hashes(language, words), np.bincount(index, minlength=len(words))
            at = np.flatnonzero(h)
            named = pa.array([words[i] for i in at] + [None], pa.binary()).cast(pa.string())
            columns = [named, pa.array(np.append(h[at], np.uint64(0)).view(np.int64)), pa.array(np.append(n[at], n[at].sum()))]
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(named)), *columns], names=["language", "word", "h", "n"])

    parts = docs.mapInArrow(run, "language string, word string, h bigint, n bigint")
    return parts.groupBy("language", "word", "h").agg(F.sum("n").alias("n"))


def frequent_cells(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """One bit per sketch cell: the pairs of the cell occur ``least`` times or more together."""
    slice_bits, cap = min(bits, 20), min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, index, words in streams(batches):
            h = hashes(language, words)[index]
            both = (h[:-1] != 0) & (h[1:] != 0)
            cell = pair_names(h[:-1][both], h[1:][both]) >> np.uint64(64 - bits)
            cell, n = np.unique(cell.astype(np.int64), return_counts=True)
            cut = np.flatnonzero(np.diff(cell >> slice_bits)) + 1
            rows = [x for x in zip(np.split(cell, cut), np.split(n, cut), strict=True) if len(x[0])]
            piece = [int(c[0] >> slice_bits) for c, _ in rows]
            low = [(c & ((1 << slice_bits) - 1)).astype(np.uint32).tobytes() for c, _ in rows]
            times = [np.minimum(k, cap).astype(np.uint8).tobytes() for _, k in rows]
            arrays = [pa.array(piece, pa.int32()), pa.array(low, pa.binary()), pa.array(times, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "low", "times"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            arrays = [pa.array([piece], pa.int32()), pa.array([np.packbits(total >= cap).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["piece", "bits"])

        piece, total = None, None
        for batch in batches:
            for at, low, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != piece:
                    if piece is not None:
                        yield out()
                    piece, total = at, np.zeros(1 << slice_bits, np.uint16)
                cells = np.frombuffer(low, np.uint32)
                total[cells] = np.minimum(total[cells] + np.frombuffer(times, np.uint8), cap)
        if piece is not None:
            yield out()

    parts = docs.mapInArrow(count, "piece int, low binary, times binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, bits binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in merged.toLocalIterator():  # fixed size, whatever the corpus
        part = np.frombuffer(row["bits"], np.uint8)
        out[row["piece"] * len(part) : (row["piece"] + 1) * len(part)] = part
    return out


def suffixes(docs: DataFrame, frequent: np.ndarray, longest: int) -> DataFrame:
    """``w1 ... w4, n``: suffixes from kept pairs on, 0 where one ends; equal ones of a stream combined."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    bits = (len(frequent) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, index, words in streams(batches):
            h = np.append(hashes(language, words)[index], np.zeros(3, np.uint64))
            n = len(h) - 3
            cell = pair_names(h[:-1], h[1:]) >> np.uint64(64 - bits)
            kept = (shared.value[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1
            on = (kept != 0) & (h[:-1] != 0) & (h[1:] != 0)
            at = np.flatnonzero(on[:n])
            keys, name, going = [h[at]], h[at], np.ones(len(at), bool)
            for d in range(1, 4):
                going = going & on[at + d - 1] if d < longest else np.zeros(len(at), bool)
                keys.append(np.where(going, h[np.minimum(at + d, n)], np.uint64(0)))
                name = pair_names(name, keys[-1])
            _, first, times = np.unique(name, return_index=True, return_counts=True)
            yield _batch([*WORDS, "n"], [*(k[first] for k in keys), times.astype(np.int64)])

    return docs.mapInArrow(run, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint")


def equal_partitions(keys: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of the pointers 0 ... n - 1; ``keys``: one row per depth, 0 past the end.

    (depth from 1, a pointer, total weight) of every equal partition that weighs ``least`` or more.  All
    segments of a round are split at once, each at the median of three of its keys at its depth;
    lighter parts, and parts past the end, are abandoned."""
    pointer = np.arange(keys.shape[1])
    start, depth = np.zeros(min(1, len(pointer)), np.int64), np.zeros(min(1, len(pointer)), np.int64)
    found = []
    while len(start):
        size = np.diff(np.append(start, len(pointer)))
        segment = np.repeat(np.arange(len(start)), size)
        key = keys[depth[segment], pointer]
        a, b, c = key[start], key[start + size // 2], key[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        side = (key >= pivot[segment]).astype(np.int64) + (key > pivot[segment])
        part = 3 * segment + side
        total = np.bincount(part, weights=weight[pointer], minlength=3 * len(start)).astype(np.int64).reshape(-1, 3)
        heavy = total >= least
        heavy[:, 1] &= pivot != 0
        pointers, starts, depths, held = [], [], [], 0
        for s in range(3):
            at = np.flatnonzero((side == s) & heavy[segment, s])
            of = segment[at]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if s == 1:
                found.append((depth[of[first]] + 1, pointer[at[first]], total[of[first], 1]))
                going = depth[of] + 1 < len(keys)
                at, of = at[going], of[going]
                first = np.flatnonzero(np.diff(of, prepend=-1))
            pointers.append(pointer[at])
            starts.append(first + held)
            depths.append(depth[of[first]] + (s == 1))
            held += len(at)
        pointer, start, depth = (np.concatenate(x) for x in (pointers, starts, depths))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


PHRASES = "w1 bigint, w2 bigint, w3 bigint, w4 bigint, size int, a bigint"


def sorted_counts(dealt: DataFrame, least: int) -> DataFrame:
    """Phrases of each route; ``dealt`` (w1 ... w4, n, depth, route) is in order of route within a task.
    A phrase shorter than the route it was dealt by is spread over routes and is left to ``split``."""

    def phrases(rows: pa.Table) -> pa.RecordBatch:
        every = [np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        dealt_by = rows["depth"].to_numpy()
        for by in np.unique(dealt_by):
            own = rows.filter(pa.array(dealt_by == by))
            keys = np.stack([own[w].to_numpy().view(np.uint64) for w in WORDS])
            depth, at, a = equal_partitions(keys, own["n"].to_numpy(), least)
            whole = depth >= by
            depth, at, a = depth[whole], at[whole], a[whole]
            words = np.where(np.arange(4)[None, :] < depth[:, None], keys.T[at].view(np.int64), 0)
            every = [np.concatenate(x) for x in zip(every, (words, depth, a), strict=True)]
        words, depth, a = every
        several = depth > 1
        columns = [pa.array(np.ascontiguousarray(words[several, i])) for i in range(4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(depth[several], pa.int32()), pa.array(a[several])], names=[*WORDS, "size", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if len(held) >= SUFFIXES_AT_ONCE:
                route = held["route"].to_numpy()
                whole = int(np.searchsorted(route, route[-1]))
                if whole:
                    yield phrases(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and len(held):
            yield phrases(held)

    return dealt.mapInArrow(run, PHRASES)


def phrase_counts(docs: DataFrame, store: Store, least: int = LEAST, longest: int = LONGEST, bits: int = SKETCH_BITS, split_at: int | None = None) -> DataFrame:
    """Stored ``w1 ... w4, size, a``: every phrase of 2 to ``longest`` words with a >= ``least``."""
    spark = docs.sparkSession
    found = store.put(suffixes(docs, frequent_cells(docs, least, bits), longest), "suffixes")
    if split_at is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        split_at = max(1000, found.count() // (2 * parts))

    def heavy(rows: DataFrame, words: list[str]) -> DataFrame:
        """Prefixes with more rows than a task should take: at most twice the number of tasks."""
        counted = rows.groupBy(*words).agg(F.count("*").alias("rows"), F.sum("n").alias("a"))
        return store.put(counted.where(F.col("rows") > split_at), f"heavy_{len(words)}")

    pairs = heavy(found, WORDS[:2])
    triples = heavy(found.join(F.broadcast(pairs.select("w1", "w2")), ["w1", "w2"], "left_semi"), WORDS[:3])
    marked = found.join(F.broadcast(pairs.select("w1", "w2", F.lit(True).alias("by_3"))), ["w1", "w2"], "left")
    marked = marked.join(F.broadcast(triples.select(*WORDS[:3], F.lit(True).alias("by_4"))), WORDS[:3], "left")
    depth = F.when(F.col("by_4"), 4).when(F.col("by_3"), 3).otherwise(2)
    third = F.when(F.col("by_3"), F.col("w3"))
    fourth = F.when(F.col("by_4"), F.col("w4"))
    dealt = marked.select(*WORDS, "n", depth.alias("depth"), F.xxhash64("w1", "w2", third, fourth).alias("route"))
    dealt = dealt.repartition("route").sortWithinPartitions("route")
    zero = F.lit(0).cast("bigint")
    split = [sorted_counts(dealt, least)]
    for table, size in ((pairs, 2), (triples, 3)):
        words = [F.col(w) if i < size else zero.alias(w) for i, w in enumerate(WORDS)]
        split.append(table.where((F.col("a") >= least) & (F.col(f"w{size}") != 0)).select(*words, F.lit(size).alias("size"), "a"))
    out = store.put(split[0].unionByName(split[1]).unionByName(split[2]), "phrases")
    store.drop("suffixes")
    return out


def _key(words: list[Column], prefix: str) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [(words[i] if i < len(words) else zero).alias(f"{prefix}{i + 1}") for i in range(3)]


def cut_scores(phrases: DataFrame, words: DataFrame, score: int = SCORE) -> DataFrame:
    """``w1 ... w4, size, a, l, r, score`` at the lowest-scoring cut of each phrase."""
    w = [F.col(x) for x in WORDS]
    cuts = []
    for size in (2, 3, 4):
        for k in range(1, size):
            sides = [*_key(w[:k], "l"), *_key(w[k:size], "r")]
            cuts.append(F.when(F.col("size") == size, F.struct(F.lit(k).alias("k"), *sides)))
    rows = phrases.select(*WORDS, "size", "a", F.inline(F.array_compact(F.array(*cuts))))
    counts = words.select(*_key([F.col("h")], "p"), F.col("n").alias("f"))
    counts = counts.unionByName(phrases.where("size < 4").select(*_key(w[:3], "p"), F.col("a").alias("f")))
    for side in "lr":
        rows = rows.join(counts.toDF(f"{side}1", f"{side}2", f"{side}3", side), [f"{side}{i}" for i in (1, 2, 3)])
    value = F.expr(f"(cast({score} as decimal(12, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy(*WORDS, "size", "a").agg(best).select(*WORDS, "size", "a", "best.l", "best.r", "best.score")


def outside(scored: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """Without phrases that lie in a longer one with at least ``inside_percent`` of their occurrences."""
    w = [F.col(x) for x in WORDS]
    parts = [
        F.when(F.col("size") == size, F.struct(*_key(w[i : i + n], "w")))
        for size in (3, 4)
        for n in range(2, size)
        for i in range(size - n + 1)
    ]
    longer = scored.where("size > 2").select("a", F.inline(F.array_compact(F.array(*parts))))
    longer = longer.groupBy("w1", "w2", "w3").agg(F.max("a").alias("around"))
    joined = scored.join(longer.withColumn("w4", F.lit(0).cast("bigint")), WORDS, "left")
    wide = [F.col(c).cast("decimal(19, 0)") for c in ("around", "a")]
    return joined.where(F.col("around").isNull() | (100 * wide[0] < inside_percent * wide[1])).drop("around")


def first_of_each(rows: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of every key with their ``rank``, in levels of salted windows."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    while salts > 1:
        salt = F.pmod(F.xxhash64(*WORDS), F.lit(salts)).alias("salt")
        by = Window.partitionBy(key, "salt").orderBy(*order)
        rows = rows.select(*names, salt).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select(*names)
        salts //= 32
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    inside_percent: int = INSIDE_PERCENT,
    bits: int = SKETCH_BITS,
    split_at: int | None = None,
) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    if not 2 <= longest <= len(WORDS):
        raise ValueError("phrases have 2 to 4 words")
    store = Store(docs.sparkSession, "phrases")
    rows = docs.select(F.col(text_col).cast("binary").alias("raw"), F.coalesce(F.col(lang_col), F.lit(UNNAMED)).alias("language"))
    counted = store.put(word_counts(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    words = counted.where(F.col("word").isNotNull())
    phrases = phrase_counts(rows, store, least, longest, bits, split_at)
    kept = store.put(outside(cut_scores(phrases, words), inside_percent), "kept")

    places = F.array(*[F.struct(F.lit(i).alias("place"), F.col(w).alias("h")) for i, w in enumerate(WORDS)])
    spelt = kept.select(*WORDS, F.inline(F.filter(places, lambda p: p.h != 0)))
    named = store.put(words.join(spelt.select("h").distinct(), "h", "left_semi").select("h", "word", "language"), "named")
    spelt = spelt.join(broadcast_checked(named, 200_000), "h").groupBy(*WORDS)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda p: p.word)
    spelt = spelt.agg(F.array_join(parts, " ").alias("phrase"), F.min("language").alias("lang"))
    full = store.put(kept.join(spelt, WORDS), "full")

    ranked = first_of_each(full, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    total = counted.where(F.col("word").isNull()).select(F.col("language").alias("lang"), "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
