"""Exact substring dedup behind a count-min prefilter.

Style: Arrow batches with NumPy inside tasks; Spark does all grouping and joining.

A window is ``WINDOW`` consecutive words of one document.  Consecutive windows that share their least
18-word gram (by hash) form a *span* of at most 18 windows; equal windows have equal least grams, so
it is enough to look at places with a repeated least gram, about one per ten words.

1. First scan: every task counts its least grams in sparse two-row count-min sketches; slices of the
   sketches are added up per slice and reduced to one bit per cell, "counted at least twice".  The
   merged sketch has a fixed size (2 x 2^27 bits, 32 MB) and is broadcast.  It only overestimates: a
   larger corpus lets more unique spans through, which costs time and loses nothing.
2. Second scan: spans whose gram is estimated repeated go out as 128-bit hashes and are grouped
   exactly.  A span found twice is repeated as a whole.
3. Where different spans share a gram (edges of passages), one occurrence of each sends its single
   windows, which are grouped exactly, each weighted with its span's count.
4. Windows that repeat within one span (short periods) are found in the row.
5. The ranges of a document meet its text once; words they cover are removed.

All comparisons use two independent 64-bit hashes.  Nothing but a document's own ranges is ever
collected, and hot windows are counted before the shuffle.

Nulls and limits: a null or short text has no window and keeps its words (none for null).  A null id
is kept.  Equal rows are separate documents and repeat each other.  Extra columns are ignored.  An
empty table gives an empty table.
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
from penmark.physical import broadcast_checked

WINDOW = 35
GRAM = 18
SKETCH_BITS = 27
SKETCH_ROWS = 2
# Words that are hashed at once, and grams a task holds before it sends its sketch.
WORDS_AT_ONCE = 200_000
GRAMS_AT_ONCE = 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stream:
    """Word hashes of several texts in a row, with prefix sums for the hash of any run of words."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.tokens = [t.split() for t in texts]
        flat = [w for ws in self.tokens for w in ws]
        digests = b"".join(map(xxhash.xxh3_128_digest, flat))
        pairs = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        self.n = len(flat)
        lengths = np.array([len(ws) for ws in self.tokens], np.int64)
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        up, self.down = powers(self.n, BASE), powers(self.n, BASE_INVERSE)
        zero = np.zeros(1, np.uint64)
        self.sums = [np.concatenate((zero, np.cumsum(pairs[:, i] * up[:-1]))) for i in (0, 1)]

    def runs(self, first: np.ndarray, last: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words first ... last - 1."""
        s = self.sums[which]
        return (s[last] - s[first]) * self.down[first]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows with their text, grouped in runs of at most GRAM windows of one least gram:
        (text number, first window, windows, least gram)."""
        w, g = self.window, self.gram
        starts = np.arange(max(0, self.n - w + 1))
        text = np.repeat(np.arange(len(self.end)), self.end - self.begin)[: len(starts)]
        grams = np.arange(max(0, self.n - g + 1))
        least = mix(self.runs(grams, grams + g, 0))
        width, left = 1, w - g + 1
        while 2 * width <= left:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if left > width:
            least = np.minimum(least[: width - left], least[left - width :])
        whole = starts + w <= self.end[text]
        starts, text, least = starts[whole], text[whole], least[: self.n - w + 1][whole] if len(starts) else least[:0]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        fresh |= (np.arange(len(starts)) - at[run]) % (w - g + 1) == 0 if len(at) else fresh
        at = np.flatnonzero(fresh)
        count = np.diff(np.append(at, len(starts)))
        return text[at], starts[at], count, least[at]

    def short_periods(self) -> np.ndarray:
        """First words of windows that are equal to another one of their text at most GRAM - 1 apart."""
        w = self.window
        starts = np.arange(max(0, self.n - w + 1))
        text = np.repeat(np.arange(len(self.end)), self.end - self.begin)[: len(starts)]
        whole = starts + w <= self.end[text]
        a, b = (self.runs(starts, starts + w, i) for i in (0, 1))
        found = np.zeros(len(starts), bool)
        for d in range(1, min(w - self.gram + 1, len(starts))):
            same = (a[d:] == a[:-d]) & (b[d:] == b[:-d]) & whole[d:] & (text[d:] == text[:-d])
            found[d:] |= same
            found[:-d] |= same
        return np.flatnonzero(found)


def groups_of(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about WORDS_AT_ONCE words (six bytes each), at least one text each."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > 6 * WORDS_AT_ONCE:
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """Sketch cell of each gram, one array per sketch row."""
    return [
        (mix(grams ^ np.uint64(0xA5A5A5A5 * (r + 1))) >> np.uint64(64 - bits)).astype(np.int64)
        for r in range(SKETCH_ROWS)
    ]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def sketch(docs: DataFrame, bits: int = SKETCH_BITS, **sizes: int) -> np.ndarray:
    """Rows of bits: cell was counted at least twice.  ``docs``: one binary column."""
    slice_bits = min(bits, 20)

    def packed(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        row, piece, once, twice = [], [], [], []
        for r, cell in enumerate(cells(np.concatenate(grams), bits)):
            cell, count = np.unique(cell, return_counts=True)
            cut = np.flatnonzero(np.diff(cell >> slice_bits)) + 1
            for c, k in zip(np.split(cell, cut), np.split(count, cut), strict=True):
                low = (c & ((1 << slice_bits) - 1)).astype(np.uint32)
                row.append(r)
                piece.append(int(c[0] >> slice_bits))
                once.append(low[k == 1].tobytes())
                twice.append(low[k > 1].tobytes())
        columns = [pa.array(row, pa.int32()), pa.array(piece, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "piece", "once", "twice"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            texts = _texts(batch.column(0))
            for part in groups_of(texts):
                held.append(Stream(texts[part], **sizes).spans()[3])
                n += len(held[-1])
                if n >= GRAMS_AT_ONCE:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, counts: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["row", "piece", "bits"])

        key, counts = None, None
        for batch in batches:
            for r, p, once, twice in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (r, p) != key:
                    if key is not None:
                        yield out(key, counts)
                    key, counts = (r, p), np.zeros(1 << slice_bits, np.uint8)
                at = np.frombuffer(once, np.uint32)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(twice, np.uint32)] = 2
        if key is not None:
            yield out(key, counts)

    partial = docs.mapInArrow(count, "row int, piece int, once binary, twice binary")
    dealt = partial.repartition("row", "piece").sortWithinPartitions("row", "piece")
    merged = dealt.mapInArrow(merge, "row int, piece int, bits binary")
    bitmap = np.zeros((SKETCH_ROWS, max(1, (1 << bits) // 8)), np.uint8)
    for found in merged.toLocalIterator():  # fixed size, whatever the corpus
        part = np.frombuffer(found["bits"], np.uint8)
        bitmap[found["row"], found["piece"] * len(part) : (found["piece"] + 1) * len(part)] = part
    return bitmap


def estimated_repeated(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    bits = (bitmap.shape[1] * 8).bit_length() - 1
    out = np.ones(len(grams), bool)
    for row, cell in zip(bitmap, cells(grams, bits), strict=True):
        out &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


SPANS = "key_a bigint, key_b bigint, start int, n int, gram bigint, a bigint, b bigint"


def _as_batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [np.int32 if f.endswith(" int") else np.int64 for f in schema.split(", ")]
    arrays = [
        pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def candidate_spans(docs: DataFrame, bitmap: np.ndarray, **sizes: int) -> DataFrame:
    """Spans whose gram is estimated repeated, and windows of short periods as rows with ``n`` = 1 and
    gram = a = b = 0.  ``docs``: raw, key_a, key_b."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    window = sizes.get("window", WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(0))
            key_a, key_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for part in groups_of(texts):
                s = Stream(texts[part], **sizes)
                text, start, n, gram = s.spans()
                keep = estimated_repeated(shared.value, gram)
                text, start, n, gram = text[keep], start[keep], n[keep], gram[keep]
                a, b = (s.runs(start, start + n + window - 1, i) for i in (0, 1))
                ka, kb = key_a[part], key_b[part]
                yield _as_batch(SPANS, [ka[text], kb[text], start - s.begin[text], n, gram, a, b])
                single = s.short_periods()
                if len(single):
                    text = np.searchsorted(s.end, single, side="right")
                    none = np.zeros(len(single), np.int64)
                    yield _as_batch(SPANS, [ka[text], kb[text], single - s.begin[text], none + 1, none, none, none])

    return docs.mapInArrow(run, SPANS)


WINDOWS = "key_a bigint, key_b bigint, start int, times bigint, a bigint, b bigint"


def single_windows(docs: DataFrame, **sizes: int) -> DataFrame:
    """The windows of the spans that ``docs`` (raw, key_a, key_b, wanted: starts, n, times) asks for."""
    window = sizes.get("window", WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = _texts(batch.column(0)), batch.column(3).to_pylist()
            key_a, key_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for part in groups_of(texts):
                s, spans = Stream(texts[part], **sizes), wanted[part]
                text = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
                first, n, times = (np.array([y[k] for x in spans for y in x], np.int64) for k in ("start", "n", "times"))
                of = np.repeat(np.arange(len(text)), n)
                at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                here = s.begin[text[of]] + at
                a, b = (s.runs(here, here + window, i) for i in (0, 1))
                ka, kb = key_a[part], key_b[part]
                yield _as_batch(WINDOWS, [ka[text[of]], kb[text[of]], at, times[of], a, b])

    return docs.mapInArrow(run, WINDOWS)


def repeated_ranges(docs: DataFrame, store: Store, bits: int = SKETCH_BITS, **sizes: int) -> DataFrame:
    """``key_a, key_b, ranges``: (first window, windows) that also occur elsewhere, in order.

    ``docs``: raw, key_a, key_b."""
    bitmap = sketch(docs.select("raw"), bits, **sizes)
    rows = store.put(candidate_spans(docs, bitmap, **sizes), "candidates")
    local = rows.where("gram = 0 and a = 0 and b = 0").select(*KEYS, "start", "n")
    spans = rows.where("not (gram = 0 and a = 0 and b = 0)")
    one = F.min(F.struct(*KEYS, "start")).alias("one")
    counted = store.put(spans.groupBy("gram", "a", "b", "n").agg(F.count("*").alias("times"), one), "spans")
    twice = counted.where("times > 1").select("gram", "a", "b", "n")
    whole = spans.join(twice, ["gram", "a", "b", "n"]).select(*KEYS, "start", "n")

    # One gram may start a large share of all spans: the grams are broadcast while they are few.
    mixed = counted.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    asked = counted.join(broadcast_checked(store.put(mixed, "mixed")), "gram").select("one.*", "n", "times")
    asked = asked.groupBy(*KEYS).agg(F.collect_set(F.struct("start", "n", "times")).alias("wanted"))
    asked = store.put(asked, "asked")
    texts = docs.join(asked, KEYS)
    windows = store.put(single_windows(texts.select("raw", *KEYS, "wanted"), **sizes), "windows")
    # Equal rows send the same windows twice; each is counted once, with its span's count.
    distinct = windows.distinct()
    again = distinct.groupBy("a", "b").agg(F.sum("times").alias("total")).where("total > 1").select("a", "b")
    edges = distinct.where("times = 1").join(again, ["a", "b"]).select(*KEYS, "start", F.lit(1).alias("n"))
    found = local.unionByName(whole).unionByName(edges)
    ranges = found.groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("ranges"))
    return store.put(ranges, "ranges")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = SKETCH_BITS,
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text``; the kept words joined by
    one space."""
    store = Store(docs.sparkSession, "substrings")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("binary").alias("raw"),
        *row_keys(F.col(id_col), F.col(text_col)),
    )
    ranges = repeated_ranges(keyed.select("raw", *KEYS), store, bits, window=window, gram=gram)
    joined = keyed.join(ranges, KEYS, "left").select("doc_id", "raw", "ranges")
    schema = T.StructType(
        [
            joined.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = (raw or b"").split()
                if spans:
                    change = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(change, [x["start"] for x in spans], 1)
                    np.add.at(change, [x["start"] + x["n"] + window - 1 for x in spans], -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                    left = [tokens[i] for i in stay.tolist()]
                else:
                    left = tokens
                total.append(len(tokens))
                removed.append(len(tokens) - len(left))
                kept.append(b" ".join(left))
            columns = [batch.column(0), pa.array(total), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
