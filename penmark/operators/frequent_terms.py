"""The most frequent word n-grams of a corpus, exactly, in two scans of the text.

1. Every task keeps a summary of bounded size (Misra-Gries): counts of n-gram hashes, from which the
   count at the cut is subtracted whenever the summary is full.  What was subtracted is the task's
   error: no count is too low by more.  Summaries are added up by hash.
2. The ``top``-th largest lower bound is a floor of the wanted counts.  Only n-grams whose lower bound
   and all errors together reach it can belong to the result; these are counted exactly.

The result is checked against the floor, so a hash that two n-grams share cannot change it.  On flat
counts, or with very many ties, the summaries cannot separate and ``None`` is returned: the caller
counts in another way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.physical import collect_top
from penmark.session import materialize

# A summary keeps this many n-grams per wanted one, at least KEEP_LEAST.
KEEP_PER_TERM = 16
KEEP_LEAST = 1 << 16
# Tokens that are numbered and sorted together.
TOKENS = 1 << 18
SUMMARY = "kind int, gram bigint, n bigint, docs bigint"


def gram_hashes(tokens: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie inside one document, and where they start."""
    if len(tokens) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    mixed = np.full(len(at), n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ tokens[at + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64), at


def slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``TOKENS`` elements; a longer row is a range of its own."""
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
        yield a, z
        a = z


def flat_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lengths)), lengths)


class Summary:
    """Lower bounds of counts and of document counts for at most ``2 * size`` hashes."""

    def __init__(self, size: int):
        self.size, self.error = size, 0
        self.gram, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, gram: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        new = np.r_[True, gram[1:] != gram[:-1]] if len(gram) else np.zeros(0, bool)
        other = new | np.r_[True, doc[1:] != doc[:-1]] if len(gram) else new
        heads = np.flatnonzero(new)
        if len(heads):
            n, docs = np.diff(np.r_[heads, len(gram)]), np.add.reduceat(other.astype(np.int64), heads)
            self._merge(gram[heads], n, docs)

    def _merge(self, gram: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        both = np.r_[self.gram, gram]
        order = np.argsort(both, kind="stable")
        both = both[order]
        heads = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        self.gram = both[heads]
        self.n = np.add.reduceat(np.r_[self.n, n][order], heads)
        self.docs = np.add.reduceat(np.r_[self.docs, docs][order], heads)
        if len(self.gram) > 2 * self.size:
            self.cut()

    def cut(self) -> None:
        """Down to ``size`` hashes at most."""
        if len(self.gram) > self.size:
            level = int(np.partition(self.n, -self.size - 1)[-self.size - 1])
            stay = self.n > level
            self.gram, self.n, self.docs = self.gram[stay], self.n[stay] - level, self.docs[stay]
            self.error += level


def summaries(tokens: DataFrame, ngram: tuple[int, int], size: int) -> DataFrame:
    """``kind, gram, n, docs``: kind 0 one row per kept hash, kind 1 error and documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = Summary(size), 0
        for batch in batches:
            rows += batch.num_rows
            for a, z in slices(batch.column(0)):
                flat, doc = flat_lists(batch.column(0).slice(a, z - a))
                hashed = flat.to_numpy(zero_copy_only=False)
                for n in range(ngram[0], ngram[1] + 1):
                    gram, at = gram_hashes(hashed, doc, n)
                    held.add(gram, doc[at])
        held.cut()
        kind, last = np.zeros(len(held.gram) + 1, np.int32), len(held.gram)
        kind[last] = 1
        columns = [kind, np.r_[held.gram, 0], np.r_[held.n, held.error], np.r_[held.docs, rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "gram", "n", "docs"])

    return tokens.select(F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")).mapInArrow(run, SUMMARY)


def counted(tokens: DataFrame, ngram: tuple[int, int], grams: np.ndarray) -> DataFrame:
    """``term, tf, df`` of the n-grams with one of the (sorted) hashes ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf: Counter[str] = Counter()
            df: Counter[str] = Counter()
            for a, z in slices(batch.column(0)):
                part = batch.slice(a, z - a)
                words, doc = flat_lists(part.column(0))
                hashed = part.column(1).flatten().to_numpy(zero_copy_only=False)
                seen: set[tuple[int, str]] = set()
                for n in range(ngram[0], ngram[1] + 1):
                    gram, at = gram_hashes(hashed, doc, n)
                    at = at[grams[np.minimum(np.searchsorted(grams, gram), len(grams) - 1)] == gram]
                    pieces = [words.take(pa.array(at + k)) for k in range(n)]
                    found = pc.binary_join_element_wise(*pieces, " ").to_pylist()
                    tf.update(found)
                    seen.update(zip(doc[at].tolist(), found, strict=True))
                df.update(t for _, t in seen)
            terms = list(tf)
            columns = [terms, [tf[t] for t in terms], [df[t] for t in terms]]
            kinds = [pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "tf", "df"])

    sent = tokens.select("tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    found = sent.mapInArrow(run, "term string, tf bigint, df bigint")
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def most_frequent(
    tokens: DataFrame, ngram: tuple[int, int], top: int, min_df: int, limit: int, size: int | None = None
) -> tuple[int, list[tuple[str, int, int]]] | None:
    """Number of rows, and ``(term, tf, df)`` of the ``top`` n-grams with the largest ``tf`` among those in
    ``min_df`` rows or more; equal counts by term.  ``tokens``: one array ``tokens`` per row.

    ``None`` when more than ``limit`` n-grams would have to be counted."""
    size = max(KEEP_LEAST, KEEP_PER_TERM * top) if size is None else size
    kept = materialize(summaries(tokens, ngram, size))
    total = kept.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    error, rows = int(total[0]), int(total[1])
    merged = materialize(
        kept.where("kind = 0").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    # Without an error all counts are exact and the rare ones can be left out at once.
    sure = merged.where(F.col("docs") >= min_df)
    best = collect_top(sure, "n", [F.asc("gram")], top)
    floor = best[-1]["n"] if len(best) == top else 0
    if error and error >= floor:
        return None
    open_ = (merged if error else sure).where(F.col("n") + error >= floor).select("gram").limit(limit + 1)
    grams = np.array(sorted(r["gram"] for r in open_.collect()), np.int64)
    if len(grams) > limit:
        return None
    if not len(grams):
        return rows, []
    found = [tuple(r) for r in counted(tokens, ngram, grams).where(F.col("df") >= min_df).collect()]
    found = sorted(found, key=lambda r: (-r[1], r[0]))[:top]
    if floor and (len(found) < top or found[-1][1] < floor):
        return None
    return rows, found
