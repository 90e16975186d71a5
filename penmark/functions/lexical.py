"""Lexical, readability and n-gram features; one column each, no shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.arrays import array_mean, array_sum, count_runs, let, ngrams, ratio, round2
from penmark.functions.tokens import MARKS_RE, WORDS_RE, extract

# Fixed value: the ASCII punctuation characters, in code order.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def lexical_richness(alpha: Column) -> Column:
    return ratio(F.size(F.array_distinct(alpha)), F.size(alpha))


def mean_word_length(alpha: Column) -> Column:
    return ratio(F.length(F.array_join(alpha, "")), F.size(alpha))


def stopword_ratio(marks: Column, alpha: Column, stop: Sequence[str]) -> Column:
    return ratio(F.size(F.filter(marks, lambda t: t.isin(list(stop)))), F.size(alpha))


def mean_sentence_words(sentences: Column) -> Column:
    """Mean number of white-space words per sentence."""
    return array_mean(sentences, lambda s: F.size(extract(s, WORDS_RE)))


def ngram_diversity(terms: Column, alpha: Column) -> Column:
    """Distinct bigrams and trigrams per letter-only word (terms hold no blanks, so the two
    sets cannot overlap)."""
    distinct = F.size(F.array_distinct(ngrams(terms, 2))) + F.size(F.array_distinct(ngrams(terms, 3)))
    return ratio(distinct, F.size(alpha))


def sentence_lengths(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.size(extract(s, MARKS_RE)))


def avg_word_length(marks: Column) -> Column:
    """Mean length of the tokens that do not occur inside the ASCII punctuation string."""
    return let(
        F.filter(marks, lambda t: ~F.contains(F.lit(ASCII_PUNCTUATION), t)),
        lambda kept: ratio(F.length(F.array_join(kept, "")), F.size(kept)),
    )


# White space beyond ASCII (as in ``WS``) by its UTF-8 bytes, and the kinds of ASCII bytes.
WIDE_SPACES = [chr(x).encode() for x in range(0x80, 0x10000) if x == 0x85 or unicodedata.category(chr(x))[0] == "Z"]
SPACE, MARK, VOWEL = 1, 2, 4
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(9, 14), *range(0x1C, 0x21)]] = SPACE
KINDS[list(b".!?")] = MARK
KINDS[list(b"aeiouy")] = VOWEL
# Bytes of text that are counted together; a longer text is counted by itself.
BYTES = 1 << 22


def _spaces(text: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    found = kinds == SPACE
    for lead in {w[0] for w in WIDE_SPACES}:
        at = np.flatnonzero(text == lead)
        for wide in [w for w in WIDE_SPACES if w[0] == lead] if len(at) else []:
            own = at
            for i, byte in enumerate(wide[1:], 1):
                own = own[text.take(own + i, mode="clip") == byte]
            for i in range(len(wide)):
                found[own + i] = True
    return found


def _counted(text: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sentences, words and syllables of the lower-cased texts that lie side by side in ``text``."""
    if not len(text):
        return [np.zeros(len(offsets) - 1, np.int32) for _ in range(3)]
    first, last = (np.zeros(len(text), bool) for _ in range(2))
    begun = offsets[:-1][np.diff(offsets) > 0]
    first[begun], last[np.r_[begun[1:], len(text)] - 1] = True, True

    def before(kind: np.ndarray) -> np.ndarray:
        return np.r_[False, kind[:-1]] & ~first

    kinds = KINDS[text]
    space, mark, vowel = _spaces(text, kinds), kinds == MARK, kinds == VOWEL
    inside = ~space
    good = inside & ~mark
    words = np.flatnonzero(good & ~before(good))
    piece = np.searchsorted(np.flatnonzero(mark | first), words, "right")
    sentences = words[np.r_[True, piece[1:] != piece[:-1]]] if len(words) else words

    groups = np.flatnonzero(vowel & ~before(vowel))
    starts = np.flatnonzero(inside & ~before(inside))
    ends = np.flatnonzero(inside & (np.r_[space[1:], True] | last))
    ends_silent = (text[ends] == ord("e")) & before(inside & ~vowel & (text != ord("l")))[ends]
    at = np.flatnonzero(vowel)
    vowels = np.searchsorted(at, ends, "right") - np.searchsorted(at, starts)
    bare = starts[(vowels == 0) | ((vowels == 1) & ends_silent)]

    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, offsets)).astype(np.int32)

    return [per_text(sentences), per_text(words), per_text(groups) - per_text(ends[ends_silent]) + per_text(bare)]


def _readable(low: pa.Array) -> pa.Array:
    low = low.cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, low.offset * 8) if len(low) else np.zeros(1, np.int64)
    parts, a = [], 0
    while a < len(low):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BYTES, "right")) - 1)
        size = int(offsets[z] - offsets[a])
        text = np.frombuffer(low.buffers()[2], np.uint8, size, int(offsets[a])) if size else np.zeros(0, np.uint8)
        parts.append(_counted(text, offsets[a : z + 1] - offsets[a]))
        a = z
    counts = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int32)] * 3
    return pa.StructArray.from_arrays([pa.array(x) for x in counts], names=["sentences", "words", "syllables"], mask=low.is_null())


def readability_counts(text: Column) -> Column:
    """``struct<sentences, words, syllables>``, counted over the bytes of Arrow batches.

    Sentences are the non-blank pieces between runs of ``. ! ?``; words are counted inside them, so
    ``a.b`` holds two.  Syllables are those of the white-space words: per word its vowel groups, less a
    silent final e, and at least one.  Vowel groups never cross white space, so they are all groups,
    minus the silent final e's, plus one for each word left with none (words without a vowel, and words
    whose only vowel is a silent e)."""
    return F.arrow_udf(_readable, "struct<sentences:int,words:int,syllables:int>")(F.lower(text))


def syllables(text: Column) -> Column:
    return readability_counts(text)["syllables"]


def flesch_score(n: Column) -> Column:
    """Reading ease from ``readability_counts``; null when the text has no sentence."""
    score = (
        F.lit(206.835)
        - F.lit(1.015) * (n["words"] / n["sentences"])
        - F.lit(84.6) * (n["syllables"] / n["words"])
    )
    return F.when(n["sentences"] > 0, round2(score))


def flesch(text: Column) -> Column:
    return flesch_score(readability_counts(text))


def lexical_entropy(words_lower: Column) -> Column:
    """Shannon entropy in bits of the lower-cased white-space words."""

    def bits(runs: Column) -> Column:
        n = array_sum(runs, lambda r: r["n"])
        weighted = array_sum(runs, lambda r: r["n"] * F.log2(r["n"].cast("double")))
        return F.when(n > 0, F.log2(n) - weighted / n).otherwise(F.lit(0.0))

    return round2(let(count_runs(words_lower), bits))


def unusual_word_ratio(words_lower: Column, common: Sequence[str]) -> Column:
    """Share of distinct words outside ``common``, for a list short enough to be a literal.
    For a word table of any size use ``operators.joins.unusual_words``."""
    return let(
        F.array_distinct(words_lower),
        lambda w: round2(ratio(F.size(F.filter(w, lambda x: ~x.isin(list(common)))), F.size(w))),
    )
