"""Rule-based token annotation: part of speech and a dependency proxy.

Rules in order: number, punctuation or symbol, closed-class word, frequent open-class word,
capital letter inside a sentence, suffix, else noun.  It is meant for English and it is an
approximation; pass your own tagger to ``operators.annotate`` for anything finer.  Sentences and
tokens are cut by Spark; the rules then run in Arrow batches, once per different token of a batch, and
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.arrays import ratio, round2
from penmark.functions.lexicon import ADJ_SUFFIXES, CLOSED_CLASS, COMMON_OPEN, VERB_SUFFIXES
from penmark.functions.tokens import IS_PUNCT_RE, MARKS_RE, WORD, extract

NUMBER_RE = r"^\p{N}+$"
LETTER_START_RE = r"^\p{L}"
WORD_START_RE = rf"^[{WORD}]"
CAPITAL_RE = r"^\p{Lu}"
# The tags that the rules can give.
TAGS = sorted({*CLOSED_CLASS, *COMMON_OPEN, "PROPN", "ADV", "VERB", "ADJ", "NOUN", "NUM", "PUNCT", "SYM"})
RELATIVES = ["who", "which", "whose"]
CLAUSE_DEPS = ["acl", "advcl", "ccomp"]
# The labels of the rules: tags in lower case, then the clauses.
DEPS = [t.lower() for t in TAGS] + CLAUSE_DEPS
# Tokens that are tagged together.
TOKENS = 1 << 18


def dependency(low: Column, pos: Column, previous_pos: Column) -> Column:
    return (
        F.when((low == "that") & (previous_pos == "VERB"), F.lit("ccomp"))
        .when(pos == "SCONJ", F.lit("advcl"))
        .when(low.isin(RELATIVES), F.lit("acl"))
        .otherwise(F.lower(pos))
    )


def sentence_marks(sentences: Column) -> Column:
    """``array<array<string>>``: the tokens of every sentence."""
    return F.transform(sentences, lambda s: extract(s, MARKS_RE))


def _word_tags(words: pa.Array, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tag numbers of different tokens: at the start of a sentence, and elsewhere."""

    def matches(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)

    def ends(suffixes: Sequence[str]) -> np.ndarray:
        """At least one letter and then one of the suffixes."""
        length, found = pc.utf8_length(low).to_numpy(zero_copy_only=False), np.zeros(len(low), bool)
        for suffix in suffixes:
            found |= pc.ends_with(low, suffix).to_numpy(zero_copy_only=False) & (length > len(suffix))
        return found

    number = {tag: i for i, tag in enumerate(TAGS)}
    classes = {**CLOSED_CLASS, **COMMON_OPEN}
    of_word = {w: number[tag] for tag in reversed(list(classes)) for w in classes[tag]}
    listed = np.array([of_word.get(w, -1) for w in low.to_pylist()], np.int64)
    letter, capital = matches(LETTER_START_RE), matches(CAPITAL_RE)
    kinds = [~letter & matches(NUMBER_RE), ~letter & matches(IS_PUNCT_RE), ~letter & ~matches(WORD_START_RE), listed >= 0]
    endings = [ends(["ly"]), ends(VERB_SUFFIXES), ends(ADJ_SUFFIXES)]
    before, after = [number["NUM"], number["PUNCT"], number["SYM"], listed], [number[t] for t in ("ADV", "VERB", "ADJ")]
    first = np.select([*kinds, *endings], [*before, *after], number["NOUN"])
    return first, np.select([*kinds, capital, *endings], [*before, number["PROPN"], *after], number["NOUN"])


@dataclass
class TaggedTokens:
    """The tokens of some rows, flat.  ``code`` numbers the different ``words``, ``dep`` the ``DEPS``."""

    row: np.ndarray
    sent_id: np.ndarray
    tok_id: np.ndarray
    code: np.ndarray
    words: pa.Array
    low: pa.Array
    pos: np.ndarray
    dep: np.ndarray


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each group."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def tag_tokens(marks: pa.Array) -> TaggedTokens:
    """Rules over a column of ``sentence_marks``; they run once per different token."""
    n_sentences = pc.list_value_length(marks).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sentences = marks.flatten()
    lengths = pc.list_value_length(sentences).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = sentences.flatten().cast(pa.string()).dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    low = pa.array([w.lower() for w in words.to_pylist()], pa.string())
    tok_id = _within(lengths)
    at_first, elsewhere = _word_tags(words, low)
    pos = np.where(tok_id == 0, at_first[code], elsewhere[code])
    before = np.where(tok_id > 0, np.roll(pos, 1), -1)
    that, relative = (pc.is_in(low, pa.array(w)).to_numpy(zero_copy_only=False)[code] for w in (["that"], RELATIVES))
    clauses = [that & (before == TAGS.index("VERB")), pos == TAGS.index("SCONJ"), relative]
    dep = pos.copy()
    for found, name in reversed(list(zip(clauses, ("ccomp", "advcl", "acl"), strict=True))):
        dep[found] = DEPS.index(name)
    row, sent_id = np.repeat(np.arange(len(marks)), n_sentences), _within(n_sentences)
    return TaggedTokens(np.repeat(row, lengths), np.repeat(sent_id, lengths), tok_id, code, words, low, pos, dep)


def token_slices(marks: pa.Array) -> Iterator[pa.Array]:
    """The column in parts of about ``TOKENS`` tokens; a longer row is a part of its own."""
    n_sentences = pc.list_value_length(marks).fill_null(0).to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(marks.flatten()).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(lengths)][np.cumsum(n_sentences)]
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
        yield marks.slice(a, z - a)
        a = z


def _runs(row: np.ndarray, value: np.ndarray, names: pa.Array, rows: int) -> pa.Array:
    """Per row the different values, in the order of their numbers, with their counts."""
    keys, width = row * max(1, len(names)) + value, max(1, len(names))
    if rows * width <= 4 * len(keys):  # few cells: counted without a sort
        n = np.bincount(keys, minlength=rows * width)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys, n = np.unique(keys, return_counts=True)
    row, value = np.divmod(keys, width)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32)
    entries = pa.StructArray.from_arrays([names.take(pa.array(value)), pa.array(n.astype(np.int32))], ["value", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _counts(marks: pa.Array) -> pa.Array:
    t, rows = tag_tokens(marks), len(marks)
    deps = np.bincount(t.row * len(DEPS) + t.dep, minlength=rows * len(DEPS)).reshape(rows, -1)
    # Only punctuation marks are counted by themselves, so only these are put in order.
    punct = np.flatnonzero(t.pos == TAGS.index("PUNCT"))
    marked = np.unique(t.code[punct])
    words = t.words.take(pa.array(marked)).to_pylist()
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    rank = np.zeros(len(t.words), np.int64)
    rank[marked[order]] = np.arange(len(words))
    arrays = [
        _runs(t.row, t.pos, pa.array(TAGS), rows),
        _runs(t.row[punct], rank[t.code[punct]], pa.array([words[i] for i in order], pa.string()), rows),
        pa.array(deps[:, [DEPS.index(d) for d in CLAUSE_DEPS]].sum(axis=1).astype(np.int32)),
        pa.array(deps.max(axis=1).astype(np.int32)),
        pa.array(deps.sum(axis=1).astype(np.int32)),
    ]
    return pa.StructArray.from_arrays(arrays, names=["pos", "punct", "clauses", "top_dep", "n"], mask=marks.is_null())


def annotation_counts(sentences: Column) -> Column:
    """Counts of the annotated tokens of a row: ``struct<pos, punct, clauses, top_dep, n>``, the first two
    arrays of ``(value, n)`` sorted by value; ``top_dep`` is the count of the most frequent label."""

    def run(marks: pa.Array) -> pa.Array:
        parts = [_counts(part) for part in token_slices(marks)]
        return pa.concat_arrays(parts) if parts else _counts(marks)

    runs = "array<struct<value:string,n:int>>"
    counted = F.arrow_udf(run, f"struct<pos:{runs},punct:{runs},clauses:int,top_dep:int,n:int>")
    return counted(sentence_marks(sentences))


def _shares(runs: Column, prefix: str, denominator: Column) -> Column:
    """``map<prefix + value, count / denominator>``; empty when the denominator is 0, and a
    value that does not occur has no key (null, not 0)."""
    return F.when(
        denominator > 0,
        F.map_from_entries(
            F.transform(runs, lambda r: F.struct(F.concat(F.lit(prefix), r["value"]), ratio(r["n"], denominator)))
        ),
    ).otherwise(F.create_map().cast("map<string,double>"))


def pos_shares(counts: Column, num_alpha: Column) -> Column:
    return _shares(counts["pos"], "prop_", num_alpha)


def punct_shares(counts: Column, num_alpha: Column) -> Column:
    return _shares(counts["punct"], "punct_", num_alpha)


def syntactic_complexity(counts: Column, num_sentences: Column) -> Column:
    return ratio(counts["clauses"], num_sentences)


def dep_repetition(counts: Column) -> Column:
    """Share of the most frequent dependency label; 0 without tokens."""
    return round2(ratio(counts["top_dep"], counts["n"]))
