"""The four token streams, and sentences.

=====  =======================================================  =======================
name   what                                                     used by
=====  =======================================================  =======================
words  maximal runs without white space                         entropy, readability
alpha  lower-cased tokens made of letters only                  richness, denominators
marks  lower-cased words and single punctuation marks           counts, annotation
terms  lower-cased words of two or more word characters         n-grams, TF-IDF
=====  =======================================================  =======================

Patterns use Unicode classes only, so they behave alike in Java regexes and in RE2.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.functions.arrays import ratio

WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
WORDS_RE = rf"[^{WS}]+"
MARKS_RE = rf"[{WORD}]+|[^{WS}{WORD}]"
TERMS_RE = rf"[{WORD}]{{2,}}"
ALPHA_RE = rf"(?<![{WORD}])\p{{L}}+(?![{WORD}])"
# A sentence is a run of text up to and including its closing marks; the last may lack them.
SENTENCE_RE = r"[^.!?]*[.!?]+|[^.!?]+"
IS_ALPHA_RE = r"^\p{L}+$"
IS_PUNCT_RE = r"^\p{P}+$"
NOT_BLANK_RE = rf"[^{WS}]"


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return extract(text, WORDS_RE)


def alpha(text: Column) -> Column:
    return extract(F.lower(text), ALPHA_RE)


def marks(text: Column) -> Column:
    return extract(F.lower(text), MARKS_RE)


def terms(text: Column) -> Column:
    return extract(F.lower(text), TERMS_RE)


def sentences(text: Column) -> Column:
    return F.filter(extract(text, SENTENCE_RE), lambda s: s.rlike(NOT_BLANK_RE))


def ngram_density(num_tokens: Column, n: int) -> Column:
    """Share of positions that start an n-gram: ``(tokens - n + 1) / tokens``, never below 0."""
    return ratio(F.greatest(num_tokens - (n - 1), F.lit(0)), num_tokens)


def _base_letters() -> tuple[str, str]:
    """Every letter that is one base letter with marks, by Unicode decomposition, and its base."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        parts = [p for p in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(p)]
        if len(parts) == 1 and parts[0] != chr(code) and parts[0].isalpha() and chr(code).isalpha():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _base_letters()
# The Latin ligatures that decompose into several letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "ŉ": "ʼn"}
MARKS_ONLY_RE = r"\p{Mn}+"


def strip_accents(lowered: Column) -> Column:
    """Base letters: precomposed letters and ligatures decomposed, other nonspacing marks removed."""
    plain = F.translate(lowered, ACCENTED, UNACCENTED)
    for ligature, letters in LIGATURES.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return F.regexp_replace(plain, MARKS_ONLY_RE, "")
