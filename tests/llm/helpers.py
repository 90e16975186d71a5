"""Plain Python versions and small tables for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def docs_frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "s0"][len(r) - 2 :]), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def sentence(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Nulls, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (None, "one two three"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (4, "word"),
    (5, "same text here for two rows"),
    (6, "same text here for two rows"),
    (7, "long " * 30_000),
    (8, None),
]
