import random
from collections import Counter

import numpy as np
import pytest
from llm.helpers import ODD, docs_frame, sentence
from penmark.llm import substring_dedup as op


def plain(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for (i, _), ws in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()
        out.append((i, len(ws), len(gone), kept))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, op.remove_repeats(df, **kw).collect()), key=str)


def corpus(seed, n=150, vocabulary=3000):
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randrange(8, 60), vocabulary) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [sentence(rng, rng.randrange(1, 40), vocabulary)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), sentence(rng, rng.randrange(12), vocabulary)]
        rows.append((i, "\n ".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, "z " * 300 + "end"), (n + 2, " ".join("abc" * 30)), (n + 3, "a b c d e f g h " * 20)]


@pytest.mark.parametrize("bits", [6, 16])
def test_equals_brute_force(spark, bits):
    """Six bits: the sketch overestimates nearly everything; the result is the same."""
    rows = corpus(3) + ODD
    assert run(docs_frame(spark, rows), bits=bits, window=12, gram=6) == plain(rows, 12)


def test_production_window_and_few_words(spark):
    rows = corpus(5, 60, vocabulary=4)
    assert run(docs_frame(spark, rows), bits=16) == plain(rows, 35)


def test_empty_table_and_extra_columns(spark):
    assert run(docs_frame(spark, []), bits=10) == []
    clash = docs_frame(spark, ODD).selectExpr("*", "1 as raw", "2 as ranges", "3 as start", "4 as n_words")
    assert run(clash, bits=10) == plain(ODD, 35)


def test_sketch_never_underestimates(spark):
    rows = corpus(7, 80)
    df = docs_frame(spark, rows).selectExpr("cast(text as binary) as raw").repartition(5)
    bitmap = op.sketch(df, 10, window=12, gram=6)
    grams = np.concatenate([op.Stream([t.encode()], 12, 6).spans()[3] for _, t in rows])
    values, counts = np.unique(grams, return_counts=True)
    assert op.estimated_repeated(bitmap, values)[counts > 1].all()


def test_spans_hold_every_window_once():
    rng = random.Random(1)
    texts = [sentence(rng, n, 5).encode() for n in (0, 3, 11, 12, 13, 200)]
    text, start, n, _ = op.Stream(texts, 12, 6).spans()
    got = sorted((int(t), int(s) + k) for t, s, m in zip(text, start, n, strict=True) for k in range(m))
    begin = op.Stream(texts, 12, 6).begin
    assert got == [(t, int(begin[t]) + k) for t, x in enumerate(texts) for k in range(max(0, len(x.split()) - 11))]
    assert n.max() <= 7
