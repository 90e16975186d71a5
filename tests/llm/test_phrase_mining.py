import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import ODD, docs_frame

from penmark.llm import phrase_mining as op
from penmark.llm.queries import op11_phrase_mining

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    """Rows of the contract from counters of all phrases of one to four words."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in good.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= 80 * good[lang, p[i : i + size]]:
                    hidden.add((lang, p[i : i + size]))
    out = []
    for (lang, p), a in good.items():
        if (lang, p) not in hidden:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, result = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def corpus(seed=6, n=260):
    rng = random.Random(seed)
    fixed = ["the quick brown fox", "New  York", "in spite of", "a\tb c", "été à Paris", "one-two, three"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(2, 14)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(1, 9))))
        rows.append((i, rng.choice([" ", ". ", "\n", "\r\n", "; "]).join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(1000 + i, "Hot pair always here and there w1 w2", "en") for i in range(200)]


def through_query(spark, path, rows):
    docs_frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    return sorted(tuple(r) for r in op11_phrase_mining(spark, str(path)).collect())


def test_query_equals_plain_version(spark, tmp_path):
    rows = corpus() + [(*r, "en") for r in ODD]
    got = through_query(spark, tmp_path, rows)
    assert got == plain(rows) and len(got) > 40


def test_split_prefixes_small_sketch_and_short_lists(spark):
    """A sketch of 256 cells lets nearly everything through and prefixes over 3 rows are split."""
    rows = corpus(9, 120)
    got = op.mine_phrases(docs_frame(spark, rows), least=5, top=7, bits=8, split_at=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 7)


def test_empty_and_clashing_columns(spark, tmp_path):
    assert through_query(spark, f"{tmp_path}/none", []) == []
    rows = corpus(3, 80)
    clash = docs_frame(spark, rows).selectExpr("*", "1 as raw", "'x' as language", "2 as w1", "3 as n", "4 as phrase")
    assert sorted(map(tuple, op.mine_phrases(clash).collect())) == plain(rows)
    assert op.mine_phrases(docs_frame(spark, [(1, "a b " * 10_000, "en")])).count() == len(plain([(1, "a b " * 10_000, "en")]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 5)), max_size=60), st.integers(1, 12))
def test_equal_partitions_are_prefix_counts(rows, least):
    keys = np.array([r + [0] * (4 - len(r)) for r, _ in rows], np.uint64).reshape(-1, 4).T
    weight = np.array([n for _, n in rows], np.int64)
    want = Counter()
    for r, n in rows:
        for d in range(1, len(r) + 1):
            want[tuple(r[:d])] += n
    depth, at, a = op.equal_partitions(keys, weight, least)
    got = {tuple(keys.T[p, :d].tolist()): n for d, p, n in zip(depth, at, a.tolist(), strict=True)}
    assert got == {k: n for k, n in want.items() if n >= least} and len(got) == len(depth)


def test_lengths(spark):
    with pytest.raises(ValueError):
        op.mine_phrases(docs_frame(spark, []), longest=5)
