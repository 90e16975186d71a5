import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import ODD, WORD, docs_frame, sentence

from penmark.llm import elias_fano as ef
from penmark.llm import ngram_score as op
from penmark.llm.queries import op12_ngram_score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
M2, M3 = op.WEIGHT_2, op.WEIGHT_3


def code(p):
    """A probability as its one-byte code gives it back."""
    return float(ef.VALUES[ef.quantise(np.array([p]))[0]])


def model(rows):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    texts = [["<s>", *WORD.findall((r[1] or "").translate(LOWER)), ("end",)] for r in rows]
    one, two, three = Counter(), Counter(), Counter()
    for out, t in zip(held, texts, strict=True):
        if not out:
            one.update(t)
            two.update(zip(t, t[1:], strict=False))
            three.update(zip(t, t[1:], t[2:], strict=False))
    starts = one.pop("<s>", 0)
    return held, texts, one, two, three, starts


def plain(rows):
    held, texts, one, two, three, starts = model(rows)
    n, v = sum(one.values()), len(one)
    out = []
    for r, h, t in zip(rows, held, texts, strict=True):
        base = score = 0.0
        for i in range(1, len(t)):
            p1 = (one[t[i]] + 1) / (n + v + 1)
            before = starts if i == 1 else one[t[i - 1]]
            pair = two[t[i - 1], t[i]]
            p = (code(pair / (before + M2)) if pair else 0) + M2 / (before + M2) * p1
            if i > 1:
                around, triple = two[t[i - 2], t[i - 1]], three[t[i - 2], t[i - 1], t[i]]
                p = (code(triple / (around + M3)) if triple else 0) + (code(M3 / (around + M3)) if around else 1) * p
            base += math.log10(p1)
            score += min(0.0, math.log10(p))
        out.append((r[0], h, len(t) - 1, sum(one[w] > 0 for w in t[1:]), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[:5]), round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-10, atol=1e-9)


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"{rng.choice('Ww')}{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    rows += [(500 + i, "of the hot pair of the " + sentence(rng, 3, 50) + " OF the " * 6) for i in range(80)]
    return rows + [(900 + i, "ünïcode wörds.\tÉté 東京  x") for i in range(9)]


def test_query_equals_plain_version(spark, tmp_path):
    rows = corpus() + ODD
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    same([tuple(r) for r in op12_ngram_score(spark, str(tmp_path)).collect()], plain(rows))


def test_many_chunks_and_buckets_with_hot_words_and_pairs(spark, monkeypatch):
    """Buckets of 40 tokens: every frequent word is dealt by pairs, and such pairs by their third words."""
    rows = corpus(7)
    monkeypatch.setattr(op, "BYTES_AT_ONCE", 3000)
    asked = op.hot_pairs
    hot = []
    monkeypatch.setattr(op, "hot_pairs", lambda *a: hot.append(asked(*a)) or hot[-1])
    got = op.score_documents(docs_frame(spark, rows).repartition(3), tokens_per_bucket=40)
    same([tuple(r) for r in got.collect()], plain(rows))
    assert len(hot[0]) > 2


def test_chunking_in_this_process(monkeypatch):
    lengths, index, words = op.distinct_words([b"  A b\na ", b"", b" \t", b"c"])
    assert lengths.tolist() == [3, 0, 0, 1] and [words[i] for i in index] == [b"a", b"b", b"a", b"c"]
    assert op.distinct_words([b"", b" "])[2] == []


def test_no_training_rows_empty_table_and_clashing_columns(spark):
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a b c") for i in out]
    same([tuple(r) for r in op.score_documents(docs_frame(spark, rows)).collect()], [(i, True, 4, 0, 0, 0.0, 0.0) for i in out])
    assert op.score_documents(docs_frame(spark, [])).collect() == []
    rows = corpus(5, 30)
    clash = docs_frame(spark, rows).selectExpr("*", "1 as raw", "2 as chunk", "3 as held_out", "4 as tokens")
    same([tuple(r) for r in op.score_documents(clash).collect()], plain(rows))


def test_model_beats_the_base_on_held_out_text(spark):
    rng, rows = random.Random(11), []
    for i in range(600):
        w = [rng.randrange(200)]
        for _ in range(60):
            w.append((7 * w[-1] + rng.randrange(3)) % 200)
        rows.append((i, " ".join(f"w{x}" for x in w)))
    got = [r for r in op.score_documents(docs_frame(spark, rows)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_probabilities_sum_to_at_most_one():
    """Over all words after a context, from the counts of a small text; the loss is that of rounding down."""
    rows = [r for r in corpus(3, 60) if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    _, _, one, two, three, starts = model(rows)
    n, v = sum(one.values()), len(one)
    for u, w in random.Random(1).sample(sorted((k for k in two if k[1] != ("end",)), key=str), 25):
        total = 0.0
        for x in [*one, None]:
            p1 = (one[x] + 1) / (n + v + 1)
            p = (code(two[w, x] / (one[w] + M2)) if two[w, x] else 0) + M2 / (one[w] + M2) * p1
            total += (code(three[u, w, x] / (two[u, w] + M3)) if three[u, w, x] else 0) + code(M3 / (two[u, w] + M3)) * p
        assert 0.85 < total <= 1 + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 10**12), max_size=300), st.lists(st.integers(0, 10**12), max_size=50))
def test_sequence_select_and_successor(values, asked):
    v = np.array(sorted(values), np.uint64)
    s = ef.Sequence(v)
    assert np.array_equal(s.get(np.arange(len(v))), v)
    x = np.array([*asked, *sorted(values)[:50]], np.uint64)
    place, equal = s.find(x)
    assert np.array_equal(place, np.searchsorted(v, x)) and np.array_equal(equal, np.isin(x, v))


@pytest.mark.parametrize("bits", [3, 20, 32])
def test_trie_finds_exactly_its_ngrams(bits):
    rng = np.random.default_rng(bits)
    u, v, w = (rng.integers(0, min(1 << bits, (1 << 32) - 1), 4000) for _ in range(3))
    u %= 40
    pair = np.unique(u << 32 | v)
    roots, root_of = np.unique(pair >> 32, return_inverse=True)
    below = np.searchsorted(pair, u << 32 | v)
    triple = np.unique(np.stack([below, w], axis=1), axis=0)
    codes = (np.arange(len(pair)) % 200).astype(np.uint8)
    trie = ef.Trie(roots, root_of, pair & 0xFFFFFFFF, codes, codes, triple[:, 0], triple[:, 1], (np.arange(len(triple)) % 200).astype(np.uint8))
    node, known = trie.pairs(pair >> 32, pair & 0xFFFFFFFF)
    assert known.all() and np.array_equal(node, np.arange(len(pair)))
    node, known = trie.triples(triple[:, 0], triple[:, 1])
    assert known.all() and np.array_equal(node, np.arange(len(triple)))
    other = rng.integers(0, 1 << bits, 4000)
    _, known = trie.triples(triple[rng.integers(0, len(triple), 4000), 0], other)
    inside = set(map(tuple, triple.tolist()))
    asked = triple[np.random.default_rng(bits).integers(0, len(triple), 4000), 0]
    _, known = trie.triples(asked, other)
    assert known.tolist() == [(a, b) in inside for a, b in zip(asked.tolist(), other.tolist(), strict=True)]
