import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from penmark.operators import frequent_terms as op
from penmark.operators.tfidf import by_length, fit_tfidf, term_tokens


def texts(seed, rows, flat=False):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = None if flat else [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(60))) for _ in range(rows)]


def plain(rows, ngram, top, min_df):
    tf, df = Counter(), Counter()
    for text in rows:
        t = (text or "").split()
        grams = [" ".join(t[i : i + n]) for n in range(ngram[0], ngram[1] + 1) for i in range(len(t) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    return sorted(((g, c, df[g]) for g, c in tf.items() if df[g] >= min_df), key=lambda r: (-r[1], r[0]))[:top]


def frame(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string").repartition(5).selectExpr("split(text, ' ') as tokens")


def test_equals_counting_everything(spark):
    rows = texts(1, 500) + ["", "w0 w0 w0 w0 w0", "w1 w1"]
    for ngram, top, min_df, size in [((1, 4), 50, 2, None), ((1, 4), 50, 2, 600), ((2, 3), 40, 3, 800), ((1, 1), 5000, 1, None)]:
        df = frame(spark, [r for r in rows if r])
        n, got = op.most_frequent(df, ngram, top, min_df, 20_000, size)
        assert n == len([r for r in rows if r])
        assert got == plain(rows, ngram, top, min_df)


def test_flat_counts_are_left_to_the_caller(spark):
    df = frame(spark, [r for r in texts(2, 300, flat=True) if r])
    assert op.most_frequent(df, (1, 4), 500, 1, 20_000, 100) is None
    assert op.most_frequent(df, (1, 1), 300, 1, 200) is None


def test_both_ways_agree(spark):
    rows = texts(3, 300) + [None, "", "ties tied", "ties tied"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    for top in (30, 200, 100_000):
        model = fit_tfidf(df, max_features=top)
        tokens = df.select(term_tokens(F.col("text")).alias("tokens"))
        want = sorted(by_length(tokens, (1, 4), top, 2, max(20_000, 4 * top)))
        assert [(t, tf, d) for t, _, tf, d, _ in model.vocabulary] == want
        assert model.n_docs == len(rows)
    empty = fit_tfidf(df.where("doc_id < 0"))
    assert empty.vocabulary == [] and empty.n_docs == 0


def test_summary_bounds():
    rng = np.random.default_rng(5)
    s, true = op.Summary(40), Counter()
    docs = {}
    for step in range(60):
        gram = rng.zipf(1.3, 300).astype(np.int64) % 500
        doc = np.sort(rng.integers(0, 8, 300)) + 8 * step
        s.add(gram, doc)
        true.update(gram.tolist())
        for g, d in zip(gram.tolist(), doc.tolist(), strict=True):
            docs.setdefault(g, set()).add(d)
    s.cut()
    held = dict(zip(s.gram.tolist(), s.n.tolist(), strict=True))
    assert len(held) <= 40 and s.error <= sum(true.values()) / 41
    assert all(held.get(g, 0) <= n <= held.get(g, 0) + s.error for g, n in true.items())
    assert all(d <= len(docs[g]) for g, d in zip(s.gram.tolist(), s.docs.tolist(), strict=True))


def test_exact_count_shuffles_only_counted_terms(spark):
    df = frame(spark, ["a b a"] * 4)
    plan = op.counted(df, (1, 2), np.zeros(1, np.int64))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Generate" not in plan
