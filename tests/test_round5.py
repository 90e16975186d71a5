"""Findings of the fifth round."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from penmark import physical
from penmark.operators import keyed_values as KV
from penmark.operators import svd
from penmark.operators.linear import SQUARED_HINGE, Fit, fit_many, pack_rows
from penmark.operators.ngram_lm import fit_ngram_lm, score_documents


def test_squared_hinge_ends_on_separable_rows(spark):
    # More columns than rows: a trust region took 186 passes here, and on blocks of text never ended.
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 80)) * draw.lognormal(0, 1, 80)
    label = (draw.random(60) < 0.8).astype(int)
    rows = spark.createDataFrame(list(zip(x.tolist(), label.tolist(), strict=True)), "features array<double>, label int")
    model = fit_many(pack_rows(rows), {"svm": Fit(SQUARED_HINGE)})["svm"]
    assert model.passes <= 40 and model.residual < 1e-8
    w, y = np.append(model.coefficients, model.intercept), 2.0 * label - 1
    wide = np.column_stack([x, np.ones(60)])
    gradient = wide.T @ (-2 * y * np.maximum(0, 1 - y * (wide @ w))) / 60 + w / 60
    assert np.abs(gradient).max() < 1e-8


TEXTS = [(1, "the cat sat on the mat"), (2, "the dog sat on the cat"), (3, "a cat and a dog"), (3, "the mat"), (None, "a dog sat"), (4, "cat"), (5, None)]


@pytest.mark.parametrize("near", [0, 1_000_000])
def test_all_words_are_scored_without_joining_bigrams(spark, monkeypatch, near):
    # near=0: no word table may be broadcast whole, and the frequent words are but a few.
    monkeypatch.setattr(physical, "MAX_BROADCAST_ROWS", near)
    monkeypatch.setattr("penmark.operators.ngram_lm.NEAR_WORDS", near or 1_000)
    monkeypatch.setattr("penmark.operators.ngram_lm.HOT_PAIRS", 3)
    monkeypatch.setattr("penmark.operators.ngram_lm.HOT_WORDS", 3)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    tok = [re.findall(r"\w+", t or "") for _, t in TEXTS]
    uni, big = Counter(w for t in tok for w in t), Counter(p for t in tok for p in zip(t, t[1:]))
    ctx, n = Counter(u for t in tok for u in t[:-1]), sum(uni.values())
    p = {w: (uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1)) for w in [*uni, None]}

    def p_bi(u, v):
        own = p[v] if v in uni else p[None]
        return 0.7 * big[u, v] / ctx[u] + 0.3 * own if ctx[u] else own

    other = [*TEXTS, (7, "the zebra sat on a mat zebra zebra cat " * 3)]
    scored = score_documents(spark.createDataFrame(other, "doc_id long, text string").repartition(2), fit_ngram_lm(docs))
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got.keys() == {d for d, _ in other}
    for d in got:
        pairs = [x for key, t in other if key == d for w in [re.findall(r"\w+", t or "")] for x in zip(w, w[1:])]
        assert got[d]["n_scored"] == len(pairs)
        if not pairs:
            assert got[d]["log_ppl"] is None and got[d]["cross_entropy"] is None
            continue
        assert got[d]["log_ppl"] == pytest.approx(-sum(math.log(p_bi(u, v)) for u, v in pairs) / len(pairs))
        h = -sum(p[v] * math.log(p_bi(u, v)) for u, _ in pairs for v in p) / len(pairs)
        assert got[d]["cross_entropy"] == pytest.approx(h)


def test_sums_of_values_by_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(KV, "HELD", 50)
    draw = np.random.default_rng(1)
    known = KV.mixed(draw.integers(0, 300, 400), 1)  # some keys twice: they add up
    values, rows = draw.normal(size=(2, 400)), [(i % 37 or None, [int(x) for x in draw.integers(0, 600, 9)]) for i in range(80)]
    table = spark.createDataFrame([(int(k.view(np.int64)), *map(float, v)) for k, v in zip(known, values.T)], "k long, a double, b double")

    def entries(batch):
        k, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        yield k.view(np.uint64), a, b

    def asked(batch):
        lists = batch.column(1).to_pylist()
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        keys = KV.mixed(np.array([x for own in lists for x in own]), 1)
        n = np.full(len(lists), 9)
        yield batch.column(0), n, n * 0.5, n * 0.0, row, keys, np.ones(len(keys), np.int64)

    docs = spark.createDataFrame(rows, "doc_id long, x array<long>")
    stored = KV.store_table(table, entries, 6, docs.schema["doc_id"].dataType)
    got = {r["doc_id"]: r for r in KV.summed_values(docs, stored, asked, 6).collect()}
    total = {int(k): values[:, known == k].sum(axis=1) for k in known}
    for d in {r[0] for r in rows}:
        keys = [int(k) for key, x in rows if key == d for k in KV.mixed(np.array(x), 1)]
        one, two = sum((total.get(k, np.zeros(2)) for k in keys), np.zeros(2))
        assert got[d]["n"] == len(keys) and got[d]["one"] == pytest.approx(0.5 * len(keys) + one) and got[d]["two"] == pytest.approx(two)
    some = np.unique(np.r_[known[:20], KV.mixed(np.arange(5000, 5010), 1)])
    assert np.allclose(KV.values_of(stored, some), np.array([total.get(int(k), np.zeros(2)) for k in some]).T)


def test_blocks_are_small_and_whole():
    keys = np.sort(KV.mixed(np.arange(100_000), 1))
    block = KV.packed(np.diff(keys, prepend=np.uint64(0)), np.ones(len(keys), np.int32))
    apart, ones = KV.unpacked(block, len(keys), np.uint64, np.int32)
    assert (np.cumsum(apart, dtype=np.uint64) == keys).all() and (ones == 1).all() and len(block) < 7.5 * len(keys)
    assert pa.Codec.is_available("zstd")


def test_a_gram_matrix_comes_from_a_bounded_number_of_tasks(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    seen, convert = [], svd.MLUtils.convertVectorColumnsFromML
    monkeypatch.setattr(svd.MLUtils, "convertVectorColumnsFromML", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or convert(df, *a))
    rows = spark.createDataFrame([(Vectors.dense([float(i), 1.0]),) for i in range(60)], ["tfidf"]).repartition(30)
    assert svd.svd_reduce(rows, k=2).singular_values[0] > 1 and seen == [spark.sparkContext.defaultParallelism]
