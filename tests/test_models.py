"""TF-IDF, language model, blocks, selection, classifiers and sources against brute force."""

import json
import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from penmark.operators import ablation as AB
from penmark.operators import blocks as B
from penmark.operators import classify as CL
from penmark.operators import selection as SE
from penmark.operators.ngram_lm import fit_ngram_lm, perplexity, score_documents
from penmark.operators.reshape import pad_vectors, parse_vector_column
from penmark.operators.svd import SvdModel, svd_reduce
from penmark.operators.tfidf import TfidfModel, fit_tfidf
from penmark.operators.zeroshot import choose_threshold, evaluate_zero_shot, zero_shot_predict
from penmark.sources import io

RNG = np.random.default_rng(3)
WORDS = ["the", "cat", "sat", "on", "mat", "dog", "ran", "far", "été", "ago"]
# A third of all texts repeat one pair of words: a hot bigram and hot n-grams.
TEXTS = ["the cat the cat the cat the cat" if i % 3 == 0 else " ".join(RNG.choice(WORDS, RNG.integers(1, 12))) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)


def grams(text, lo=1, hi=4):
    t = re.findall(r"\w\w+", text.lower().replace("é", "e"))
    return [" ".join(t[i : i + n]) for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


@pytest.mark.parametrize("k", [1, 3, 5, 12, 40, 5000])
def test_tfidf_vocabulary_is_exact_for_every_size(docs, k):
    """Small sizes use the pruned path, with many equal counts."""
    tf, df = Counter(), Counter()
    for t in TEXTS:
        tf.update(grams(t))
        df.update(set(grams(t)))
    want = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:k]
    model = fit_tfidf(docs, max_features=k)
    assert [v[0] for v in model.vocabulary] == sorted(want)
    for term, _, n, d, idf in model.vocabulary:
        assert (n, d) == (tf[term], df[term])
        assert idf == pytest.approx(math.log((1 + len(TEXTS)) / (1 + d)) + 1)


def test_tfidf_rows_have_length_one_and_survive_storage(spark, docs, tmp_path):
    model = fit_tfidf(docs, max_features=50)
    sums = model.transform_long(docs).groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    model.save(spark, str(tmp_path))
    again = TfidfModel.load(spark, str(tmp_path))
    assert again.vocabulary == model.vocabulary and again.ngram == model.ngram


def test_unseen_text_uses_the_training_vocabulary(spark, docs):
    model = fit_tfidf(docs, max_features=50)
    other = spark.createDataFrame([(1, "zebra zebra"), (2, "zebra cat")], "doc_id long, text string")
    assert {(r["doc_id"], r["term"]) for r in model.transform_long(other).collect()} == {(2, "cat")}


def brute_lm(texts, size, k, lam):
    tok = [re.findall(r"\w+", t.lower()) for t in texts]
    uni = Counter(w for t in tok for w in t)
    top = sorted(uni, key=lambda w: (-uni[w], w))[:size]
    n = sum(uni.values())
    den = n + k * (len(top) + 1)
    p = {w: (uni[w] + k) / den for w in top}
    p[None] = (n - sum(uni[w] for w in top) + k) / den
    norm = {w: w for w in top}
    big, ctx = Counter(), Counter()
    for t in tok:
        for u, v in zip(t, t[1:]):
            if u in norm:
                big[u, norm.get(v)] += 1
                ctx[u] += 1

    def p_bi(u, v):
        v = norm.get(v)
        if u not in norm or not ctx[u]:
            return p[v]
        return lam * big[u, v] / ctx[u] + (1 - lam) * p[v]

    return p, p_bi, tok


@pytest.mark.parametrize("size", [4, 100])
def test_lm_scores_match_dense_computation(spark, docs, size):
    p, p_bi, _ = brute_lm(TEXTS, size, 0.5, 0.7)
    assert sum(p.values()) == pytest.approx(1.0)
    for u in ("the", "ago"):
        assert sum(p_bi(u, v) for v in p) == pytest.approx(1.0)
    lm = fit_ngram_lm(docs, vocab_size=size)
    other = [(0, "the cat sat on zebra zebra"), (1, "mat"), (2, None), (3, "zebra the dog " * 30)]
    scored = score_documents(spark.createDataFrame(other, "doc_id long, text string"), lm)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got[1]["log_ppl"] is None and got[2]["log_ppl"] is None
    for i in (0, 3):
        t = re.findall(r"\w+", other[i][1])
        pairs = list(zip(t, t[1:]))
        assert got[i]["n_scored"] == len(pairs)
        assert got[i]["log_ppl"] == pytest.approx(-sum(math.log(p_bi(u, v)) for u, v in pairs) / len(pairs))
        h = sum(-sum(p[v] * math.log(p_bi(u, v)) for v in p) for u, _ in pairs) / len(pairs)
        assert got[i]["cross_entropy"] == pytest.approx(h)


def test_hot_bigrams_by_broadcast_or_by_shuffle_agree(spark, docs):
    lm = fit_ngram_lm(docs)
    with_hot = sorted(perplexity(docs, lm).collect())
    lm.hot = lm.hot.limit(0)
    without = sorted(perplexity(docs, lm).collect())
    for a, b in zip(with_hot, without, strict=True):
        assert a["doc_id"] == b["doc_id"] and (a["perplexity"] is None or a["perplexity"] == pytest.approx(b["perplexity"]))
        assert a["perplexity"] is None or a["perplexity"] >= 1.0


def test_max_len_scores_a_prefix(spark, docs):
    lm = fit_ngram_lm(docs)
    df = spark.createDataFrame([(1, "the cat sat on"), (2, "the cat sat on mat mat mat")], "doc_id long, text string")
    got = {r["doc_id"]: r["perplexity"] for r in perplexity(df, lm, max_len=4).collect()}
    assert got[1] == pytest.approx(got[2])


def test_zero_shot_threshold_and_nulls(spark):
    rows = [(i, i / 10, 1 if i < 5 else 0) for i in range(10)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, score double, label int")
    best = choose_threshold(df).first()
    assert best["accuracy"] == 1.0 and 0.4 < best["threshold"] <= 0.5
    verdicts = zero_shot_predict(df, best["threshold"])
    assert verdicts.where("prediction IS NULL").count() == 1
    report, matrix = evaluate_zero_shot(verdicts)
    assert sum(r["n"] for r in matrix.collect()) == 10
    assert {r["name"]: r["f1"] for r in report.collect()}["macro avg"] == 1.0


def test_vector_cells(spark):
    df = spark.createDataFrame([(1, "[1, 2]"), (2, "(1, 2)"), (3, "4.5"), (4, "(3,)")], "i int, v string")
    got = {r["i"]: r["v"] for r in parse_vector_column(df, "v").collect()}
    assert got == {1: [1.0, 2.0], 2: [1.0, 2.0], 3: [4.5], 4: [3.0]}
    for bad in ("x", None):
        with pytest.raises(Exception, match="not a vector"):
            parse_vector_column(spark.createDataFrame([(1, bad)], "i int, v string"), "v").collect()
    numbers = spark.createDataFrame([(1, 7.0)], "i int, v double")
    assert parse_vector_column(numbers, "v").first()["v"] == [7.0]
    padded = pad_vectors(parse_vector_column(df, "v"), "v").collect()
    assert all(len(r["v"]) == 2 for r in padded) and math.isnan([r for r in padded if r["i"] == 3][0]["v"][1])


@pytest.mark.parametrize("at_once", [1, 50_000])
def test_projection_of_sparse_dense_and_empty_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr("penmark.operators.svd.TERMS_AT_ONCE", at_once)
    model = SvdModel(np.arange(21.0).reshape(7, 3) ** 1.5, np.ones(3))
    rows = [Vectors.sparse(7, {1: 2.0, 5: 1.0}), Vectors.sparse(7, {}), Vectors.dense(list(range(7))), Vectors.sparse(7, {6: 1.5})]
    for some in (rows, [rows[0], rows[1], rows[3]], [rows[2]], [rows[1]]):
        df = spark.createDataFrame(list(enumerate(some)), ["doc_id", "tfidf"]).coalesce(1)
        got = [r["tfidf"] for r in model.transform(df).orderBy("doc_id").collect()]
        assert np.allclose(got, [v.toArray() @ model.components for v in some])


def test_svd_matches_numpy(spark, tmp_path):
    x = RNG.random((40, 12)) * (RNG.random((40, 12)) < 0.4)
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["doc_id", "tfidf"])
    model = svd_reduce(df, k=4)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular_values, s[:4])
    got = np.array([r["tfidf"] for r in model.transform(df).orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:4].T))
    model.save(spark, str(tmp_path))
    assert np.allclose(SvdModel.load(spark, str(tmp_path)).components, model.components)


def test_blocks_are_scaled_on_train_and_stored(spark, docs, tmp_path):
    rows = [(i, t, i % 2, [float(i), 5.0, float("nan") if i % 4 else 1.0], float(i)) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, style array<double>, pplx double")
    train, test = df.where("doc_id < 40"), df.where("doc_id >= 40")
    a, b, model = B.build_blocks(train, test, max_features=20, svd_components=3)
    style = np.array([r["style"] for r in a.collect()])
    assert np.allclose(style.mean(axis=0), 0) and style[:, 0].std() == pytest.approx(1.0)
    assert np.all(style[:, 1:] == 0.0)
    assert all(len(r["tfidf"]) == 3 and len(r["pplx"]) == 1 for r in b.collect())
    model.save(spark, str(tmp_path))
    again = B.BlockModel.load(spark, str(tmp_path)).transform(test).orderBy("doc_id").collect()
    for r, s in zip(b.orderBy("doc_id").collect(), again, strict=True):
        assert np.allclose(r["tfidf"], s["tfidf"]) and np.allclose(r["style"], s["style"])
    with pytest.raises(ValueError):
        B.concat_blocks(a, {})


@pytest.fixture(scope="module")
def blobs(spark):
    rows = []
    for i in range(200):
        y = i % 2
        rows.append((i, y, [float(v) for v in RNG.normal(2.0 * y - 1, 0.7, 3)] + [float(RNG.normal())]))
    return spark.createDataFrame(rows, "doc_id long, label int, x array<double>")


def test_ridge_matches_closed_form(blobs):
    cols = ["a", "b", "c", "noise"]
    fit = SE.ridge_select(blobs, cols)
    rows = blobs.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + fit.alpha * np.eye(4), xc.T @ yc)
    assert np.allclose(fit.coefficients, w)
    assert fit.kept == ["a", "b", "c"] and len(fit.scores) == 20


def test_forest_finds_the_informative_columns(blobs):
    wide = blobs.select("doc_id", "label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(["a", "b", "c", "noise"])])
    imp = {r["feature"]: r["importance"] for r in SE.rf_importances(wide, ["a", "b", "c", "noise"], trees=20, max_depth=5).collect()}
    assert min(imp, key=imp.get) == "noise" and sum(imp.values()) == pytest.approx(1.0)
    chosen = SE.select_features(wide, ["a", "b", "c", "noise"], trees=20, max_depth=5)
    assert SE.selection_accuracy(chosen, wide, wide).first()["accuracy"] > 0.85


def test_grid_storage_and_significance(spark, blobs, tmp_path):
    blocks = blobs.select("doc_id", "label", F.slice("x", 1, 3).alias("style"), F.slice("x", 4, 1).alias("feat"))
    fits = {
        "SVM(LinearSVC)": partial(CL.fit_svm, max_iter=3),
        "RandomForest": partial(CL.fit_rf, trees=5, max_depth=3),
        "LogisticReg": partial(CL.fit_lr, max_iter=20),
    }
    variants = {"Single - Style": ("style",), "Single - Feat": ("feat",)}
    results, preds, models = AB.run_ablation(blocks, blocks, variants, fits)
    rows = results.collect()
    assert [r["Variant"] for r in rows] == ["Single - Style"] * 3 + ["Single - Feat"] * 3
    assert all(r["Accuracy"] > 0.85 for r in rows[:3]) and all(sum(map(sum, r["Confusion Matrix"])) == 200 for r in rows)
    assert preds.where("probability_class_1 NOT BETWEEN 0 AND 1").count() == 0

    path = str(tmp_path / "preds")
    io.write_predictions(preds, path)
    stored, problems = io.read_predictions(spark, path, [("Single - Style", "RandomForest"), ("No such", "model")])
    assert stored.count() == 200 and [tuple(r) for r in problems.collect()] == [("No such", "model", "missing file")]
    assert {r["model"] for r in stored.select("model").distinct().collect()} == {"Single_-_Style_RandomForest"}

    io.write_results(results, str(tmp_path / "results"))
    csv = io.read_csv(spark, str(tmp_path / "results" / "csv"), AB.RESULT_SCHEMA.split(", `Class")[0] + ", `Classification Report` string, `Confusion Matrix` string")
    assert json.loads(csv.first()["Confusion Matrix"]) == rows[0]["Confusion Matrix"]

    io.save_models(models, str(tmp_path / "models"))
    again = io.load_model(str(tmp_path / "models"), "Single - Style", "LogisticReg")
    x = blobs.select(array_to_vector(F.slice("x", 1, 3)).alias("features"), "label")
    old = CL.predict(models[("Single - Style", "LogisticReg")], x).select("prediction_probability").collect()
    assert CL.predict(again, x).select("prediction_probability").collect() == old


def test_bad_prediction_files_are_reported(spark, tmp_path):
    good = {"doc_id": 1, "label": 0, "prediction_probability": 0.2}
    lines = {"ok": [json.dumps(good)], "broken": [json.dumps(good), "{not json"], "partial": ['{"doc_id": 1, "label": 1}']}
    for name, content in lines.items():
        folder = tmp_path / f"variant={name}" / "classifier=c"
        folder.mkdir(parents=True)
        (folder / "part.json").write_text("\n".join(content))
    preds, problems = io.read_predictions(spark, str(tmp_path))
    assert [r["variant"] for r in preds.collect()] == ["ok"]
    assert {r["variant"]: r["problem"] for r in problems.collect()} == {"broken": "bad json", "partial": "missing key"}


def test_forests_keep_the_nodes_of_rows(blobs):
    """no walk from the root for every row, tree and level."""
    x = blobs.select(array_to_vector("x").alias("features"), "label")
    assert CL.fit_rf(x, trees=3, max_depth=4).getCacheNodeIds()
