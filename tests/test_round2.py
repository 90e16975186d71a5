"""Inputs on which operators lost rows or read the wrong column."""

import json

import pytest
from pyspark.sql import functions as F

from penmark.functions import tokens as K
from penmark.operators import metrics as M
from penmark.operators.features import annotate, annotation_features
from penmark.operators.tfidf import fit_tfidf
from penmark.sources import io


def test_confusion_matrix_counts_every_row(spark):
    rows = [(0, 1), (2, 0), (2, 2), (7, 0)]
    got = M.confusion_matrix(spark.createDataFrame(rows, "label int, predicted_label int")).collect()
    assert sum(r["n"] for r in got) == 4 and len(got) == 16
    assert {(r["label"], r["predicted_label"]) for r in got if r["n"]} == set(rows)
    empty = M.confusion_matrix(spark.createDataFrame([], "label int, predicted_label int")).collect()
    assert [r["n"] for r in empty] == [0] * 4


def test_confusion_matrix_refuses_nulls(spark):
    df = spark.createDataFrame([(0, None)], "label int, predicted_label int")
    with pytest.raises(Exception, match="null in predicted_label"):
        M.confusion_matrix(df).collect()


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text('TIPO,CONECTOR\nadd,"y, además"\nopp,pero\n')
    assert io.read_phrases(spark, str(tmp_path / "x.csv")) == ["pero", "y, además"]
    with pytest.raises(Exception, match="OTHER"):
        io.read_csv(spark, str(tmp_path / "x.csv"), "OTHER string").collect()


def test_flat_prediction_files(spark, tmp_path):
    def write(name, lines):
        (tmp_path / f"{name}_predictions.jsonl").write_text("\n".join(lines) + "\n")

    good = [json.dumps({"doc_id": i, "label": i % 2, "predicted_label": 0, "prediction_probability": 0.5}) for i in range(3)]
    write("Full_model_SVMLinearSVC", good)
    write("Single_-_Feat_LogisticReg", [*good, "{broken"])
    write("Single_-_Style_LogisticReg", [*good, json.dumps({"doc_id": 9, "label": 1})])
    (tmp_path / "other.jsonl").write_text("no prediction file\n")
    names = ["Full_model_SVMLinearSVC", "Single_-_Feat_LogisticReg", "Gone_RandomForest"]
    preds, problems = io.read_prediction_files(spark, str(tmp_path), names)
    assert {r["model"] for r in preds.collect()} == {names[0]} and preds.count() == 3
    assert {(r["model"], r["problem"]) for r in problems.collect()} == {(names[1], "bad json"), (names[2], "missing file")}
    _, problems = io.read_prediction_files(spark, str(tmp_path))
    assert {r["problem"] for r in problems.collect()} == {"bad json", "missing key"}


def test_accents(spark):
    words = ["škoda", "őrség", "été", "ﬁne", "été", "naïve", "plain"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(K.strip_accents(F.lower("w")).alias("w"))
    assert [r["w"] for r in df.collect()] == ["skoda", "orseg", "ete", "fine", "ete", "naive", "plain"]


def test_tfidf_accepts_null_text(spark):
    df = spark.createDataFrame([(1, "red blue"), (2, "red green"), (3, None), (4, "")], "doc_id int, text string")
    model = fit_tfidf(df, max_features=10)
    got = {r["doc_id"]: r["tfidf"].numNonzeros() for r in model.transform(df).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}
    assert {(r["doc_id"], r["term"], round(r["tfidf"], 6)) for r in model.transform_long(df).collect()} == {(1, "red", 1.0), (2, "red", 1.0)}


def test_annotation_features_keep_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "The cat sat."), (2, "A dog!"), (3, ""), (4, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in annotation_features(annotate(docs), docs).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[3]["pos_shares"] == {} and rows[4]["punct_shares"] == {} and rows[4]["stopword_ratio"] == 0
    assert rows[2]["punct_shares"] == {"punct_!": 0.5}
