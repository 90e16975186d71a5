"""Metrics counted while predictions are written."""

import pytest

from penmark.operators import classify as CL
from penmark.operators.metrics import Watch, confusion_matrix

SCHEMA = "label int, predicted_label int, prediction_probability double"


def watched(spark, rows):
    watch = Watch([("label", "predicted_label", "prediction_probability")])
    preds = watch.store(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return watch, preds


def test_counts_need_no_second_job(spark):
    rows = [(i % 2, (i // 3) % 2, i / 100) for i in range(100)]
    watch, preds = watched(spark, rows)
    spark.sparkContext.setJobGroup("watch", "metrics of a written table")
    cells, ends, n = watch.cells(), watch.probability_range(), watch.rows
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("watch")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == [] and n == 100 and ends == (0.0, 0.99)
    assert cells == [tuple(r) for r in confusion_matrix(preds).select("label", "predicted_label", "n").collect()]


@pytest.mark.parametrize("odd", [(None, 1, 0.5), (1, None, 0.5), (2, 1, 0.5)])
def test_rows_outside_the_classes_are_noticed(spark, odd):
    watch, _ = watched(spark, [(0, 0, 0.1), odd])
    assert watch.cells() is None and watch.rows == 2


def test_empty_predictions(spark):
    watch, _ = watched(spark, [])
    assert watch.rows == 0 and watch.probability_range() == (None, None)
    assert watch.cells() == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_evaluation_equals_the_stored_predictions(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS label", "array(id % 2 + (id % 7) / 5D, id % 5 / 5D) AS f")
    from pyspark.ml.functions import array_to_vector

    df = df.select("doc_id", "label", array_to_vector("f").alias("features"))
    r = CL.evaluate(CL.fit_lr, df, df)
    matrix = {(a, b): n for a, b, n in r["cells"]}
    assert matrix == {(x["label"], x["predicted_label"]): x["n"] for x in confusion_matrix(r["predictions"]).collect()}
    low, high = r["predictions"].selectExpr("min(prediction_probability)", "max(prediction_probability)").first()
    assert r["probability_range"] == (low, high)
