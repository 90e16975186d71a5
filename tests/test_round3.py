"""Phrase automaton, reading only the asked prediction folders."""

import random
import time

from pyspark.sql import functions as F

from penmark.operators import joins as J
from penmark.sources import io


def test_hits_equal_the_counts_of_the_table(spark):
    rng = random.Random(5)
    phrases = ["so", "as", "If", "if", "in addition", "aa", "aaa", "a", "ss", "", "é", "so as", "(so)", "so"]
    texts = [None, "", "aaaa aaa", "so-as so as soas", "IF é É in additional", *("".join(rng.choice("as oé,-F") for _ in range(300)) for _ in range(40))]
    df = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string")
    want = J.connector_table(df, phrases).where("n > 0")
    got = J.connector_hits(df, phrases)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert J.connector_hits(df, ["", ""]).count() == 0 and J.connector_hits(df.limit(0), phrases).count() == 0
    assert got.columns == want.columns


def test_long_lists_cost_little_more_than_short_ones(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(3000))) for i in range(40)], "doc_id long, text string").cache()

    def seconds(phrases):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            J.connector_hits(df, phrases).agg(F.sum("n")).collect()
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(words) < 4 * seconds(words[:26])
    df.unpersist()


def test_only_the_asked_prediction_folders_are_read(spark, tmp_path):
    rows = [(i, i % 2, i % 2, 0.5, 0.5, 0.5, v, c) for i in range(6) for v in ("Full model", "LOO - no Style") for c in ("RandomForest", "SVM(LinearSVC)")]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, predicted_label int, prediction_probability double, probability_class_0 double, probability_class_1 double, variant string, classifier string")
    io.write_predictions(df, str(tmp_path))
    preds, problems = io.read_predictions(spark, str(tmp_path), [("Full model", "SVM(LinearSVC)"), ("x", "y")])
    assert preds.count() == 6 and [tuple(r) for r in problems.collect()] == [("x", "y", "missing file")]
    plan = preds._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert scans and all("Full model" in line for line in scans)
    assert preds.select("variant", "classifier").distinct().count() == 1
    assert io.read_predictions(spark, str(tmp_path), [])[0].count() == 0
