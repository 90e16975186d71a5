"""Metrics, samples, ranks and significance against hand-worked values and brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from penmark.operators import metrics as M
from penmark.operators import ranking as W
from penmark.operators import sampling as P
from penmark.operators import significance as Z
from penmark.operators.joins import pair_predictions
from penmark.operators.quantiles import quantiles
from penmark.physical import at_least_top, collect_top, fits


def wilcoxon_brute(d):
    d = [round(x, 12) for x in d]
    n, n0 = len(d), sum(x == 0 for x in d)
    ordered = sorted(abs(x) for x in d)
    rank = {v: sum(i + 1 for i, x in enumerate(ordered) if x == v) / ordered.count(v) for v in set(ordered)}
    plus = sum(rank[abs(x)] for x in d if x > 0)
    minus = sum(rank[abs(x)] for x in d if x < 0)
    ties = sum(ordered.count(v) ** 3 - ordered.count(v) for v in set(ordered) if v > 0)
    mean = n * (n + 1) / 4 - n0 * (n0 + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - n0 * (n0 + 1) * (2 * n0 + 1) - ties / 2) / 24
    if var <= 0:
        return min(plus, minus), None, None
    z = (plus - mean) / math.sqrt(var)
    return min(plus, minus), z, math.erfc(abs(z) / math.sqrt(2))


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(7)
    rows = []
    for doc in range(400):
        base = rng.choice([0.1, 0.25, 0.5, 0.75])
        for m in ("a", "b", "c"):
            # a third of all differences are zero, and many tie
            s = base if rng.random() < 0.6 else round(rng.random(), 1)
            rows.append((doc, m, s))
        rows.append((doc, "twin", rows[-1][2]))
    return rows, spark.createDataFrame(rows, "doc_id long, model string, score double")


def test_wilcoxon_against_brute_force(scores):
    rows, df = scores
    by_model = {}
    for doc, m, s in rows:
        by_model.setdefault(m, {})[doc] = s
    for r in Z.pairwise_tests(df, ["a", "b", "c", "twin"]).collect():
        a, b = by_model[r["model_a"]], by_model[r["model_b"]]
        stat, z, p = wilcoxon_brute([a[k] - b[k] for k in a])
        assert r["wilcoxon_stat"] == pytest.approx(stat)
        if z is None:
            assert r["z"] is None and r["p_value"] is None
        else:
            assert r["z"] == pytest.approx(z, abs=1e-9) and r["p_value"] == pytest.approx(p, abs=1e-12)


def test_swapping_a_pair_keeps_the_statistic(spark, scores):
    _, df = scores
    pairs = pair_predictions(df, ["a", "b"])
    swapped = pairs.select("doc_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), F.col("score_b").alias("score_a"), F.col("score_a").alias("score_b"))
    assert Z.wilcoxon(pairs).first()["wilcoxon_stat"] == Z.wilcoxon(swapped).first()["wilcoxon_stat"]


def test_identical_models_have_no_p(spark):
    rows = [(i, m, 0.5) for i in range(5) for m in ("x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, model string, score double")
    r = Z.pairwise_tests(df, ["x", "y"]).first()
    assert r["z"] is None and r["p_value"] is None


def test_average_rank(spark):
    df = spark.createDataFrame([("p", v) for v in (0.0, 0.0, 0.5, 0.5, 0.5, 3.0)], "part string, v double")
    got = {r["value"]: r["rank"] for r in W.average_rank(df, "part", "v").collect()}
    assert got == {0.0: 1.5, 0.5: 4.0, 3.0: 6.0}


def test_average_rank_of_any_range(spark):
    """Values far above 1, negative ones, and most of them close together."""
    values = [float(v * v) for v in range(0, 1000, 2)] * 2 + [1e-9 * v for v in range(500)] + [-5.0, 1e6, 1e6]
    df = spark.createDataFrame([("p", v) for v in values] + [(None, 7.0), ("p", None)], "part string, v double")
    want = pd.Series(values).rank().groupby(pd.Series(values).round(12)).first().to_dict()
    rows = W.average_rank(df, "part", "v").collect()
    got = {r["value"]: r["rank"] for r in rows if r["part"] == "p" and r["value"] is not None}
    assert got == want
    assert [r["rank"] for r in rows if r["part"] is None] == [1.0]
    assert [r["rank"] for r in rows if r["value"] is None] == [len(values) + 1.0]


def test_rank_tasks_shrink_with_partitions(spark):
    """One part holds nearly all rows, one value a third of them."""
    rows = [("hot", float(v)) for v in range(4000)] + [("hot", 17.0)] * 2000 + [("cold", 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "part string, v double")
    want = pd.Series([v for p, v in rows if p == "hot"]).rank().groupby([v for p, v in rows if p == "hot"]).first().to_dict()
    for many in (2, 16):
        ranked = W.average_rank(df, "part", "v", partitions=many)
        assert {r["value"]: r["rank"] for r in ranked.where("part = 'hot'").collect()} == want
        counts = df.groupBy("part", "v").count().repartitionByRange(many, "part", F.asc_nulls_last("v"))
        largest = counts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 2 * 4002 / many


def test_positions_follow_the_sort(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "(id * 7919) % 1009 AS k").orderBy("k")
    got = W.with_position(df).collect()
    assert [r["position"] for r in sorted(got, key=lambda r: r["k"])] == list(range(1000))
    assert W.with_position(df.limit(0)).collect() == []


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_quantiles_are_exact(spark, small):
    """Ties, a value on a third of the rows, huge and tiny values, null and NaN."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), [1e300, -1e300, 5e-324], rng.integers(0, 5, 500)])
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    shares = [0.0, 0.001, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = {r["share"]: r["value"] for r in quantiles(spark.createDataFrame(rows, "v double"), "v", shares, small=small).collect()}
    for q in shares:
        assert got[q] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_quantiles_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert [r["value"] for r in quantiles(none, "v", [0.0, 0.5]).collect()] == [None, None]
    same = spark.range(30_000).selectExpr("5 AS v")
    assert [r["value"] for r in quantiles(same, "v", [0.0, 0.5, 1.0]).collect()] == [5.0, 5.0, 5.0]


def test_top_rows_leave_their_tasks(spark):
    df = spark.range(0, 20_000, 1, 50).selectExpr("id AS term", "cast(1e6 / (id + 1) AS bigint) AS c")
    kept = at_least_top(df, "c", 100).count()
    assert 100 <= kept <= 110
    assert [r["term"] for r in collect_top(df, "c", [F.asc("term")], 100)] == list(range(100))
    assert len(collect_top(df.limit(5), "c", [F.asc("term")], 100)) == 5
    assert collect_top(df.limit(0), "c", [F.asc("term")], 100) == []


def test_broadcast_is_checked_by_bytes(spark):
    wide = spark.range(100).selectExpr("repeat('x', 1000) AS word", "array(id, id) AS a", "struct(id) AS s")
    assert fits(wide, 100) and not fits(wide, 99) and not fits(wide, 100, 100_000)
    assert fits(wide, 100, 110_000) and fits(wide.limit(0), 0, 0)


def test_holm(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "i int, p_value double")
    got = {r["i"]: (r["p_value_corrected"], r["significant"]) for r in W.holm(df).collect()}
    want = {0: (0.03, True), 1: (0.06, False), 2: (0.06, False), 3: (0.02, True)}
    for i, (p, s) in want.items():
        assert got[i][0] == pytest.approx(p) and got[i][1] == s
    assert got[4] == (None, False)


def test_metrics_when_a_class_is_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0), (0, 0), (0, 0)], "label int, predicted_label int")
    m = M.confusion_matrix(df)
    assert {(r["label"], r["predicted_label"]): r["n"] for r in m.collect()} == {(0, 0): 3, (0, 1): 0, (1, 0): 2, (1, 1): 0}
    s = M.macro_scores(m).first()
    assert s["accuracy"] == pytest.approx(0.6) and s["recall"] == pytest.approx(0.5)
    assert s["precision"] == pytest.approx(0.3) and s["f1"] == pytest.approx(0.375)
    names = {r["name"] for r in M.classification_report(m).collect()}
    assert names == {"0", "1", "accuracy", "macro avg", "weighted avg"}


def test_split_is_a_stratified_partition(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, label int")
    train, test = P.stratified_split(df)
    a, b = {r["doc_id"] for r in train.collect()}, {r["doc_id"] for r in test.collect()}
    assert not a & b and a | b == set(range(1000))
    sizes = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert sizes == {0: round(0.2 * 666), 1: round(0.2 * 334)}


def test_sample_of_a_tiny_class_may_be_empty(spark):
    df = spark.createDataFrame([(i, 0) for i in range(200)] + [(900, 1)], "doc_id long, label int")
    got = P.stratified_sample(df, frac=0.01).collect()
    assert len(got) == 2 and all(r["label"] == 0 for r in got)
