"""Pairwise significance of model scores: signed-rank tests, correction, summary matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.operators.joins import pair_predictions
from penmark.operators.ranking import bonferroni, holm, value_cell


def true_class_score(preds: DataFrame, prob: str = "prediction_probability", label: str = "label") -> DataFrame:
    """Adds ``score``: the probability given to the true class."""
    p = F.col(prob)
    return preds.withColumn("score", F.when(F.col(label) == 1, p).otherwise(1 - p))


def threshold_labels(preds: DataFrame, threshold: float = 0.5, prob: str = "prediction_probability") -> DataFrame:
    return preds.withColumn("predicted_label", (F.col(prob) > threshold).cast("int"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; runs on one row per compared pair."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def signed_rank_sums(pairs: DataFrame) -> DataFrame:
    """Signed-rank sums of ``score_a - score_b`` per model pair, zeros ranked and then dropped
    (Pratt): ``(model_a, model_b, n, n_zero, r_plus, r_minus, tie_term)``.

    Only rank *sums* are needed, so no row ever gets a rank.  Equal |d| are counted before the
    shuffle.  Within a cell of values a local running count gives local ranks; a cell then
    reports its size, its sums of local ranks by sign, and its tie term.  The running total over
    cells adds each cell's offset times its number of positive (negative) differences."""
    pair = ["model_a", "model_b"]
    d = F.round(F.col("score_a") - F.col("score_b"), 12)
    counts = (
        pairs.select(*pair, d.alias("d"))
        .groupBy(*pair, F.abs("d").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("t"),
            F.count_if(F.col("d") > 0).alias("plus"),
            F.count_if(F.col("d") < 0).alias("minus"),
        )
        .withColumn("cell", value_cell(F.col("v")))
    )
    local = Window.partitionBy(*pair, "cell").orderBy("v")
    cum = F.sum("t").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = F.col("t").cast("double")
    cells = (
        counts.withColumn("local_rank", cum - (t - 1) / 2)
        .groupBy(*pair, "cell")
        .agg(
            F.sum("t").alias("size"),
            F.sum("plus").alias("plus"),
            F.sum("minus").alias("minus"),
            F.sum(F.col("local_rank") * F.col("plus")).alias("local_plus"),
            F.sum(F.col("local_rank") * F.col("minus")).alias("local_minus"),
            F.sum(F.when(F.col("v") == 0, F.col("t")).otherwise(F.lit(0))).alias("zeros"),
            F.sum(F.when(F.col("v") > 0, t * t * t - t).otherwise(F.lit(0.0))).alias("ties"),
        )
    )
    before = Window.partitionBy(*pair).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return placed.groupBy(*pair).agg(
        F.sum("size").alias("n"),
        F.sum("zeros").alias("n_zero"),
        F.sum(F.col("offset") * F.col("plus") + F.col("local_plus")).alias("r_plus"),
        F.sum(F.col("offset") * F.col("minus") + F.col("local_minus")).alias("r_minus"),
        F.sum("ties").alias("tie_term"),
    )


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank test per pair: ``(model_a, model_b, wilcoxon_stat, z, p_value)``.

    Two-sided, Pratt zeros, normal approximation, no continuity correction (always the normal
    form, also for small samples).  If all differences are zero, z and p are null."""
    n, n0 = F.col("n").cast("double"), F.col("n_zero").cast("double")
    mean = n * (n + 1) / 4 - n0 * (n0 + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - n0 * (n0 + 1) * (2 * n0 + 1) - F.col("tie_term") / 2) / 24
    scored = signed_rank_sums(pairs).select(
        "model_a",
        "model_b",
        F.least("r_plus", "r_minus").alias("wilcoxon_stat"),
        F.when(var > 0, (F.col("r_plus") - mean) / F.sqrt(var)).alias("z"),
    )
    return scored.withColumn("p_value", two_sided_p("z"))


def pairwise_tests(preds: DataFrame, models: Sequence[str], score: str = "score") -> DataFrame:
    """Signed-rank tests of all pairs of the given models, in one job."""
    return wilcoxon(pair_predictions(preds, models, score))


def wilcoxon_results(
    preds: DataFrame, models: Sequence[str], alpha: float = 0.05, method: str = "holm"
) -> DataFrame:
    """The result table: ``Model_A, Model_B, Wilcoxon_stat, p_value, p_value_corrected, Significant``.

    ``preds`` holds ``(doc_id, model, label, prediction_probability)``; each row is scored with
    its own label and documents are aligned by key."""
    correct = {"holm": holm, "bonferroni": bonferroni}[method]
    tests = correct(pairwise_tests(true_class_score(preds), models), alpha=alpha)
    return tests.select(
        F.col("model_a").alias("Model_A"),
        F.col("model_b").alias("Model_B"),
        F.col("wilcoxon_stat").alias("Wilcoxon_stat"),
        "p_value",
        "p_value_corrected",
        F.col("significant").alias("Significant"),
    ).orderBy("Model_A", "Model_B")


def raw_significant(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs whose uncorrected p-value is below alpha."""
    return results.where(F.col("p_value") < alpha)


def significance_matrix(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Symmetric model x model table of the corrected flag; false where nothing was tested."""
    names = sorted(models)
    both = results.select(
        F.inline(
            F.array(
                F.struct(F.col("Model_A").alias("model"), F.col("Model_B").alias("other"), "Significant"),
                F.struct(F.col("Model_B").alias("model"), F.col("Model_A").alias("other"), "Significant"),
            )
        )
    )
    flags = both.groupBy("model").pivot("other", names).agg(F.first("Significant"))
    return flags.na.fill(False)
