"""Zero-shot detection: score, threshold, verdict, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penmark.operators.metrics import classification_report, confusion_matrix
from penmark.operators.ngram_lm import NgramLM, score_documents
from penmark.operators.reshape import VERDICTS, drop_unscored, recode

HUMAN, MACHINE = VERDICTS


def zero_shot_score(df: DataFrame, lm: NgramLM, text: str = "text") -> DataFrame:
    """``(doc_id, score)``: log-perplexity of the performer (bigram model) over the
    cross-entropy between observer (unigram model) and performer at the same positions.
    Low means machine-written.  A null or too short text has a null score."""
    scored = score_documents(df, lm, text)
    return scored.select("doc_id", (F.col("log_ppl") / F.col("cross_entropy")).alias("score"))


def choose_threshold(scores: DataFrame, bins: int = 1000, score: str = "score", label: str = "label") -> DataFrame:
    """One row ``(threshold, accuracy)``: the bin edge that classifies most labelled scores
    correctly when scores below it count as machine.

    Scores are counted into bins first, so the running sums see at most ``bins`` rows."""
    valid = scores.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    ends = valid.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no labelled scores")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins or 1.0
    binned = valid.select(
        F.least(F.floor((F.col(score) - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"), F.col(label).alias("y")
    )
    counts = binned.groupBy("bin").agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))
    everything = Window.partitionBy()
    upto = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Edge after this bin: ones in it and below are right, zeros above are right.
    right = F.sum("ones").over(upto) + F.sum("zeros").over(everything) - F.sum("zeros").over(upto)
    total = F.sum(F.col("ones") + F.col("zeros")).over(everything)
    edges = counts.select((F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("threshold"), (right / total).alias("accuracy"))
    return edges.orderBy(F.desc("accuracy"), "threshold").limit(1)


def zero_shot_predict(scores: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Adds the verdict text; a null score has a null verdict."""
    s = F.col(score)
    verdict = F.when(s < threshold, F.lit(MACHINE)).when(s >= threshold, F.lit(HUMAN))
    return scores.withColumn("prediction", verdict)


def evaluate_zero_shot(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, confusion matrix) over the rows that have a verdict."""
    coded = drop_unscored(recode(verdicts, "prediction"), "prediction")
    matrix = confusion_matrix(coded, "label", "prediction")
    return classification_report(matrix), matrix
