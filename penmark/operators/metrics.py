"""Classification metrics, all derived from one confusion matrix.

The matrix is one partial aggregate over the predictions; everything after it works on at most
(classes x classes) rows per model.  Group columns (``by``) keep many models apart in one job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.session import materialize

BINARY = (0, 1)


def confusion_matrix(
    preds: DataFrame,
    label: str = "label",
    predicted: str = "predicted_label",
    classes: Sequence[int | str] = BINARY,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(label, predicted_label, n)`` for every pair of classes, 0 where a pair does not occur.

    Classes are those in the data together with ``classes`` (same type; may be empty), so every row is
    counted.  A null label or prediction is an error.  One partial aggregate over the rows; the grid is
    then filled inside one small row per group."""

    def known(name: str) -> Column:
        checked = F.raise_error(F.lit(f"null in {name}")).cast(preds.schema[name].dataType)
        return F.coalesce(F.col(name), checked)

    cells = preds.select(*by, known(label).alias("label"), known(predicted).alias("predicted_label"))
    cells = cells.groupBy(*by, "label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    named = [F.collect_set("label"), F.collect_set("predicted_label")]
    if classes:
        named.append(F.first(F.array(*[F.lit(x) for x in classes])) if by else F.array(*[F.lit(x) for x in classes]))
    per_group = cells.groupBy(*by).agg(
        F.collect_list(F.struct("label", "predicted_label", "n")).alias("cells"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*named)))).alias("classes"),
    )

    def count(a: Column, b: Column) -> Column:
        found = F.filter("cells", lambda x: (x["label"] == a) & (x["predicted_label"] == b))
        return F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0).cast("bigint"))

    grid = F.transform(
        "classes",
        lambda a: F.transform(
            "classes", lambda b: F.struct(a.alias("label"), b.alias("predicted_label"), count(a, b).alias("n"))
        ),
    )
    return per_group.select(*by, F.inline(F.flatten(grid)))


class Watch:
    """Rows, confusion cells and probability range of binary predictions, counted by the pass that
    stores them.

    ``store`` writes a table and returns it; ``cells`` and the rest then need no further job.
    ``groups`` names ``(label, predicted, probability)`` columns, one triple per model.  The metrics
    are read from the executed query: an ``Observation`` object would leave a manager in the session
    which keeps Spark's own models with a training summary from being sent to tasks."""

    def __init__(self, groups: Sequence[tuple[Column | str, Column | str, Column | str]]):
        self.groups = [tuple(F.col(x) if isinstance(x, str) else x for x in g) for g in groups]
        self.seen: dict[str, float] = {}

    def store(self, df: DataFrame) -> DataFrame:
        counts = [F.count(F.lit(1)).alias("rows")]
        for i, (label, predicted, p) in enumerate(self.groups):
            counts += [F.count_if((label == a) & (predicted == b)).alias(f"n{i}_{a}{b}") for a in BINARY for b in BINARY]
            counts += [F.min(p).alias(f"low{i}"), F.max(p).alias(f"high{i}")]
        name = f"watch-{uuid.uuid4().hex}"
        watched = df.observe(name, *counts)
        stored = materialize(watched)
        self.seen = json.loads(watched._jdf.queryExecution().observedMetrics().apply(name).json())
        return stored

    @property
    def rows(self) -> int:
        return self.seen["rows"]

    def cells(self, group: int = 0) -> list[tuple[int, int, int]] | None:
        """``(label, predicted_label, n)``; None where a row is outside the two classes or null, which the
        full ``confusion_matrix`` then counts or reports."""
        got = [(a, b, self.seen[f"n{group}_{a}{b}"]) for a in BINARY for b in BINARY]
        return got if sum(n for _, _, n in got) == self.rows else None

    def probability_range(self, group: int = 0) -> tuple[float | None, float | None]:
        return self.seen.get(f"low{group}"), self.seen.get(f"high{group}")


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def class_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1 and support; 0 where a denominator is 0."""
    w_true = Window.partitionBy(*by, "label")
    w_pred = Window.partitionBy(*by, "predicted_label")
    cells = matrix.withColumn("support", F.sum("n").over(w_true)).withColumn(
        "claimed", F.sum("n").over(w_pred)
    )
    diag = cells.where("label = predicted_label")
    scored = diag.select(
        *by,
        F.col("label").alias("class"),
        _safe(F.col("n"), F.col("claimed")).alias("precision"),
        _safe(F.col("n"), F.col("support")).alias("recall"),
        "support",
        "n",
    )
    f1 = _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def classification_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    Classes that neither occur nor are predicted are left out, as they are not labels of the
    evaluated rows."""
    seen = class_scores(matrix, by).join(
        _present_classes(matrix, by), [*by, "class"], "left_semi"
    )
    per_class = seen.select(
        *by, F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support"
    )
    total = F.sum("support")
    weighted = {m: _safe(F.sum(F.col(m) * F.col("support")), total) for m in ("precision", "recall", "f1")}
    summary = seen.groupBy(*by).agg(
        _safe(F.sum("n"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted[m].alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        total.alias("support"),
    )

    def line(name: str, p: str, r: str, f: str) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.col(p).alias("precision"),
            F.col(r).alias("recall"),
            F.col(f).alias("f1"),
            F.col("support"),
        )

    lines = F.array(
        line("accuracy", "accuracy", "accuracy", "accuracy"),
        line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
        line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
    )
    return per_class.unionByName(summary.select(*by, F.inline(lines)))


def _present_classes(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    nonzero = matrix.where("n > 0")
    return nonzero.select(*by, F.explode(F.array("label", "predicted_label")).alias("class")).distinct()


def macro_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro (unweighted) precision, recall and F1."""
    seen = class_scores(matrix, by).join(_present_classes(matrix, by), [*by, "class"], "left_semi")
    return seen.groupBy(*by).agg(
        _safe(F.sum("n"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )
