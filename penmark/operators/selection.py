"""Linguistic feature selection: forest importances, then ridge coefficients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions.hashing import hash_key
from penmark.operators.blocks import ImputeMean, StandardizeBlock
from penmark.operators.joins import selected_importances
from penmark.operators.metrics import confusion_matrix, macro_scores
from penmark.operators.partial_sums import keyed_sums
from penmark.operators.ranking import rank_features
from penmark.operators.reshape import DISPLAY_NAMES, pack_features, rename_values

# 20 penalties, log-spaced from 1e-3 to 1e3.
ALPHAS = tuple(np.logspace(-3, 3, 20))


def _vector_column(df: DataFrame, array_col: str, into: str = "features") -> DataFrame:
    return df.withColumn(into, array_to_vector(F.col(array_col)))


def rf_importances(
    df: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42, max_depth: int = 30
) -> DataFrame:
    """``(feature, importance)``: one row per column.  Missing values are imputed first, since
    the forest does not accept NaN."""
    packed = pack_features(df.select(label, *[f"`{c}`" for c in cols]), cols, "x")
    filled = ImputeMean.fit(packed, "x").transform(packed, "x").select(label, "x")
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=max_depth, seed=seed,
        featureSubsetStrategy="sqrt", cacheNodeIds=True,
    )
    fitted = forest.fit(_vector_column(filled, "x"))
    rows = list(zip(cols, (float(v) for v in fitted.featureImportances.toArray()), strict=True))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def select_by_mean(importances: DataFrame) -> DataFrame:
    """Features whose importance reaches the mean importance."""
    mean = importances.agg(F.avg("importance").alias("mean"))
    return importances.join(F.broadcast(mean), F.col("importance") >= F.col("mean")).select("feature", "importance")


@dataclass
class RidgeFit:
    alpha: float
    coefficients: list[float]
    kept: list[str]
    scores: dict[float, float]  # alpha -> mean R2 over folds


def moment_matrices(df: DataFrame, array_col: str, label: str, key: Column) -> dict[int, np.ndarray]:
    """Per key (a small integer), the sum of z zᵀ over its rows with z = (1, x, y), all in one Arrow
    pass: a task sends one matrix per key, whose size is the square of the number of features."""

    def part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        if not len(batch):
            return
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        z = np.column_stack([np.ones(len(batch)), x, batch.column(2).to_numpy(zero_copy_only=False)])
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for k in np.unique(keys):
            own = z[keys == k]
            yield int(k), (own.T @ own).ravel()

    rows = df.select(key.cast("int"), F.col(array_col).cast("array<double>"), F.col(label).cast("double"))
    sums = keyed_sums(rows, part, df.rdd.getNumPartitions())
    return {k: m.reshape(int(len(m) ** 0.5), -1) for k, m in sorted(sums.items())}


def _ridge_from_gram(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the centred ridge problem, from the moment matrix."""
    n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
    xx = g[1:-1, 1:-1] - np.outer(sx, sx) / n
    xy = g[1:-1, -1] - sx * sy / n
    w = np.linalg.solve(xx + alpha * np.eye(len(sx)), xy)
    return float(sy / n - sx @ w / n), w


def _r2(g: np.ndarray, intercept: float, w: np.ndarray) -> float:
    beta = np.concatenate([[intercept], w, [-1.0]])
    residual = float(beta @ g @ beta)
    total = float(g[-1, -1] - g[0, -1] ** 2 / g[0, 0])
    return 1.0 - residual / total if total > 0 else 0.0


def ridge_select(
    df: DataFrame,
    cols: Sequence[str],
    array_col: str = "x",
    label: str = "label",
    alphas: Sequence[float] = ALPHAS,
    folds: int = 5,
    seed: int = 42,
    drop_share: float = 25.0,
) -> RidgeFit:
    """Ridge with the penalty chosen by cross-validated R2; keeps the features whose |coefficient|
    is above the 25th percentile.

    The data is read once, whatever the number of folds and penalties: every fit and every score
    follows from the folds' moment matrices.  Folds are made by hash, as rows have no order."""
    fold = F.pmod(hash_key(F.col("doc_id"), seed), F.lit(folds))
    grams = list(moment_matrices(df, array_col, label, fold).values())
    total = sum(grams)
    scores = {}
    for alpha in alphas:
        fits = [(g, *_ridge_from_gram(total - g, alpha)) for g in grams]
        scores[float(alpha)] = float(np.mean([_r2(g, b, w) for g, b, w in fits]))
    best = max(scores, key=lambda a: (scores[a], -a))
    _, w = _ridge_from_gram(total, best)
    cut = np.percentile(np.abs(w), drop_share)
    kept = [c for c, v in zip(cols, np.abs(w), strict=True) if v > cut]
    return RidgeFit(best, [float(v) for v in w], kept, scores)


@dataclass
class Selection:
    importances: DataFrame
    forest_kept: list[str]
    ridge: RidgeFit
    scaler: StandardizeBlock
    imputer: ImputeMean

    def scaled(self, df: DataFrame) -> DataFrame:
        """``x``: the forest-kept columns, scaled and imputed with the training statistics."""
        packed = pack_features(df, self.forest_kept, "x")
        return self.imputer.transform(self.scaler.transform(packed, "x"), "x")

    def final(self, df: DataFrame) -> DataFrame:
        """``x`` reduced to the features that ridge kept."""
        at = [self.forest_kept.index(c) for c in self.ridge.kept]
        return self.scaled(df).withColumn("x", F.array(*[F.get("x", F.lit(i)) for i in at]))


def select_features(
    train: DataFrame, cols: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42, max_depth: int = 30
) -> Selection:
    importances = rf_importances(train, cols, label, trees, seed, max_depth)
    listed = {r["feature"] for r in select_by_mean(importances).collect()}
    kept = [c for c in cols if c in listed]
    packed = pack_features(train, kept, "x")
    scaler = StandardizeBlock.fit(packed, "x")
    scaled = scaler.transform(packed, "x")
    imputer = ImputeMean.fit(scaled, "x")
    ridge = ridge_select(imputer.transform(scaled, "x"), kept, "x", label, seed=seed)
    return Selection(importances, kept, ridge, scaler, imputer)


def selection_report(importances: DataFrame, selected: DataFrame) -> DataFrame:
    """Kept features with display names, most important first."""
    kept = rename_values(selected_importances(importances, selected), "feature", DISPLAY_NAMES)
    return rank_features(kept)


def selected_table(df: DataFrame, meta_cols: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Metadata and the raw (unscaled) selected columns."""
    return df.select(*meta_cols, *[f"`{c}`" for c in kept])


def selection_accuracy(selection: Selection, train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Scores of a logistic regression on the final features, fitted on train, measured on test."""
    x_train = _vector_column(selection.final(train), "x").select("features", label)
    x_test = _vector_column(selection.final(test), "x").select("features", label)
    n = x_train.count()
    model = LogisticRegression(labelCol=label, maxIter=1000, regParam=1.0 / max(n, 1), standardization=False).fit(x_train)
    preds = model.transform(x_test).withColumn("predicted_label", F.col("prediction").cast("int"))
    return macro_scores(confusion_matrix(preds, label))


def ridge_table(spark: SparkSession, fit: RidgeFit, cols: Sequence[str]) -> DataFrame:
    rows = [(c, v, c in fit.kept) for c, v in zip(cols, fit.coefficients, strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, kept boolean")
