"""Feature blocks: scale, impute, build on train and apply to both splits, concatenate."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.operators.partial_sums import keyed_sums
from penmark.operators.reshape import pad_vectors, parse_vector_column, vector_width
from penmark.operators.svd import SvdModel, svd_reduce
from penmark.operators.tfidf import TfidfModel, fit_tfidf
from penmark.session import materialize

# The order of blocks in a feature vector.
BLOCK_ORDER = ["style", "feat", "pplx", "tfidf"]


Stats = list[tuple[int, float | None, float | None]]


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, Stats]:
    """Per vector column, (position, mean, population deviation), NaN and null skipped, of all columns in
    one Arrow pass.  Sums are taken around the first row's values, so large offsets cost no digits."""
    arrays = df.select(*[F.col(c).cast("array<double>").alias(c) for c in cols])
    first = arrays.first()
    if first is None:
        return {c: [] for c in cols}
    widths = {c: r for c, r in arrays.agg(*[F.max(F.size(c)).alias(c) for c in cols]).first().asDict().items()}
    pivots = {}
    for c in cols:
        start = [0.0 if x is None or math.isnan(x) else x for x in first[c] or []]
        pivots[c] = np.array(start + [0.0] * (widths[c] - len(start)))

    def part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for i, c in enumerate(cols):
            column, width = batch.column(i), len(pivots[c])
            lengths = np.array(column.value_lengths().fill_null(0), np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            there = ~np.isnan(values)
            place, gap = place[there], values[there] - pivots[c][place[there]]
            yield i, np.concatenate([np.bincount(place, weights=w, minlength=width) for w in (None, gap, gap * gap)])

    sums = keyed_sums(arrays, part, arrays.rdd.getNumPartitions())
    out: dict[str, Stats] = {}
    for i, c in enumerate(cols):
        n, total, square = sums[i].reshape(3, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean, spread = total / n, np.sqrt(np.maximum(0.0, square / n - (total / n) ** 2))
        # What rounding leaves of a constant column is no deviation.
        spread[spread <= 1e-9 * np.abs(mean)] = 0.0
        out[c] = [(p, float(pivots[c][p] + mean[p]) if n[p] else None, float(spread[p]) if n[p] else None) for p in range(len(n))]
    return out


def constants(values: list[float]) -> Column:
    """Array literal; folded to a constant before execution."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


@dataclass
class StandardizeBlock:
    """(x - mean) / population deviation per position; a constant position is only centred."""

    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> StandardizeBlock:
        return cls.from_stats(column_stats(df, [col])[col])

    @classmethod
    def from_stats(cls, listed: Stats) -> StandardizeBlock:
        stats = {p: (m, s) for p, m, s in listed}
        width = max(stats, default=-1) + 1
        mean = [stats.get(i, (0.0, 1.0))[0] or 0.0 for i in range(width)]
        std = [stats.get(i, (0.0, 1.0))[1] or 1.0 for i in range(width)]
        return cls(mean, std)

    def transform(self, df: DataFrame, col: str) -> DataFrame:
        centred = F.zip_with(F.col(col).cast("array<double>"), constants(self.mean), lambda x, m: x - m)
        return df.withColumn(col, F.zip_with(centred, constants(self.std), lambda x, s: x / s))


@dataclass
class ImputeMean:
    """Replace NaN and null by the position's training mean (0 for a position never seen)."""

    mean: list[float]

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> ImputeMean:
        stats = {p: m for p, m, _ in column_stats(df, [col])[col]}
        return cls([stats.get(i) or 0.0 for i in range(max(stats, default=-1) + 1)])

    def transform(self, df: DataFrame, col: str) -> DataFrame:
        filled = F.zip_with(
            F.col(col).cast("array<double>"),
            constants(self.mean),
            lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x),
        )
        return df.withColumn(col, filled)


@dataclass
class BlockModel:
    """Everything fitted on the training split: one scaler and one imputer per block."""

    tfidf: TfidfModel | None
    svd: SvdModel | None
    widths: dict[str, int]
    scalers: dict[str, StandardizeBlock] = field(default_factory=dict)
    imputers: dict[str, ImputeMean] = field(default_factory=dict)

    def raw(self, df: DataFrame, text: str) -> DataFrame:
        """Unscaled blocks: vectors parsed and padded to the training width, TF-IDF projected."""
        if self.tfidf is not None:
            keep = [c for c in df.columns if c not in ("doc_id", text)]
            df = self.svd.transform(self.tfidf.transform(df, text, keep=keep))
        for block, width in self.widths.items():
            df = pad_vectors(parse_vector_column(df, block), block, width)
        return df

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        return self.scaled(self.raw(df, text))

    def scaled(self, raw: DataFrame) -> DataFrame:
        out = raw
        for block, scaler in self.scalers.items():
            out = self.imputers[block].transform(scaler.transform(out, block), block)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        if self.tfidf is not None:
            self.tfidf.save(spark, f"{path}/tfidf")
            self.svd.save(spark, f"{path}/svd")
        rows = [
            (b, self.widths.get(b), s.mean, s.std, self.imputers[b].mean) for b, s in self.scalers.items()
        ]
        schema = "block string, width int, mean array<double>, std array<double>, fill array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/scalers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockModel:
        rows = spark.read.parquet(f"{path}/scalers").collect()
        has_text = any(r["block"] == "tfidf" for r in rows)
        return cls(
            TfidfModel.load(spark, f"{path}/tfidf") if has_text else None,
            SvdModel.load(spark, f"{path}/svd") if has_text else None,
            {r["block"]: r["width"] for r in rows if r["width"] is not None},
            {r["block"]: StandardizeBlock(list(r["mean"]), list(r["std"])) for r in rows},
            {r["block"]: ImputeMean(list(r["fill"])) for r in rows},
        )


def _fit(
    train: DataFrame, text: str | None, max_features: int, svd_components: int, min_df: int
) -> tuple[BlockModel, DataFrame]:
    """The fitted model and the stored, unscaled training blocks."""
    given = [b for b in BLOCK_ORDER[:3] if b in train.columns]
    widths = {b: vector_width(parse_vector_column(train.select(b), b), b) for b in given}
    tfidf = svd = None
    if text is not None:
        tfidf = fit_tfidf(train.select("doc_id", text), text, max_features=max_features, min_df=min_df)
        vectors = materialize(tfidf.transform(train.select("doc_id", text), text))
        svd = svd_reduce(vectors, k=svd_components)
    model = BlockModel(tfidf, svd, widths)
    raw = materialize(model.raw(train, text or "text"))
    blocks = given + (["tfidf"] if text is not None else [])
    stats = column_stats(raw, blocks)
    for block in blocks:
        scaler = StandardizeBlock.from_stats(stats[block])
        model.scalers[block] = scaler
        # The mean of a standardised position is 0, so that is what fills its gaps.
        model.imputers[block] = ImputeMean([0.0] * len(scaler.mean))
    return model, raw


def fit_blocks(
    train: DataFrame,
    text: str | None = "text",
    max_features: int = 3000,
    svd_components: int = 300,
    min_df: int = 2,
) -> BlockModel:
    """Fit TF-IDF, SVD, scalers and imputers on the training rows only.

    ``train`` has ``doc_id``, the text, and any of the columns ``style``, ``feat``, ``pplx``
    (arrays, numbers, or text holding them).  ``text=None`` builds no TF-IDF block."""
    return _fit(train, text, max_features, svd_components, min_df)[0]


def build_blocks(
    train: DataFrame,
    test: DataFrame,
    text: str | None = "text",
    max_features: int = 3000,
    svd_components: int = 300,
    min_df: int = 2,
) -> tuple[DataFrame, DataFrame, BlockModel]:
    """(train blocks, test blocks, fitted model)."""
    model, raw = _fit(train, text, max_features, svd_components, min_df)
    return model.scaled(raw), model.transform(test, text or "text"), model


def concat_blocks(df: DataFrame, flags: Mapping[str, bool], into: str = "features") -> DataFrame:
    """Chosen blocks side by side as one ML vector, always in the order style, feat, pplx, tfidf."""
    chosen = [b for b in BLOCK_ORDER if flags.get(b, False)]
    if not chosen:
        raise ValueError("no block is chosen")
    return df.withColumn(into, array_to_vector(F.concat(*[F.col(b).cast("array<double>") for b in chosen])))
