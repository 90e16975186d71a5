"""Access to the input tables for the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.physical import spread_small
from penmark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))


def labelled(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """Documents that have a label, as ``(doc_id, text, label)``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread_small(docs.join(labels, "doc_id"), source=docs)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals and integers to bigint, for value-by-value comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
