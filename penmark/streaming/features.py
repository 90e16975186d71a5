"""The linguistic record needs no state, so a stream of documents takes the batch projection as is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from penmark.functions.lexicon import CONNECTORS
from penmark.operators.features import linguistic_features


def write_feature_stream(
    documents: DataFrame, out: str, checkpoint: str, text: str = "text", connectors: Sequence[str] = tuple(CONNECTORS)
) -> StreamingQuery:
    """Features of all documents that are available now, appended as parquet exactly once."""
    features = linguistic_features(documents, text, connectors)
    return (
        features.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
