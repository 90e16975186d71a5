"""Sums of arrays over a table in one Arrow pass: every task adds up its own part per key, and what tasks
send is added in levels, so that neither the driver nor one task gets an array from every task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So many tasks' sums are added by one.
FAN = 256
SUMS = "key int, slot int, total binary"


def _rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    slot = TaskContext.get().partitionId()
    for key, total in totals.items():
        arrays = [pa.array([key], pa.int32()), pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "slot", "total"])


def _add(totals: dict[int, np.ndarray], key: int, got: np.ndarray) -> None:
    if key in totals:
        totals[key] += got
    else:
        totals[key] = np.array(got, np.float64)


def keyed_sums(df: DataFrame, part: Callable[[pa.RecordBatch], Iterable[tuple[int, np.ndarray]]], tasks: int, many_keys: bool = False) -> dict[int, np.ndarray]:
    """Per key, the sum of the flat arrays that ``part`` makes of the batches of ``df``.

    ``tasks``: about as many as the partitions of ``df``.  With ``many_keys`` (slices of one large
    array) the keys are dealt out and added in parallel at once."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, got in part(batch):
                _add(totals, key, got)
        yield from _rows(totals)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                _add(totals, key, np.frombuffer(raw))
        yield from _rows(totals)

    sums = df.mapInArrow(first, SUMS)
    if many_keys:
        sums = sums.repartition("key").mapInArrow(again, SUMS)
    else:
        while tasks > FAN:
            tasks = math.ceil(tasks / FAN)
            sums = sums.repartition(tasks, F.col("slot") % tasks).mapInArrow(again, SUMS)
    totals: dict[int, np.ndarray] = {}
    for r in sums.collect():
        _add(totals, r["key"], np.frombuffer(r["total"]))
    return totals
