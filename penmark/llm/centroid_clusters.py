"""Exact centroid clustering of vectors through subvector dictionaries.

Style: NumPy on Arrow batches inside tasks; Spark scans, sums and joins.

Components become integers ``floor(SCALE * x)``, so every distance and every mean is exact.  Vectors are
encoded once, in chunks: the dimensions are cut into blocks, and each block of a chunk becomes a
dictionary of its distinct subvectors plus one code per vector, without loss.  The block width of a
chunk is the one of ``WIDTHS`` that needs the fewest operations a round, from its own distinct counts:
wide where subvectors repeat (copies, quantised data), narrow where only single components do.

A round sends the centroids to the tasks (clusters x dimensions integers).  A task computes the squared
distance of each *distinct* subvector to each centroid's block once, and a vector's distance is the sum
of its blocks' table entries.  New centroids need only how often each code fell to each cluster: sums
are counts times dictionary.  A task sends one row per cluster and dimension, whatever it read; the
driver holds the centroids and nothing else.

Limits: integers must stay below 2^27 in size (a distance then always fits a long); a larger component
raises an error.  Vectors of another length, with a null or a non-finite component, and null vectors are
left out.  A null id is kept and hashes as the empty text.  Equal rows are separate vectors; vectors that
share an id start in the order of their components.  With fewer vectors than clusters there are fewer
clusters.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import Store

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
START = "3"
WIDTHS = (8, 4, 2, 1)
VECTORS_AT_ONCE = 32_768
LIMIT = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """``vec_id, whole``: usable vectors as integers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(v.isNotNull() & (F.size(v) == dimensions)).where(finite)
    return usable.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("whole"))


def dictionaries(whole: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block of ``width`` dimensions: distinct subvectors (rows) and the code of every vector."""
    out = []
    for at in range(0, whole.shape[1], width):
        part = np.ascontiguousarray(whole[:, at : at + width])
        rows = part.view([("", part.dtype)] * part.shape[1]).ravel()
        distinct, codes = np.unique(rows, return_inverse=True)
        out.append((distinct.view(part.dtype).reshape(-1, part.shape[1]), codes.astype(np.int32).ravel()))
    return out


def encode(whole: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The dictionaries of the block width that makes a round cheapest."""
    made = [dictionaries(whole, w) for w in WIDTHS if w <= whole.shape[1]]
    return min(made, key=lambda blocks: sum(table.size + len(codes) for table, codes in blocks))


def pack(blocks: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    return {
        "widths": [t.shape[1] for t, _ in blocks],
        "sizes": [len(t) for t, _ in blocks],
        "tables": b"".join(t.astype(np.int32).tobytes() for t, _ in blocks),
        "codes": b"".join(c.tobytes() for _, c in blocks),
    }


def unpack(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    tables, codes = np.frombuffer(row["tables"], np.int32), np.frombuffer(row["codes"], np.int32)
    n, at, out = len(codes) // len(row["sizes"]), 0, []
    for i, (width, size) in enumerate(zip(row["widths"], row["sizes"], strict=True)):
        table = tables[at : at + size * width].reshape(size, width).astype(np.int64)
        out.append((table, codes[i * n : (i + 1) * n]))
        at += size * width
    return out


def assign(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector (the smaller number on ties) and the squared distance to it."""
    total, at = np.zeros((len(blocks[0][1]), len(centroids)), np.int64), 0
    for table, codes in blocks:
        width = table.shape[1]
        gap = table[:, None, :] - centroids[None, :, at : at + width]
        total += (gap * gap).sum(axis=2)[codes]
        at += width
    near = total.argmin(axis=1)
    return near, total[np.arange(len(near)), near]


def sums(blocks: list[tuple[np.ndarray, np.ndarray]], near: np.ndarray, clusters: int) -> np.ndarray:
    """Componentwise sums of every cluster's vectors, from the counts of codes per cluster."""
    parts = []
    for table, codes in blocks:
        times = np.bincount(codes.astype(np.int64) * clusters + near, minlength=len(table) * clusters)
        parts.append(times.reshape(-1, clusters).T @ table)
    return np.concatenate(parts, axis=1)


def encoded(whole: DataFrame, store: Store) -> DataFrame:
    """Stored chunks: ``ids`` and the dictionaries of their vectors."""
    id_type = whole.schema["vec_id"].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("widths", T.ArrayType(T.IntegerType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("tables", T.BinaryType()),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def chunk(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        packed = pack(encode(np.concatenate(rows)))
        flat = pa.concat_arrays(ids)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
        columns += [pa.array([packed[k]], pa.list_(pa.int32())) for k in ("widths", "sizes")]
        columns += [pa.array([packed[k]], pa.binary()) for k in ("tables", "codes")]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            if np.abs(part).max() >= LIMIT:
                raise ValueError(f"a component times {SCALE} reaches {LIMIT}: distances may pass 64 bits")
            ids.append(batch.column(0))
            rows.append(part.astype(np.int32))
            held += len(part)
            if held >= VECTORS_AT_ONCE:
                yield chunk(ids, rows)
                ids, rows, held = [], [], 0
        if held:
            yield chunk(ids, rows)

    return store.put(whole.mapInArrow(run, schema), "encoded")


def first_centroids(whole: DataFrame, clusters: int, start: str) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{start}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("digest"), "whole").orderBy("digest", "whole").limit(clusters).collect()
    return np.array([r["whole"] for r in rows], np.int64)


def next_centroids(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the cluster means; an empty cluster keeps its centroid."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                blocks = unpack(row)
                near, _ = assign(blocks, centroids)
                total += sums(blocks, near, k)
                count += np.bincount(near, minlength=k)
        at = np.flatnonzero(np.repeat(count, d))
        columns = [at, np.repeat(count, d)[at], total.ravel()[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "n", "total"])

    parts = chunks.drop("ids").mapInArrow(run, "at bigint, n bigint, total bigint")
    big = T.DecimalType(38, 0)
    made = parts.groupBy("at").agg(F.sum(F.col("n").cast(big)).alias("n"), F.sum(F.col("total").cast(big)).alias("total"))
    out = centroids.copy()
    for row in made.collect():  # clusters x dimensions rows
        out[row["at"] // d, row["at"] % d] = int(row["total"]) // int(row["n"])
    return out


def assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    id_type = chunks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                near, gap = assign(unpack(row), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(near, pa.int32()), pa.array(gap, pa.int64())], names=schema.names)

    return chunks.mapInArrow(run, schema)


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    start: str = START,
) -> DataFrame:
    """One row per usable vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid``
    (the final centroid as an array of integers)."""
    spark = vectors.sparkSession
    store = Store(spark, "clusters")
    whole = whole_vectors(vectors, id_col, vector_col, dimensions)
    centroids = first_centroids(whole, clusters, start)
    if not len(centroids):
        zero = F.lit(0).cast("bigint")
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[zero.alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("whole").alias("centroid"))
    chunks = encoded(whole, store)
    for _ in range(rounds):
        centroids = next_centroids(chunks, centroids)
    rows = store.put(assigned(chunks, centroids), "assigned")
    store.drop("encoded")
    big = T.DecimalType(38, 0)
    per = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast(big)).alias("d")).collect()}
    total = sum(per.values())
    table = [(k, per.get(k, 0), total, [int(x) for x in c]) for k, c in enumerate(centroids)]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

