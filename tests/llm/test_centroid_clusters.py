import hashlib
import math
import random

import numpy as np
import pytest

from penmark.llm import centroid_clusters as op
from penmark.llm.queries import op13_centroid_clusters

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, dimensions=64, clusters=8, rounds=10):
    """Lloyd rounds on Python integers: {(id, vector): (cluster, distance)} and the centroids."""
    good = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(good, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in good]
        for k in range(len(centers)):
            own = [v for (_, v), c in zip(good, of, strict=True) if c == k]
            if own:
                centers[k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    near = [nearest(v) for _, v in good]
    total = sum(d for d, _ in near)
    out = []
    for (i, _), (d, k) in zip(good, near, strict=True):
        digest = hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()
        out.append((i, k, d, sum(e for e, c in near if c == k), total, digest))
    return sorted(out, key=str)


def vectors(seed=3, n=90):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) + (i % 5) for _ in range(64)]) for i in range(n)]
    rows += [(1000 + i, [float(round(x)) for x in rows[i % 4][1]]) for i in range(60)]  # copies, ties
    return rows


def through_query(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in op13_centroid_clusters(spark, str(tmp_path)).collect()), key=str)


def test_query_equals_plain_version(spark, tmp_path):
    rows = vectors()
    odd = [(None, [0.5] * 64), (5, None), (6, []), (7, [1.0] * 63), (8, [1.0] * 63 + [None]), (9, [math.nan] + [1.0] * 63), (10, [math.inf] + [1.0] * 63)]
    odd += [rows[0], rows[0], (0, [-0.25] * 64)]  # repeated rows, one id with two vectors
    assert through_query(spark, tmp_path, rows + odd) == plain(rows + odd)


def test_few_vectors_and_empty_table(spark, tmp_path):
    rows = vectors()[:3]
    assert through_query(spark, f"{tmp_path}/few", rows) == plain(rows)
    assert through_query(spark, f"{tmp_path}/none", []) == []


def test_equal_vectors_leave_centroids_empty(spark, tmp_path):
    rows = [(i, [0.125] * 64) for i in range(40)]
    assert through_query(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("kind", ["copies", "coarse", "random"])
def test_dictionaries_lose_nothing(kind):
    rng = np.random.default_rng(5)
    whole = rng.integers(-4000, 4000, (3000, 64))
    whole = {"copies": np.tile(whole[:3], (1000, 1)), "coarse": whole % 3, "random": whole}[kind].astype(np.int32)
    blocks = op.unpack(op.pack(op.encode(whole)))
    assert np.array_equal(np.concatenate([t[c] for t, c in blocks], axis=1), whole)
    assert {t.shape[1] for t, _ in blocks} == {{"copies": 8, "coarse": 4, "random": 8}[kind]}
    centers = whole[:8].astype(np.int64)
    near, gap = op.assign(blocks, centers)
    every = ((whole[:, None, :].astype(np.int64) - centers[None]) ** 2).sum(axis=2)
    assert np.array_equal(near, every.argmin(axis=1)) and np.array_equal(gap, every.min(axis=1))
    want = [whole[near == k].sum(axis=0) for k in range(8)]
    assert np.array_equal(op.sums(blocks, near, 8), np.array(want))


def test_extra_columns_and_size_limit(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64, 0) for i in range(9)], VECTORS).selectExpr("*", "1 as whole", "2 as ids", "3 as cluster")
    assert df.count() == op.cluster_vectors(df).count()
    with pytest.raises(Exception, match="64 bits"):
        op.cluster_vectors(spark.createDataFrame([(1, [3e38] * 64, 0)], VECTORS)).count()
