import random

import numpy as np
import pytest
import xxhash
from llm.helpers import ODD, docs_frame, sentence, words
from penmark.llm import simhash_dedup as op
from penmark.llm.common import Store


def plain_fingerprint(text):
    tokens = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in distinct}


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True)), key=str)


def run(spark, rows, **kw):
    return result(docs_frame(spark, rows), **kw)


def result(df, **kw):
    groups = op.simhash_groups(df, **kw).select("doc_id", "fingerprint", "component_id")
    return sorted(map(tuple, groups.collect()), key=str)


def varied(seed, n):
    rng = random.Random(seed)
    base = [sentence(rng, 120) for _ in range(5)]
    rows = []
    for i in range(n):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = f"X{rng.randrange(99)}"
        rows.append((i, " ".join(text) if i % 4 else sentence(rng, 30)))
    return rows


@pytest.mark.parametrize("max_group", [1 << 16, 40])
def test_equals_brute_force(spark, max_group):
    rows = varied(1, 300)
    assert run(spark, rows, max_group=max_group) == expected(rows)


def test_odd_rows(spark):
    assert run(spark, ODD) == expected(ODD)


def test_empty_table_and_extra_columns(spark):
    df = docs_frame(spark, [])
    assert op.simhash_groups(df).count() == 0
    clash = docs_frame(spark, ODD).selectExpr("*", "1 as fp", "2 as u", "3 as component_id", "4 as mask")
    assert result(clash) == expected(ODD)


def test_index_links_what_pairs_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fp = base[rng.integers(0, 6, 900)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fp = np.unique(fp)
    fp = fp[np.argsort(op.gray_rank(fp))]
    label = op.local_links(fp, np.array([0]), pairs_at_once=5000)
    root = plain_components([int(x) for x in fp])
    groups = {}
    for x, of in zip(fp, label, strict=True):
        groups.setdefault(int(of), set()).add(root[int(x)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))


def test_routing_keeps_pairs_together_and_bounds_groups(spark):
    rng = random.Random(5)
    fps = {0x123456789ABCDEF0 ^ (rng.randrange(1 << 14)) for _ in range(700)}
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, rank bigint")
    store = Store(spark, "routing")
    rows = op.routed(df, store, 64).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["mask"], r["pattern"]), set()).add(r["fp"])
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert near <= met
    assert max(map(len, groups.values())) <= 64 or all(bin(m & (1 << 64) - 1).count("1") >= 49 for m, _ in groups)


def test_one_row_per_group_stays(spark):
    rows = varied(2, 200) + ODD
    kept = [tuple(r)[:2] for r in op.keep_one_per_group(docs_frame(spark, rows)).collect()]
    groups = {}
    for row, of in zip(rows, rows_root(rows), strict=True):
        groups.setdefault(of, []).append(row)
    assert len(kept) == len(groups)
    for members in groups.values():
        found = [k for k in kept if k in members]
        assert len(found) >= 1
        assert found[0][0] == min((i for i, _ in members if i is not None), default=None)


def rows_root(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    return [root[f] for f in fps]
