from llm.helpers import ODD, docs_frame
from penmark.llm import sharding as op


def plain_table(names, size):
    order = {n: [(op._number(n, "offset") + j * (op._number(n, "step") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    owner, turn = {}, 0
    while len(owner) < size:
        name = names[turn % len(names)]
        owner[next(s for s in order[name] if s not in owner)] = turn % len(names)
        turn += 1
    return [owner[s] for s in range(size)]


def test_table_equals_plain_version():
    for shards in (1, 2, 7):
        names, size = op.shard_names(shards), op.next_prime(31)
        assert op.fill_table(names, size) == plain_table(names, size)


def test_shares_are_even_and_stable():
    size = op.next_prime(op.SLOTS_PER_SHARD * 64)
    table = op.fill_table(op.shard_names(64), size)
    counts = [table.count(i) for i in range(64)]
    assert max(counts) - min(counts) <= 1
    less = op.fill_table(op.shard_names(63), size)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 63)
    assert moved < 0.1 * size


def test_placement(spark, tmp_path):
    df = docs_frame(spark, [*ODD, *((i, f"t{i}") for i in range(500))]).selectExpr("*", "1 as shard", "2 as slot")
    rows = op.place(df).collect()
    assert len(rows) == len(ODD) + 500
    table = op.fill_table(op.shard_names(op.SHARDS), op.next_prime(op.SLOTS_PER_SHARD * op.SHARDS))
    assert all(table[r["slot"]] == r["shard"] for r in rows)
    by_id = {}
    for r in rows:
        if r["doc_id"] is not None:
            assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert op.place(docs_frame(spark, [])).count() == 0
    op.write_shards(op.place(df), str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows)
    assert "Python" not in op.place(df)._jdf.queryExecution().executedPlan().toString()
