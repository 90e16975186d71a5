import hashlib
import random
from collections import Counter, defaultdict

import duckdb
from llm.helpers import ODD, docs_frame, sentence, words
from oracle import compare

from penmark.llm import line_dedup as op
from penmark.llm import sql
from penmark.llm.queries import op2_line_dedup

SETTINGS = {"min_docs": 4, "support": 4, "min_constant": 0.7}


def plain(rows, min_docs, support, min_constant):
    """Line numbers that each distinct (id, text) loses."""
    parsed = {}
    for row in set(rows):
        for at, line in enumerate((row[1] or "").split("\n")):
            tokens = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in words(line))
            if tokens:
                parsed[row, at] = tokens
    copies = Counter(rows)
    leaf_docs = Counter()
    for row in copies:
        for leaf in {(len(t), t[:3]) for (r, _), t in parsed.items() if r == row}:
            leaf_docs[leaf] += copies[row]
    lines = Counter()
    for (row, _), t in parsed.items():
        if leaf_docs[len(t), t[:3]] >= min_docs:
            lines[t] += copies[row]
    places = Counter()
    for t, n in lines.items():
        for i, w in enumerate(t):
            places[len(t), t[:3], i, w] += n
    kinds = Counter((len(t), t[:3]) for t in lines)
    form = {}
    for t in lines:
        made = tuple(w if i < 3 or places[len(t), t[:3], i, w] >= support else "<*>" for i, w in enumerate(t))
        good = sum(w != "<*>" for w in made) >= min_constant * len(t)
        form[t] = made if kinds[len(t), t[:3]] > 1 and good else t
    def form_of(row, at, t):
        firm = sum(w != "<*>" for w in t)
        if firm < 2 and 3 * firm <= len(t):
            return ("as it is", *words(row[1].split("\n")[at]))
        return form[t]

    docs = Counter()
    for row, f in {(row, form_of(row, at, t)) for (row, at), t in parsed.items() if t in form}:
        docs[f] += 1
    gone = defaultdict(set)
    for (row, at), t in parsed.items():
        if t in form and docs[form_of(row, at, t)] >= min_docs:
            gone[row].add(at)
    return gone


def expected(rows, **settings):
    gone = plain(rows, **settings or SETTINGS)
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        kept = "\n".join(line for at, line in enumerate(lines) if at not in gone[row])
        out.append((row[0], len(lines), len(gone[row]), kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(80):
        lines = [sentence(rng, rng.randrange(1, 12), 40) for _ in range(rng.randrange(1, 6))]
        if i % 2:
            lines.insert(0, f"Copyright by the {2000 + i} authors of {rng.choice(['alpha', 'beta', f'name{i}', 'odd'])} and friends")
        if i % 3 == 0:
            lines.append(f"Please share this page with {rng.choice('abcdefghijklmnopqrstuvwxyz')} now or later today")
        rows.append((i, "\n".join(lines)))
    return rows


def run(df):
    return sorted(map(tuple, op.drop_templates(df, **SETTINGS).collect()), key=str)


def test_equals_plain_version(spark):
    rows = corpus() + ODD + [(200, corpus()[1][1]), (200, corpus()[1][1])]
    assert run(docs_frame(spark, rows)) == expected(rows)


def test_templates_with_fields_are_dropped_and_other_lines_stay(spark):
    rows = corpus()
    kept = {r[0]: r[3] for r in run(docs_frame(spark, rows))}
    assert not any("Copyright" in t for t in kept.values())
    assert not any("Please share" in t for t in kept.values())
    assert sum(len(t) for t in kept.values()) > 0


def test_empty_table_columns_and_plan(spark):
    assert run(docs_frame(spark, [])) == []
    clash = docs_frame(spark, corpus()).selectExpr("*", "1 as lines", "2 as gone", "3 as leaf", "4 as at")
    df = op.drop_templates(clash, **SETTINGS)
    assert sorted(map(tuple, df.collect()), key=str) == expected(corpus())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def short_lines():
    """Lines of few words: numbers, stamps, short templates, exact copies, and ordinary text."""
    rng = random.Random(4)
    rows = []
    for i in range(24):
        lines = [
            f"own{'abcdefghijklmnopqrstuvwxyz'[i]}",
            f"{i} {i + 7}.5 {3 * i}",
            "1 2 3",
            f"2024-01-{i:02d} {i}:30 INFO",
            f"Page {i} of 40",
            f"Posted on 2024-01-{i} at 10:{i}",
            f"Page {i}",
            "Read more",
            "",
            f"{100 + i}",
            sentence(rng, rng.randrange(1, 9), 30),
        ]
        rows.append((i, "\n".join(lines + ["Rarely"] * (i < 9))))
    return rows


DEFAULTS = {"min_docs": 10, "support": 10, "min_constant": 0.7}


def test_short_templates_generalise_and_numeric_rows_stay(spark):
    got = {r["doc_id"]: r["kept_text"].split("\n") for r in op.drop_templates(docs_frame(spark, short_lines())).collect()}
    for i, lines in got.items():
        assert lines[:3] == [f"own{'abcdefghijklmnopqrstuvwxyz'[i]}", f"{i} {i + 7}.5 {3 * i}", f"2024-01-{i:02d} {i}:30 INFO"]
        assert f"{100 + i}" in lines and ("Rarely" in lines) == (i < 9)
        assert not any(x in lines for x in ("1 2 3", f"Page {i} of 40", f"Posted on 2024-01-{i} at 10:{i}", f"Page {i}", "Read more"))


def test_query_equals_plain_version_and_check_sql(spark, tmp_path):
    rows = corpus() + [(300 + i, t) for i, t in short_lines()] + [r for r in ODD if r != (4, "word")]
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_line_dedup(spark, str(tmp_path)).toPandas()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in expected(rows, **DEFAULTS)]
    key = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    found = [(None if d != d else int(d), *rest) for d, *rest in got[key].itertuples(index=False, name=None)]
    assert sorted(found, key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(got, con.sql(sql.line_dedup_sql()).df()) == ""
