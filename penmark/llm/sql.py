"""Check SQL of the queries whose result SQL can express."""

from __future__ import annotations

from penmark.llm import decontaminate as D
from penmark.llm import line_dedup as L
from penmark.llm import quality_rules as R
from penmark.llm import sharding as S
from penmark.plans.sql import q

_WORD = r"'[^\x20\x09-\x0D]+'"


def line_dedup_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS raw, generate_subscripts(lines, 1) AS pos0 FROM d),
x AS (
  SELECT *, array_to_string(t, ' ') AS line, len(t) || ':' || array_to_string(t[1:{L.LEAD}], ' ') AS leaf,
    len(list_filter(t, lambda w: w <> {q(L.FIELD)})) AS words
  FROM (SELECT rid, pos0, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN {q(L.FIELD)} ELSE x END) AS t
        FROM (SELECT rid, pos0, regexp_extract_all(raw, {_WORD}) AS w FROM l)) WHERE len(t) > 0),
cl AS (SELECT leaf FROM x GROUP BY leaf HAVING count(DISTINCT rid) >= {L.MIN_DOCS}),
f AS (SELECT x.* FROM x JOIN cl USING (leaf)),
di AS (SELECT leaf, line, any_value(t) AS t, count(*) AS n FROM f GROUP BY leaf, line),
sv AS (SELECT leaf FROM di GROUP BY leaf HAVING count(*) > 1),
pl AS (SELECT leaf, line, n, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM di JOIN sv USING (leaf)),
fi AS (SELECT leaf, pos, word, true AS firm FROM pl WHERE pos > {L.LEAD} GROUP BY ALL HAVING sum(n) >= {L.SUPPORT}),
pt AS (SELECT line, pos, CASE WHEN pos <= {L.LEAD} OR firm THEN word ELSE {q(L.FIELD)} END AS word FROM pl LEFT JOIN fi USING (leaf, pos, word)),
tm AS (SELECT line, string_agg(word, ' ' ORDER BY pos) AS form, count(*) FILTER (WHERE word <> {q(L.FIELD)}) AS firm, count(*) AS n FROM pt GROUP BY line),
fm AS (SELECT rid, pos0, CASE WHEN words < 2 AND 3 * words <= len(t) THEN chr(10) || array_to_string(w, ' ') WHEN firm >= {L.MIN_CONSTANT}::double * places THEN form ELSE line END AS form
  FROM f LEFT JOIN (SELECT line, form, firm, n AS places FROM tm) tm USING (line)),
rc AS (SELECT form FROM fm GROUP BY form HAVING count(DISTINCT rid) >= {L.MIN_DOCS}),
gn AS (SELECT rid, pos0, true AS gone FROM fm JOIN rc USING (form)),
kp AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(raw, chr(10) ORDER BY pos0) FILTER (WHERE gone IS NULL) AS kept
  FROM l LEFT JOIN gn USING (rid, pos0) GROUP BY rid)
SELECT doc_id, len(lines)::bigint AS n_lines, n_dropped::bigint AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN kp USING (rid)"""


def quality_rules_sql() -> str:
    grid = ", ".join(f"({q(rule)}, {c}::double)" for rule, cs in R.RULES.items() for c in cs)
    risk = R.RISK
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS lines FROM d),
ws AS (SELECT rid, list_transform(range(1, len(w) - {R.WINDOW - 2}), lambda i: array_to_string(w[i:i + {R.WINDOW - 1}], ' ')) AS win FROM w),
p AS (SELECT rid, unnest(win) AS x, generate_subscripts(win, 1) AS i FROM ws),
tw AS (SELECT rid, x FROM p GROUP BY ALL HAVING count(*) > 1),
st AS (SELECT rid, least({R.WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {R.WINDOW})) AS n FROM p JOIN tw USING (rid, x)),
rp AS (SELECT rid, sum(n)::bigint AS n_repeat_words FROM st GROUP BY rid),
b AS (
  SELECT rid, doc_id, stratum, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '!')) AS bangs,
    len(regexp_extract_all(text, '\\p{{Lu}}')) AS uppers, len(w) - len(list_distinct(w)) AS same
  FROM w LEFT JOIN rp USING (rid)),
s AS (
  SELECT *, n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(n_symbols::double / nullif(word_chars, 0), 0) AS symbol_share, coalesce(bangs::double / nullif(n_words, 0), 0) AS bang_share,
    coalesce(uppers::double / nullif(word_chars, 0), 0) AS upper_share, coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) AS dup_line_share,
    coalesce(same::double / nullif(n_words, 0), 0) AS sameness FROM b),
v AS (SELECT rid, doc_id, stratum, base_failed, unnest([{", ".join(q(r) for r in R.RULES)}]) AS rule, unnest([{", ".join(R.RULES)}]) AS x FROM s),
lb AS (SELECT doc_id, max((quality = 1)::int) AS good, substr(md5('{R.HALF_KEY}' || doc_id::varchar), 1, 1) < '8' AS choosing FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
j AS (SELECT rid, v.stratum, v.rule, v.x, good, choosing FROM v JOIN lb USING (doc_id) WHERE NOT base_failed),
g AS (SELECT * FROM (VALUES {grid}) g(rule, cutoff)),
t AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good = 0 AND x > cutoff) - {R.PRICE}::double * count(*) FILTER (WHERE good = 1 AND x > cutoff) AS gain
  FROM j JOIN g USING (rule) WHERE choosing GROUP BY ALL),
be AS (SELECT stratum, rule, max(gain) AS gain, max(cutoff) FILTER (WHERE gain = top) AS cutoff
  FROM (SELECT *, max(gain) OVER (PARTITION BY stratum, rule) AS top FROM t) WHERE gain > 0 GROUP BY ALL),
sp AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS m FROM be),
fi AS (SELECT rid, stratum, any_value(good) AS good, min(m) FILTER (WHERE x > cutoff) AS first FROM j JOIN sp USING (stratum, rule) WHERE NOT choosing GROUP BY ALL),
pk AS (SELECT stratum, rule, cutoff, (SELECT sum(good) FROM fi WHERE fi.stratum = sp.stratum) AS n,
  (SELECT coalesce(sum(good) FILTER (WHERE first <= sp.m), 0) FROM fi WHERE fi.stratum = sp.stratum) AS k FROM sp),
pv AS (
  SELECT *, CASE WHEN k < n * {risk}::double THEN list_sum(list_transform(range(0, k::bigint + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::double) + (n - i) * ln(1 - {risk}::double)))) ELSE 1 END AS p FROM pk),
ok AS (SELECT stratum, rule, cutoff FROM pv WHERE p <= {R.DELTA}::double / greatest(1, (SELECT count(DISTINCT stratum) FROM sp))),
rj AS (SELECT DISTINCT rid FROM v JOIN ok USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM rj) AS kept FROM s"""


def decontaminate_sql() -> str:
    n, t = D.SHINGLE, f"{D.THRESHOLD}::double"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def shingles(w: str) -> str:
        return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"

    return f"""
WITH dw AS (SELECT DISTINCT doc_id, regexp_extract_all({lower.format("text")}, {_WORD}) AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all({lower.format("text")}, {_WORD}) AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {shingles("w")} AS sh FROM dw WHERE len(w) >= {n}),
i AS (SELECT item_id, {shingles("w")} AS bag, len(w) - {n - 1} AS n FROM iw WHERE len(w) >= {n}),
vo AS (SELECT DISTINCT unnest(bag) AS x, n FROM i),
ix AS (SELECT DISTINCT item_id, unnest(bag) AS x FROM i),
p AS (SELECT rid, unnest(sh) AS x, generate_subscripts(sh, 1) - 1 AS pos FROM d),
pr AS (SELECT rid, item_id FROM p JOIN ix USING (x) GROUP BY ALL),
sp AS (SELECT DISTINCT rid, vo.n, least(pos, greatest(len(sh) - vo.n, 0)) AS start FROM p JOIN vo USING (x) JOIN d USING (rid)),
wi AS (
  SELECT d.doc_id, i.item_id, sp.start, i.n, i.bag, d.sh[sp.start + 1:sp.start + i.n] AS win
  FROM pr JOIN i USING (item_id) JOIN sp ON sp.rid = pr.rid AND sp.n = i.n JOIN d ON d.rid = pr.rid),
sc AS (
  SELECT doc_id, item_id, start, len(win) + n AS both_n,
    list_sum(list_transform(list_distinct(bag), lambda x: least(len(list_filter(bag, lambda y: y = x)), len(list_filter(win, lambda y: y = x))))) AS c
  FROM wi),
si AS (SELECT doc_id, item_id, start, c::double / (both_n - c)::double AS similarity FROM sc)
SELECT doc_id, item_id, max(similarity) AS similarity, min(start) FILTER (WHERE similarity = top)::bigint AS start
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS top FROM si) WHERE top >= {t} GROUP BY doc_id, item_id"""


def sharding_sql() -> str:
    """The lookup table is written out; a test builds it a second way."""
    size = S.next_prime(S.SLOTS_PER_SHARD * S.SHARDS)
    owner = ",".join(map(str, S.fill_table(S.shard_names(S.SHARDS), size)))
    return f"""
WITH t AS (SELECT unnest(string_split('{owner}', ',')) AS shard, unnest(range(0, {size})) AS slot),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, 'text:' || text, '')), 1, 15))::bigint % {size} AS slot FROM documents)
SELECT doc_id, slot, shard::integer AS shard FROM d JOIN t USING (slot)"""
