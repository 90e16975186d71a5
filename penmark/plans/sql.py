"""Shared pieces of the check SQL."""

from __future__ import annotations

from collections.abc import Iterable

from penmark.functions import lexicon as X
from penmark.functions import tokens as K
from penmark.functions.connectors import REMOVED_SYMBOLS
from penmark.functions.lexical import ASCII_PUNCTUATION
from penmark.functions.tagging import RELATIVES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_in(items: Iterable[str]) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def round2(x: str) -> str:
    return f"(round_even(round({x}, 9) * 100.0::double, 0) / 100.0::double)"


def ratio(num: str, den: str) -> str:
    return f"coalesce(({num})::double / nullif(({den})::double, 0), 0)"


def tokens(source: str = "SELECT doc_id, text FROM documents") -> str:
    """``tok(doc_id, text, low, words, alpha, marks, terms, sentences)`` as the start of a WITH list."""
    return f"""
base AS (SELECT doc_id, text, lower(text) AS low FROM ({source})),
tok AS (
  SELECT doc_id, text, low,
    regexp_extract_all(low, {q(K.WORDS_RE)}) AS words,
    list_filter(regexp_extract_all(low, {q(K.MARKS_RE)}), lambda t: regexp_matches(t, '^\\p{{L}}+$')) AS alpha,
    regexp_extract_all(low, {q(K.MARKS_RE)}) AS marks,
    regexp_extract_all(low, {q(K.TERMS_RE)}) AS terms,
    list_filter(regexp_extract_all(text, {q(K.SENTENCE_RE)}), lambda s: regexp_matches(s, {q(K.NOT_BLANK_RE)})) AS sentences
  FROM base)"""


def _pos_case() -> str:
    lines = [
        "WHEN regexp_matches(token, '^\\p{N}+$') THEN 'NUM'",
        "WHEN regexp_matches(token, '^\\p{P}+$') THEN 'PUNCT'",
        f"WHEN NOT regexp_matches(token, '^[{K.WORD}]') THEN 'SYM'",
    ]
    lines += [f"WHEN low IN {words_in(ws)} THEN '{tag}'" for tag, ws in {**X.CLOSED_CLASS, **X.COMMON_OPEN}.items()]
    lines += [
        "WHEN tok_id > 0 AND regexp_matches(token, '^\\p{Lu}') THEN 'PROPN'",
        "WHEN regexp_matches(low, '.ly$') THEN 'ADV'",
        f"WHEN regexp_matches(low, '.({'|'.join(X.VERB_SUFFIXES)})$') THEN 'VERB'",
        f"WHEN regexp_matches(low, '.({'|'.join(X.ADJ_SUFFIXES)})$') THEN 'ADJ'",
    ]
    return "CASE " + " ".join(lines) + " ELSE 'NOUN' END"


def annotations(source: str = "SELECT doc_id, text FROM documents") -> str:
    """``ann(doc_id, sent_id, tok_id, token, pos, dep, is_alpha, is_stop, is_punct)``, after ``tok``."""
    return (
        tokens(source)
        + f""",
sent AS (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) - 1 AS sent_id FROM tok),
cut AS (SELECT doc_id, sent_id, regexp_extract_all(s, {q(K.MARKS_RE)}) AS t FROM sent),
piece AS (SELECT doc_id, sent_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS tok_id FROM cut),
tagged AS (SELECT *, {_pos_case()} AS pos FROM (SELECT *, lower(token) AS low FROM piece)),
ann AS (
  SELECT doc_id, sent_id, tok_id, token, pos,
    CASE WHEN low = 'that' AND lag(pos) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) = 'VERB' THEN 'ccomp'
         WHEN pos = 'SCONJ' THEN 'advcl'
         WHEN low IN {words_in(RELATIVES)} THEN 'acl'
         ELSE lower(pos) END AS dep,
    regexp_matches(token, '^\\p{{L}}+$') AS is_alpha,
    low IN {words_in(X.FUNCTION_WORDS)} AS is_stop,
    regexp_matches(token, '^\\p{{P}}+$') AS is_punct
  FROM tagged)"""
    )


def phrases(listed: Iterable[str]) -> str:
    values = ", ".join(f"({q(p)})" for p in listed)
    return f"phrase AS (SELECT * FROM (VALUES {values}) v(phrase))"


STRIPPED = f"translate(low, {q(REMOVED_SYMBOLS)}, '')"
PUNCTUATION = q(ASCII_PUNCTUATION)

ENTROPY = f"""
wc AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(words) AS w FROM tok) GROUP BY doc_id, w),
ent AS (
  SELECT doc_id, log2(sum(c)::double) - sum(c * log2(c::double)) / sum(c) AS h FROM wc GROUP BY doc_id)"""


def sentiment() -> str:
    rows = ", ".join(f"({q(w)}, {p}::double, {s}::double)" for p, s, ws in X.SENTIMENT for w in ws)
    return f"""
lex AS (SELECT * FROM (VALUES {rows}) v(w, p, s)),
pos_tok AS (SELECT doc_id, unnest(marks) AS w, generate_subscripts(marks, 1) AS i FROM tok),
ctx AS (SELECT *, lag(w, 1) OVER d AS one, lag(w, 2) OVER d AS two FROM pos_tok WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hits AS (
  SELECT doc_id, s, greatest(-1.0::double, least(1.0::double,
      p * CASE WHEN coalesce(one IN {words_in(X.NEGATORS)}, false) OR coalesce(two IN {words_in(X.NEGATORS)}, false)
               THEN {X.NEGATION_FACTOR}::double ELSE 1 END
        * CASE WHEN one IN {words_in(X.INTENSIFIERS)} THEN {X.INTENSITY_FACTOR}::double ELSE 1 END)) AS p
  FROM ctx JOIN lex USING (w)),
sent_doc AS (SELECT doc_id, avg(p) AS polarity, avg(s) AS subjectivity FROM hits GROUP BY doc_id)"""
