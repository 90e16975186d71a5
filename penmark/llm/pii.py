"""Personal data by aggregating weak labelers.

Style: one Arrow pass of regular expressions over the texts, then small tables.

Base spans (email, ip, card, phone) are found by fixed patterns and checks and always stay.  Further
candidate spans (kinds below) come from wider patterns and a gazetteer; six labelers vote on each
candidate with 1 (personal), -1 (not) or 0 (silent): the strict pattern of the kind, the gazetteer,
words before it, words after it, a check on its digits, and a list of contexts that speak against.
All candidates of the corpus are counted by (kind, votes, features); a two-class model whose labelers
err independently is fitted to these counts by expectation-maximisation, which gives each labeler a
reliability and each vote pattern a probability; a logistic span classifier is then trained on the
counts, weighted by those probabilities, over discrete span features (kind, words around it, digits,
length).  A candidate is added where the classifier says at least ``accept``.  The driver sees counts
per distinct pattern only, whose number is bounded by the votes and features, not by the corpus.

A secret is a value of eight characters or more after a key word and = or :, up to its closing quote or,
unquoted, to white space, or what follows ``Bearer``.  A name is a run of words that begin with an
upper-case letter of any script, with particles such as "de la" or "von" between them, after a title or
from a given name of the gazetteer on.

Nulls and limits: a null or empty text has no span.  A null id is kept.  Repeated rows stay and give
equal results.  Extra columns are ignored.  An empty table, or one without candidates, adds nothing.
Patterns run in linear time on long runs of one class.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import Store

BASE_KINDS = ["email", "ip", "card", "phone"]
MORE_KINDS = ["obfuscated_email", "local_phone", "national_id", "iban", "mac", "secret", "name"]
KIND_ORDER = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so longer runs are not tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A small gazetteer of given names.
NAMES = set(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica "
    "thomas sarah charles karen anna maria peter hans klaus ursula pierre jean marie michel carmen jose antonio juan luis".split()
)
TITLES = set("Mr Mrs Ms Dr Herr Frau Monsieur Madame Mme Señor Señora".split())
# All upper-case and title-case letters (none lie beyond), and a name word: one of them, then letters with their accents.
UPPER = "".join(c for c in map(chr, range(0x1F000)) if unicodedata.category(c) in ("Lu", "Lt"))
NAME_WORD = rf"[{UPPER}][\w\u0300-\u036f'’-]++"
# Particles that may stand between name words.
PARTICLES = "da das de del den der des di do dos du el la las le les los ten ter van von y zu zum zur"
MORE_NAMES = rf"(?: (?:(?:{'|'.join(PARTICLES.split())}) )*+{NAME_WORD})*+"

MORE = {
    "obfuscated_email": re.compile(
        r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]*+ ?(?i:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++"
        r"(?: ?(?i:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z]++)++(?![A-Za-z0-9])"
    ),
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    "secret": re.compile(
        r"(?i)(?:(?<![a-z0-9])(?:api|access|auth|client|private|secret)?(?:key|token|secret|password|passwd|pwd)[\"']? ?[=:] ?"
        r"(?:\"([^\"\n]{8,}+)\"|'([^'\n]{8,}+)'|(\S{8,}+))|\bbearer +([a-z0-9_~+/.=-]{8,}+))"
    ),
    "name": re.compile(
        rf"\b(?:(?:{'|'.join(sorted(TITLES))})\b\.? ({NAME_WORD}{MORE_NAMES})"
        rf"|(?=[{UPPER}])((?i:{'|'.join(sorted(NAMES))})\b(?:-[\w'’-]++)?{MORE_NAMES}))"
    ),
}
# Cheap tests that must hold before a pattern is tried on a text.
NEEDS_DIGIT = {"local_phone", "national_id", "iban", "mac"}
NEEDS_ONE_OF = {"secret": ("=", ":", "earer ", "EARER ")}
CAPITALISED = re.compile(r"[A-Z]\w*+")

# Words around a span that speak for its kind.
BEFORE = {
    "obfuscated_email": "mail contact write reach",
    "local_phone": "phone tel telephone call mobile fax cell telefon móvil",
    "national_id": "ssn social security id identity insurance",
    "iban": "iban account bank konto compte cuenta",
    "mac": "mac hardware device interface",
    "secret": "aws api access secret private client auth github",
    "name": "by from dear contact author with",
}
AFTER = {
    "obfuscated_email": "for or mail",
    "local_phone": "ext extension or between",
    "national_id": "born dob",
    "iban": "bic swift",
    "mac": "address ip",
    "secret": "user region login",
    "name": "wrote said born lives",
}
AGAINST = set("isbn issn doi version fig figure table page order invoice part model serial item example".split())
NEAR = 40
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, dotted domain: the local part is the whole run of its
    characters before an @, back to the previous match at most."""
    done, at = 0, text.find("@")
    seen = 0
    while at >= 0:
        head = text[max(done, seen) : at]
        start = at - (len(head) - len(head.rstrip(LOCAL_CHARS)))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        seen = at + 1
        at = text.find("@", max(seen, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, kind by kind."""
    out = [("email", a, z) for a, z in emails(text)]
    if not any(c in text for c in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(q) <= 3 and int(q) <= 255 for q in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _words_near(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _check(kind: str, value: str) -> int:
    """Vote of the digit check of a kind."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "iban":
        flat = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == "national_id":
        return 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" else -1
    if kind == "local_phone":
        return 1 if digits[0] not in "01" and len(set(digits)) > 2 else -1
    if kind == "secret":
        mixed = bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)) and len(set(value)) >= 8
        return 1 if mixed else -1
    return 0


def found_in(kind: str, text: str) -> Iterator[re.Match]:
    """Matches of a kind's pattern; that of names is only tried at titles and given names."""
    if kind != "name":
        yield from MORE[kind].finditer(text)
        return
    done = 0
    for word in CAPITALISED.finditer(text):
        if word.start() >= done and (word[0] in TITLES or word[0].lower() in NAMES):
            if m := MORE[kind].match(text, word.start()):
                yield m
                done = m.end()


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Further spans with their code: votes, then digits and length classes.  Those that overlap a base
    span are left to it."""
    out = []
    has_digit = any(c in text for c in "0123456789")
    # Base spans as disjoint runs in order.
    firsts, lasts = [], []
    for _, first, last in sorted(taken, key=lambda s: s[1]):
        if lasts and first < lasts[-1]:
            lasts[-1] = max(last, lasts[-1])
        else:
            firsts.append(first)
            lasts.append(last)
    for kind in MORE:
        if kind in NEEDS_DIGIT and not has_digit:
            continue
        if kind in NEEDS_ONE_OF and not any(x in text for x in NEEDS_ONE_OF[kind]):
            continue
        for m in found_in(kind, text):
            a, z = m.span(m.lastindex or 0)
            if bisect_left(firsts, z) > bisect_right(lasts, a):
                continue
            value = text[a:z]
            before, after = _words_near(text[max(0, m.start() - NEAR) : a]), _words_near(text[z : z + NEAR])
            strict = {
                "obfuscated_email": "[" in value or "(" in value,
                "local_phone": value.count("-") == 2 or "(" in value,
                "secret": m[0][-1] in "\"'" or len(value) >= 16,
                "name": a > m.start() and " " in value,
            }.get(kind, True)
            listed = bool(_words_near(value) & NAMES)
            votes = (
                1 if strict else 0,
                1 if listed else (-1 if kind == "name" and " " not in value else 0),
                1 if before & set(BEFORE[kind].split()) else 0,
                1 if after & set(AFTER[kind].split()) else 0,
                _check(kind, value),
                -1 if (before | after) & AGAINST else 0,
            )
            digits = min(4, sum(c.isdigit() for c in value) // 4)
            size = min(4, len(value) // 8)
            out.append((kind, a, z, "".join("-0+"[v + 1] for v in votes) + f"{digits}{size}"))
    return out


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each row of ``votes`` (-1, 0, 1 per labeler) is personal data, by EM.

    Starts from the sign of the votes' sum; each class and labeler has a table over the three votes,
    with one pseudo-count per cell."""
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    for _ in range(rounds):
        logs = []
        for weight in (counts * (1 - p), counts * p):
            table = np.stack([((votes == v) * weight[:, None]).sum(axis=0) for v in (-1, 0, 1)]) + 1
            table /= table.sum(axis=0)
            logs.append(np.log(table[votes + 1, np.arange(votes.shape[1])]).sum(axis=1) + np.log(weight.sum() + 1))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return p


def span_features(kind: str, code: str) -> np.ndarray:
    """Discrete features of a candidate: constant, kind, each vote as two flags, digits, length."""
    x = np.zeros(1 + len(MORE_KINDS) + 2 * LABELERS + 10)
    x[0] = 1
    x[1 + MORE_KINDS.index(kind)] = 1
    at = 1 + len(MORE_KINDS)
    for i, c in enumerate(code[:LABELERS]):
        x[at + 2 * i], x[at + 2 * i + 1] = c == "+", c == "-"
    at += 2 * LABELERS
    x[at + int(code[LABELERS])] = 1
    x[at + 5 + int(code[LABELERS + 1])] = 1
    return x


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model for soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (target - p)) - ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def accepted(patterns: list[tuple[str, str, int]], accept: float) -> set[tuple[str, str]]:
    """(kind, code) pairs that the classifier accepts.  ``patterns``: kind, code, count."""
    if not patterns:
        return set()
    patterns = sorted(patterns)
    votes = np.array([[{"-": -1, "0": 0, "+": 1}[c] for c in code[:LABELERS]] for _, code, _ in patterns])
    counts = np.array([n for _, _, n in patterns], float)
    x = np.stack([span_features(kind, code) for kind, code, _ in patterns])
    w = fit_classifier(x, fit_votes(votes, counts), counts)
    p = 1 / (1 + np.exp(-(x @ w)))
    return {(kind, code) for (kind, code, _), q in zip(patterns, p, strict=True) if q >= accept}


def _joined(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(set(spans), key=lambda s: (s[1], KIND_ORDER[s[0]], s[2]))
    return ",".join(f"{k}:{a}:{z}" for k, a, z in ordered)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, base spans as text, candidates as an array of (kind, first, last, code)."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("code", T.StringType()))])
    schema = T.StructType(
        [
            picked.schema["doc_id"],
            T.StructField("base", T.StringType()),
            *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
        ]
    ).add("more", T.ArrayType(span))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("code", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, counts, more = [], {k: [] for k in BASE_KINDS}, []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append(_joined(spans))
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                found = candidates(text or "", spans)
                more.append([{"kind": k, "first": a, "last": z, "code": c} for k, a, z, c in found])
            columns = [batch.column(0), pa.array(base, pa.string())]
            columns += [pa.array(counts[k], pa.int64()) for k in BASE_KINDS] + [pa.array(more, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return picked.mapInArrow(run, schema)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans``; the last two list
    the base spans and all spans as kind:start:end in code points, end exclusive."""
    rows = Store(docs.sparkSession, "pii").put(scan(docs, id_col, text_col), "spans")
    seen = rows.select(F.explode("more").alias("m")).groupBy("m.kind", "m.code").count()
    good = accepted([(r["kind"], r["code"], r["count"]) for r in seen.collect()], accept)
    schema = T.StructType([*[rows.schema[c] for c in rows.columns if c != "more"], T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = batch.column("base").to_pylist(), batch.column("more").to_pylist()
            spans = []
            for b, m in zip(base, more, strict=True):
                parts = [s.split(":") for s in b.split(",")] if b else []
                found = [(k, int(a), int(z)) for k, a, z in parts]
                found += [(x["kind"], x["first"], x["last"]) for x in m if (x["kind"], x["code"]) in good]
                spans.append(_joined(found))
            kept = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def redact(text: str, spans: str) -> str:
    """``text`` with each listed span replaced by its kind in angle brackets; of overlapping spans the
    first stays."""
    out, done = [], 0
    for kind, a, z in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= done:
            out += [text[done : int(a)], f"<{kind}>"]
            done = int(z)
    return "".join([*out, text[done:]])
