"""Document quality from a linear-chain conditional random field over lines.

Style: Arrow batches with NumPy inside tasks; one row-local scan scores the corpus.

Every line with a word is labelled good or bad.  Its score is linear in features of the line and of
its two neighbours; neighbouring labels are tied by a 2 x 2 transition table.  Training lines take
their document's label.  The model is fitted on a bounded, documented sample: ``max_train`` labelled
documents outside the held-out fold, those with the smallest hash of their id, whole texts (chains
longer than 64 lines are cut there for fitting only).  Of these a document is left out where it would
take the sample past ``max_lines`` lines, so the sample's size does not depend on how long texts are.  Scoring runs forward-backward over all lines
of every document; the lines' marginals, weighted by their words, give the document's share of good
text, and a two-parameter logistic curve fitted on the same sample turns that into its score.

Labels, language, source and id are no inputs of a score.

Nulls and limits: a null, empty or blank text counts as one line without words.  A null id is scored,
is not held out and never trains.  Null labels are ignored; a document labelled twice counts as good
if any label says so.  Rows that share an id all train while there are at most ``max_train`` rows;
equal rows train once.
Without usable labels every score is 0.5.  Repeated rows stay and score alike.  Extra columns are
ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 5
MAX_TRAIN = 4000
MAX_LINES = 1_000_000
CUT = 0.3
SEGMENT = 64
BYTES_AT_ONCE = 2_000_000

# Features of one line, in this order.
LINE_FEATURES = [
    "log_words",
    "upper_share",
    "digit_share",
    "marks_per_word",
    "bangs_per_word",
    "symbol_share",
    "word_length",
    "sameness",
    "seen_before",
    "wide_share",
]


def _classes() -> np.ndarray:
    """Per byte: bits for space, upper, digit, mark, bang, symbol, start of a code point."""
    table = np.zeros(256, np.uint8)
    for bit, chars in enumerate((b" \t\n\v\f\r", bytes(range(65, 91)), b"0123456789", b".,;:?!", b"!", b"#*$%&|<>")):
        table[list(chars)] |= 1 << bit
    starts = np.arange(256)
    table[(starts & 0xC0) != 0x80] |= 1 << 6
    return table


CLASSES = _classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a word (one line without words where a text has none): features, words, and
    the number of lines of each text."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    kind = CLASSES[raw]
    stop = np.flatnonzero(raw == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    count = lambda mask: np.add.reduceat(mask.view(np.uint8), start, dtype=np.int64)
    space = (kind & 1).astype(bool)
    first = ~space
    first[1:] &= space[:-1]
    latin_upper = np.zeros(len(raw), bool)  # two-byte capitals: 0xC3 0x80 to 0xC3 0x9E
    latin_upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    words = count(first)
    points = count((kind >> 6 & 1).astype(bool) & ~space)
    upper = count((kind >> 1 & 1).astype(bool) | latin_upper)
    digit, mark, bang, symbol = (count((kind >> b & 1).astype(bool)) for b in (2, 3, 4, 5))
    wide = count(raw >= 0xC2)
    distinct, seen = np.zeros(len(start)), np.zeros(len(start))
    text_of = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    at = 0
    for text in texts:
        known: set[bytes] = set()
        for line in text.split(b"\n"):
            distinct[at] = len(set(line.split()))
            seen[at] = line in known
            known.add(line)
            at += 1
    w, c = np.maximum(words, 1), np.maximum(points, 1)
    columns = [np.log1p(words), upper / c, digit / c, mark / w, bang / w, symbol / c, points / w / 10, 1 - distinct / w, seen, wide / c]
    all_features = np.stack(columns, axis=1)
    used = words > 0
    lines = np.bincount(text_of[used], minlength=len(texts))
    used[np.searchsorted(text_of, np.flatnonzero(lines == 0))] = True
    return all_features[used], words[used], np.maximum(lines, 1)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the line before and after (zeros at the ends), two flags for
    the ends, and a constant."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    ends = np.zeros((len(x), 3))
    ends[first, 0], ends[last, 1], ends[:, 2] = 1, 1, 1
    return np.concatenate([x, before, after, ends], axis=1)


def marginals(score: np.ndarray, tie: np.ndarray, lines: np.ndarray, pairs: bool = False):
    """Forward-backward for many chains at once.  ``score``: log odds of good per line, ``tie``: log
    weights of (label, next label).  Returns P(good) per line and, if asked for, the expected
    transitions and the log of all chains' partition sums."""
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, lines = first[order], lines[order]
    node = np.stack([np.zeros_like(score), np.clip(score, -30, 30)], axis=1)
    top = node.max(axis=1, keepdims=True)
    weight, move = np.exp(node - top), np.exp(tie)
    ahead, norm, back = np.empty_like(weight), np.empty(len(score)), np.ones_like(weight)
    alive = np.searchsorted(-lines, -np.arange(lines.max() if len(lines) else 0), side="left")  # chains longer than t
    for t, n in enumerate(alive):
        at = first[:n] + t
        now = weight[at] if t == 0 else (ahead[at - 1] @ move) * weight[at]
        norm[at] = now.sum(axis=1)
        ahead[at] = now / norm[at][:, None]
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        back[at] = (weight[at + 1] * back[at + 1]) @ move.T / norm[at + 1][:, None]
    good = (ahead * back)[:, 1]
    if not pairs:
        return good
    inner = np.ones(len(score), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    onward = weight[at] * back[at] / norm[at][:, None]
    expected = (ahead[at - 1].T @ onward) * move
    return good, expected, float(np.log(norm).sum() + top.sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def shares(self, x: np.ndarray, words: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text of each document, from raw line features."""
        z = with_neighbours((x - self.mean) / self.scale, lines)
        good = marginals(z @ self.weights, self.tie, lines)
        first = np.cumsum(lines) - lines
        weight = np.maximum(words, 1).astype(float)
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def scores(self, x: np.ndarray, words: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.shares(x, words, lines)) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def fit(x: np.ndarray, words: np.ndarray, lines: np.ndarray, good: np.ndarray, steps: int = 150, ridge: float = 1.0) -> Model:
    """Penalised maximum likelihood by Adam steps, then the document curve by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = with_neighbours((x - mean) / scale, lines)
    y = np.repeat(good, lines).astype(float)
    cuts = [min(SEGMENT, n - k) for n in lines.tolist() for k in range(0, n, SEGMENT)]
    segments = np.array(cuts, np.int64)
    first = np.cumsum(segments) - segments
    inner = np.ones(len(y), bool)
    inner[first] = False
    at, label = np.flatnonzero(inner), y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1], label[at]), 1)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, tie = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _ = marginals(z @ w, tie, segments, pairs=True)
        grad = np.concatenate([z.T @ (y - p), (seen - expected).ravel()]) - ridge * theta
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    s = _logit(model.shares(x, words, lines))
    a = np.stack([s, np.ones_like(s)], axis=1)
    b = np.array([0.5, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        b = b + np.linalg.solve(h, a.T @ (good - p) - 1e-2 * b)
    model.slope, model.shift = max(float(b[0]), 1e-3), float(b[1])
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _groups(texts: list[bytes]) -> Iterator[slice]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > BYTES_AT_ONCE:
            yield slice(first, i)
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield slice(first, len(texts))


def within(sizes: list[int], bound: int) -> list[bool]:
    """Which of the sizes, in their order, fit together below the bound; one that does not fit is left out."""
    left, out = bound, []
    for size in sizes:
        out.append(size <= left)
        left -= size if size <= left else 0
    return out


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> Model | None:
    """``docs``: doc_id, raw (binary text); ``labels``: doc_id, quality."""
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train)
    lines = F.regexp_count(F.col("raw").cast("string"), F.lit("\n")) + 1
    sample = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "raw", "good", F.xxhash64("raw").alias("same"), F.coalesce(lines, F.lit(1)).alias("lines")
    )
    # The bound on documents holds for rows too, should many share an id.
    order = F.xxhash64(F.col("doc_id").cast("string"), "same")
    listed = sample.select("doc_id", "same", "lines").distinct().orderBy(order, "doc_id", "same").limit(max_train).collect()
    fit_in = within([r["lines"] for r in listed], max_lines)
    used = [(r["doc_id"], r["same"]) for r, fits in zip(listed, fit_in, strict=True) if fits]
    named = docs.sparkSession.createDataFrame(used, sample.select("doc_id", "same").schema)
    sample = sample.join(F.broadcast(named), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])
    sample = sample.select("doc_id", "raw", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features([t or b""]) for t in batch.column(1).to_pylist()]
            x = pa.array([f.tobytes() for f, _, _ in made], pa.binary())
            w = pa.array([n.astype(np.int64).tobytes() for _, n, _ in made], pa.binary())
            columns = [batch.column(0), batch.column(2).cast(pa.int64()), x, w]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "good", "x", "w"])

    schema = T.StructType(
        [
            sample.schema["doc_id"],
            T.StructField("good", T.LongType()),
            T.StructField("x", T.BinaryType()),
            T.StructField("w", T.BinaryType()),
        ]
    )
    made = sample.mapInArrow(run, schema)
    rows = sorted(made.collect(), key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, len(LINE_FEATURES)) for r in rows])
    w = [np.frombuffer(r["w"], np.int64) for r in rows]
    lines = np.array([len(n) for n in w], np.int64)
    return fit(x, np.concatenate(w), lines, np.array([r["good"] for r in rows], float))


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = MAX_TRAIN,
    max_lines: int = MAX_LINES,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    model = train(picked, labels, max_train, max_lines)
    schema = T.StructType([picked.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            if model is None:
                made = [np.full(len(texts), 0.5)]
            else:
                made = [model.scores(*line_features(texts[part])) for part in _groups(texts)]
            scores = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    scored = picked.mapInArrow(run, schema)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
