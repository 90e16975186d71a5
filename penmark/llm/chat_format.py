"""Chat formatting: a hidden Markov model recovers speaker roles, then turns are rendered.

Style: Arrow batches for line features and Viterbi; Spark sorts, cuts and joins.

Rows of a conversation in order (turn, then text hash) form a transcript of lines.  The hidden state
of a line is its role.  Observed are a speaker marker at the line's start, the length of the line and
of its row, and whether it ends as a question.  Roles follow one table of transitions where a row
begins or a marker stands, and rarely change elsewhere.  The tables are counts over all labelled
rows (outside the held-out fold of conversations) with a small prior; the role of a row is never read
when it is decoded.

Segments: a conversation is cut at every ``SEGMENT`` turn numbers; a piece that still has over
``MAX_ROWS`` rows is cut at each turn number and then by leading bits of the text hash, which keeps the
order.  So no conversation, however long, is in one task.  For conversations of several segments a
first pass reduces each segment to a 3 x 3 table of best scores, these are chained (nine numbers per
segment), and the states at the cuts are handed to the second pass, which decodes the segments: the
result is the Viterbi path of the whole conversation.

Every row yields its parts (runs of lines of one role), markers removed, as canonical text:
``<|im_start|>role`` newline, text, ``<|im_end|>`` newline.

Nulls and limits: a null text is one empty line.  A null conversation id is a conversation of its own
per row.  A null turn comes last.  Repeated rows stay.  Unknown or null roles do not train; without any
labelled row the prior decides.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.llm.common import Store
from penmark.physical import broadcast_checked

ROLES = ["system", "user", "assistant"]
SEGMENT = 256
MAX_ROWS = 2048
FOLDS = 5
STAY = 0.98
# Speaker names that open a line, by role.
SPEAKERS = {
    "system": "system|sys|instructions?",
    "user": "user|human|customer|question|q|me",
    "assistant": "assistant|ai|bot|agent|model|answer|a|gpt",
}
MARKER = re.compile(
    r"\s*(?:<\||\[|\*\*|#{1,4} ?)?(?:" + "|".join(f"(?P<{r}>{p})" for r, p in SPEAKERS.items()) + r")(?:\|>|\](?::)?|:\*\*|\*\*:|:|>)\s*",
    re.IGNORECASE,
)
FEATURES = {"marker": 4, "line_words": 10, "row_words": 12, "question": 2}


def bucket(n: int, most: int) -> int:
    """About two steps per doubling."""
    return min(most - 1, 0 if n <= 0 else int(1 + 1.5 * np.log2(n)))


def observe(text: str | None) -> list[tuple[int, ...]]:
    """One tuple of feature values per line; the row's length counts on its first line only (0 else)."""
    out, lines = [], (text or "").split("\n")
    total = len((text or "").split())
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        marker = 0 if m is None else 1 + ROLES.index(m.lastgroup)
        row = bucket(total, 11) + 1 if i == 0 else 0
        out.append((marker, bucket(len(line.split()), 10), min(row, 11), int(line.rstrip().endswith("?"))))
    return out


def strip_marker(line: str) -> str:
    m = MARKER.match(line)
    return line if m is None else line[m.end() :]


class Tables:
    """Log probabilities: start, transitions between rows, within a row, emissions by feature."""

    def __init__(self, start: dict, moves: dict, emitted: dict):
        prior_start = np.array([1.0, 1.0, 0.1])
        prior_move = np.array([[0.1, 1.0, 0.2], [0.1, 0.2, 1.0], [0.1, 1.0, 0.2]])
        self.start = self._log(prior_start + [start.get(r, 0) for r in ROLES])
        self.move = self._log(prior_move + [[moves.get((a, b), 0) for b in ROLES] for a in ROLES])
        self.inside = np.log(np.full((3, 3), (1 - STAY) / 2) + np.eye(3) * (STAY - (1 - STAY) / 2))
        self.emit = []
        for f, (name, size) in enumerate(FEATURES.items()):
            table = np.full((3, size), 0.5)
            if name == "marker":  # a marker of another role counts 10^4 times less
                table = np.concatenate([np.full((3, 1), 5.0), np.full((3, 3), 0.02) + 200 * np.eye(3)], axis=1)
            for (role, feature, value), n in emitted.items():
                if feature == f and value < size:
                    table[ROLES.index(role), value] += n
            self.emit.append(self._log(table))

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        return np.log(counts / counts.sum(axis=-1, keepdims=True))

    def scores(self, rows: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores of all lines, and whether a line opens a turn: starts a row or has a marker."""
        seen = np.array([line for row in rows for line in row], np.int64).reshape(-1, len(FEATURES))
        score = sum(table[:, seen[:, f]].T for f, table in enumerate(self.emit))
        opens = seen[:, 0] > 0
        opens[np.cumsum([0] + [len(r) for r in rows[:-1]])] = True
        return score, opens

    def reduce(self, rows: list[list[tuple[int, ...]]]) -> np.ndarray:
        """Best score from each state before the segment to each state at its end."""
        score, opens = self.scores(rows)
        best = np.full((3, 3), -np.inf)
        np.fill_diagonal(best, 0.0)
        for s, o in zip(score, opens, strict=True):
            step = self.move if o else self.inside
            best = (best[:, :, None] + step[None]).max(axis=1) + s
        return best

    def decode(self, rows: list[list[tuple[int, ...]]], before: int | None, end: int | None) -> list[int]:
        """Viterbi path of one segment between the states at its cuts; ``before`` None: it starts a
        conversation, ``end`` None: it ends one.  Of equal paths the one with the lowest states."""
        score, opens = self.scores(rows)
        now = (self.start if before is None else self.move[before]) + score[0]
        back = np.zeros((len(score), 3), np.int64)
        for t in range(1, len(score)):
            reach = now[:, None] + (self.move if opens[t] else self.inside)
            back[t] = reach.argmax(axis=0)
            now = reach.max(axis=0) + score[t]
        path = [int(now.argmax()) if end is None else end]
        for t in range(len(score) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]


def segmented(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """``conv_id, turn, text, given, conv, no_turn, tie, seg_a, seg_b, several``: rows with their
    conversation's key, order and segment."""
    conv, turn, text = (F.col(c) for c in (conv_col, turn_col, text_col))
    rows = turns.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        text.alias("text"),
        F.lower(F.trim(F.col(role_col).cast("string"))).alias("given"),
        F.when(conv.isNotNull(), F.concat(F.lit("="), conv.cast("string")))
        .otherwise(F.concat(F.lit("?"), F.hex(F.xxhash64(turn, text)), F.hex(F.xxhash64(text, turn))))
        .alias("conv"),
        turn.isNull().cast("int").alias("no_turn"),
        F.xxhash64(text).alias("tie"),
    )
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / SEGMENT).cast("bigint") * SEGMENT)
    sizes = rows.groupBy("conv", "no_turn", "block").count().where(F.col("count") > MAX_ROWS)
    fine = sizes.select("conv", "no_turn", "block", F.ceil(F.log2(F.col("count") / MAX_ROWS) + 1).cast("int").alias("bits"))
    joined = rows.join(broadcast_checked(fine), ["conv", "no_turn", "block"], "left")
    large = F.col("bits").isNotNull()
    # The hash is ordered as signed; moved to unsigned, its leading bits keep that order.
    leading = F.expr("shiftrightunsigned(tie ^ (-9223372036854775807L - 1L), 64 - bits)")
    return joined.select(
        "conv_id",
        "turn",
        "text",
        "given",
        "conv",
        "no_turn",
        "tie",
        F.when(large, F.coalesce(F.col("turn").cast("bigint"), F.lit(0))).otherwise(F.col("block")).alias("seg_a"),
        F.when(large, leading).otherwise(F.lit(0)).cast("bigint").alias("seg_b"),
    )


PIECE = ["conv", "no_turn", "seg_a", "seg_b"]


def learn(rows: DataFrame) -> Tables:
    """Count tables from the labelled rows outside the held-out conversations."""
    known = rows.where(F.col("given").isin(ROLES) & (F.crc32(F.col("conv").cast("binary")) % FOLDS != 0))
    first = known.groupBy("conv").agg(F.min_by("given", F.struct("no_turn", "turn", "tie")).alias("given"))
    start = {r["given"]: r["count"] for r in first.groupBy("given").count().collect()}
    order = Window.partitionBy(*PIECE).orderBy("turn", "tie")
    pairs = known.select("given", F.lag("given").over(order).alias("before")).where("before is not null")
    moves = {(r["before"], r["given"]): r["count"] for r in pairs.groupBy("before", "given").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for line in observe(text):
                    for f, value in enumerate(line):
                        counts[role, f, value] = counts.get((role, f, value), 0) + 1
            role, f, value = (pa.array(x) for x in zip(*counts, strict=True)) if counts else (pa.array([], pa.string()), [], [])
            columns = [role, pa.array(f, pa.int32()), pa.array(value, pa.int32()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "feature", "value", "n"])

    emitted = known.select("given", "text").mapInArrow(run, "given string, feature int, value int, n bigint")
    emitted = emitted.groupBy("given", "feature", "value").agg(F.sum("n").alias("n"))
    return Tables(start, moves, {(r["given"], r["feature"], r["value"]): r["n"] for r in emitted.collect()})


def _by_piece(batches: Iterator[pa.RecordBatch], piece: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches, one list per segment."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in piece)
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row)
    if held:
        yield key, held


def cut_states(rows: DataFrame, tables: Tables, store: Store) -> DataFrame:
    """``conv, no_turn, seg_a, seg_b, before, end``: states at the cuts of each segment of the
    conversations with several segments (``before`` null at the first, ``end`` null at the last)."""
    pieces = rows.groupBy(*PIECE).agg(F.count("*").alias("n"))
    several = pieces.groupBy("conv").count().where(F.col("count") > 1).select("conv")
    long = rows.join(broadcast_checked(store.put(several, "several")), "conv", "left_semi")
    dealt = long.select(*PIECE, "turn", "tie", "text").repartition(*PIECE).sortWithinPartitions(*PIECE, "turn", "tie")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _by_piece(batches, PIECE):
            best = tables.reduce([observe(r["text"]) for r in held])
            out = dict(zip(PIECE, key, strict=True)) | {"best": best.ravel().tolist()}
            yield pa.RecordBatch.from_pylist([out], schema=reduced)

    keys = [("conv", pa.string()), ("no_turn", pa.int32()), ("seg_a", pa.int64()), ("seg_b", pa.int64())]
    reduced = pa.schema([*keys, ("best", pa.list_(pa.float64()))])
    kinds = "conv string, no_turn int, seg_a bigint, seg_b bigint"
    scores = dealt.mapInArrow(reduce, f"{kinds}, best array<double>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_piece(batches, ["conv"]):
            now, back = tables.start, []
            for i, r in enumerate(held):
                best = np.array(r["best"]).reshape(3, 3)
                if i == 0:
                    # Its own first step came from an unknown state; the start takes that step's place.
                    now = np.array(r["first"])
                    back.append(np.zeros(3, np.int64))
                else:
                    reach = now[:, None] + best
                    back.append(reach.argmax(axis=0))
                    now = reach.max(axis=0)
            ends = [int(now.argmax())]
            for b in reversed(back[1:]):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            out = [
                {c: r[c] for c in PIECE}
                | {"before": ends[i - 1] if i else None, "end": ends[i] if i < len(held) - 1 else None}
                for i, r in enumerate(held)
            ]
            yield pa.RecordBatch.from_pylist(out, schema=cut)

    cut = pa.schema([*keys, ("before", pa.int32()), ("end", pa.int32())])
    opening = dealt_first(long, tables)
    chained = scores.join(opening, PIECE, "left").repartition("conv").sortWithinPartitions(*PIECE)
    return store.put(chained.mapInArrow(chain, f"{kinds}, before int, end int"), "cuts")


def dealt_first(long: DataFrame, tables: Tables) -> DataFrame:
    """``first``: best score of each end state of a conversation's first segment, from the start."""
    least = long.groupBy("conv").agg(F.min(F.struct("no_turn", "seg_a", "seg_b")).alias("p"))
    rows = long.join(least.select("conv", "p.*"), PIECE).select(*PIECE, "turn", "tie", "text")
    dealt = rows.repartition(*PIECE).sortWithinPartitions(*PIECE, "turn", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _by_piece(batches, PIECE):
            score, opens = tables.scores([observe(r["text"]) for r in held])
            now = tables.start + score[0]
            for s, o in zip(score[1:], opens[1:], strict=True):
                now = (now[:, None] + (tables.move if o else tables.inside)).max(axis=0) + s
            yield pa.RecordBatch.from_pylist([dict(zip(PIECE, key, strict=True)) | {"first": now.tolist()}], schema=schema)

    schema = pa.schema(
        [("conv", pa.string()), ("no_turn", pa.int32()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("first", pa.list_(pa.float64()))]
    )
    return dealt.mapInArrow(run, "conv string, no_turn int, seg_a bigint, seg_b bigint, first array<double>")


def render(text: str | None, path: list[int]) -> tuple[str, int]:
    """Canonical text of one row, and its number of parts."""
    parts: list[tuple[int, list[str]]] = []
    for line, state in zip((text or "").split("\n"), path, strict=True):
        if not parts or parts[-1][0] != state:
            parts.append((state, []))
        parts[-1][1].append(strip_marker(line))
    made = (f"<|im_start|>{ROLES[s]}\n" + "\n".join(lines) + "<|im_end|>\n" for s, lines in parts)
    return "".join(made), len(parts)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """One row per input row: ``conv_id, turn, role`` (of its first line), ``n_parts, rendered``."""
    store = Store(turns.sparkSession, "chats")
    rows = segmented(turns, conv_col, turn_col, text_col, role_col)
    tables = learn(rows)
    cuts = broadcast_checked(cut_states(rows, tables, store))
    joined = rows.join(cuts, PIECE, "left").select("conv_id", *PIECE, "turn", "tie", "text", "before", "end")
    dealt = joined.repartition(*PIECE).sortWithinPartitions(*PIECE, "turn", "tie")
    schema = T.StructType(
        [
            dealt.schema["conv_id"],
            dealt.schema["turn"],
            T.StructField("role", T.StringType()),
            T.StructField("n_parts", T.IntegerType()),
            T.StructField("rendered", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                if kinds is None:
                    own = [batch.schema.field("conv_id"), batch.schema.field("turn")]
                    kinds = pa.schema([*own, ("role", pa.string()), ("n_parts", pa.int32()), ("rendered", pa.string())])
                yield batch

        for _, held in _by_piece(seen(), PIECE):
            lines = [observe(r["text"]) for r in held]
            path, at = tables.decode(lines, held[0]["before"], held[0]["end"]), 0
            for r, seen_lines in zip(held, lines, strict=True):
                own = path[at : at + len(seen_lines)]
                at += len(seen_lines)
                text, n = render(r["text"], own)
                out.append({"conv_id": r["conv_id"], "turn": r["turn"], "role": ROLES[own[0]], "n_parts": n, "rendered": text})
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, schema)


def held_out(conv_id: Column) -> Column:
    """Whether a conversation is in the fold that never trains."""
    return F.crc32(F.concat(F.lit("="), conv_id.cast("string")).cast("binary")) % FOLDS == 0
