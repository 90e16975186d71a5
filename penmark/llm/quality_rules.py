"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets counts and shares in one row-local pass.  Fixed base rules come first.  What
passes them is judged by five share rules whose cutoffs are chosen per stratum (language) from
labelled documents, which a hash of their id deals to two halves.  The choosing half proposes: for
each rule the cutoff with the largest ``bad - price * good`` of rejected documents (ties to the
higher one; none where that is not positive), the rules in order of that gain.  The held-out half
certifies their *joint* rejection: with the first m rules, k of n good documents of the stratum
would be rejected, and m is certified if the exact binomial tail P(X <= k | n, risk) is at most
``delta`` divided by the number of strata that have a proposal.  k only grows with m, so the m of a
stratum are tested in a fixed sequence and need no further correction.  With probability
1 - ``delta`` no stratum then loses more than ``risk`` of its good documents to all rules together.
With four strata 72 held-out good documents, none of them rejected, are enough.  Strata with fewer
labels have base rules only.

Nulls and limits: a null text has no words and fails the base rule for length, as an empty one.
Null strata form one stratum, null labels are ignored, a label of 1 is good and any other bad, a
document labelled twice counts as good if any label says so.  A null id matches no label.  Repeated rows stay.  Extra columns are ignored.
Empty labels certify nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import KEYS, SPACE_RE, Store, row_keys, words
from penmark.physical import broadcast_checked

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Rule -> candidate cutoffs, rising.  A document is rejected when its share exceeds the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3],
    "bang_share": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5],
    "upper_share": [0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.9],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
    "sameness": [0.5, 0.6, 0.7, 0.8, 0.9, 0.95],
}
RISK, DELTA, PRICE = 0.05, 0.1, 4.0
HALF_KEY = "quality:"  # hashed before the id to deal labelled documents to the two halves


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def _repeated_words(windows: Column, found: Column) -> Column:
    """Words covered by windows found twice: ``found`` holds (hash, position) pairs in order."""
    starts = F.sort_array(
        F.transform(
            F.filter(found, lambda x, j: (x["h"] == F.get(found, j - 1)["h"]) | (x["h"] == F.get(found, j + 1)["h"])),
            lambda x: x["p"],
        )
    )
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.get(
            F.transform(
                F.array(starts),
                lambda s: F.aggregate(
                    F.transform(s, lambda p, j: F.least(F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
            F.lit(0),
        ),
    ).otherwise(F.lit(0))


def features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """``doc_id, key_a, key_b, stratum``, the counts, the shares and ``base_failed`` of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *row_keys(F.col(id_col), F.col(text_col)),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"),
        F.col(text_col).alias("text"),
    )
    kept = ["doc_id", *KEYS, "stratum"]
    split = base.select(
        *kept,
        words(F.col("text")).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE_RE, "")) > 0).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).alias("bangs"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("uppers"),
    )
    counted = split.select(
        *kept,
        "n_symbols",
        "bangs",
        "uppers",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = counted.select(
        *kept,
        "n_symbols",
        "n_words",
        "word_chars",
        "n_dup_lines",
        _share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        _share(F.col("bangs"), F.col("n_words")).alias("bang_share"),
        _share(F.col("uppers"), F.col("word_chars")).alias("upper_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.size("h") - F.size(F.array_distinct("h")), F.size("h")).alias("sameness"),
        F.transform(
            F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]),
        ).alias("win"),
    )
    marked = windows.withColumn(
        "found",
        F.when(
            F.size(F.array_distinct("win")) < F.size("win"),
            F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    repeat = _repeated_words(F.col("win"), F.col("found")).cast("bigint").alias("n_repeat_words")
    out = marked.select(*kept, *[c for c in COUNTS if c != "n_repeat_words"], repeat, *RULES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _log_factorial(n: Column) -> Column:
    """ln n!: summed for small n, else by Stirling's series (error below 1e-10)."""
    x = n.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(n, F.lit(32))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    series = (x + 0.5) * F.log(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < 1, F.lit(0.0)).when(n <= 32, summed).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), for k below n * p; 1 otherwise.

    The largest term comes from logarithms of factorials, the others relative to it, each from the
    one above.  Below n * p they fall faster than a bell curve of variance n * p, so those more than
    ten deviations down add nothing to a double and are left out."""
    top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k.cast("double") * math.log(p) + (n - k).cast("double") * math.log1p(-p)
    )
    reach = F.ceil(10 * F.sqrt(n.cast("double") * p)) + 50
    last = F.greatest(k - reach, F.lit(1).cast("bigint"))
    steps = F.when(k >= 1, F.sequence(k, last, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    fall = lambda i: i.cast("double") * (1 - p) / ((n - i + 1).cast("double") * p)
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * fall(i)).alias("term"), (a["sum"] + a["term"] * fall(i)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k.cast("double") < n.cast("double") * p, F.exp(top) * total).otherwise(F.lit(1.0))


def _proposals(judged: DataFrame, price: float) -> DataFrame:
    """``(stratum, steps)``: the proposed rules of a stratum, ``struct(order, rule, cutoff)`` each,
    most gainful first."""
    # Level of a share: how many cutoffs it exceeds.  One small row per stratum, rule and level.
    levels = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                sum(((F.col(rule) > c).cast("int") for c in grid), F.lit(0)).alias("level"),
            )
            for rule, grid in RULES.items()
        ]
    )
    at_level = (
        judged.select("stratum", "good", F.inline(levels))
        .groupBy("stratum", "rule", "level")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    grid_rows = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(j + 1).alias("level"), F.lit(c).alias("cutoff"))
            for rule, grid in RULES.items()
            for j, c in enumerate(grid)
        ]
    )
    tried = (
        at_level.groupBy("stratum", "rule")
        .agg(F.collect_list(F.struct("level", "good", "bad")).alias("levels"))
        .withColumn("grid", F.filter(grid_rows, lambda g: g["rule"] == F.col("rule")))
        .select("stratum", "rule", "levels", F.inline("grid").alias("rule2", "level", "cutoff"))
    )
    over = F.filter("levels", lambda x: x["level"] >= F.col("level"))
    gain = F.aggregate(over, F.lit(0.0), lambda a, x: a + x["bad"] - price * x["good"])
    return (
        tried.select("stratum", "rule", "cutoff", gain.alias("gain"))
        .where("gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct("gain", "cutoff")).alias("best"))
        .groupBy("stratum")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("best.gain")).alias("order"), "rule", F.col("best.cutoff").alias("cutoff")))).alias("steps"))
    )


def cutoffs(
    rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, price: float = PRICE
) -> DataFrame:
    """``(stratum, rule, cutoff)`` of the certified cutoffs.

    ``rows``: stored output of ``features`` (a filter on it would else be pushed below the row-local
    steps and evaluate them again); ``labels``: ``(doc_id, quality)``, quality 1 is good."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    choosing = F.md5(F.concat(F.lit(HALF_KEY), F.col("doc_id").cast("string"))).substr(1, 1) < "8"
    judged = rows.where(~F.col("base_failed")).select("doc_id", "stratum", *RULES).join(known, "doc_id").withColumn("choosing", choosing)
    proposed = Store(rows.sparkSession, "quality").put(_proposals(judged.where("choosing"), price), "proposed")
    allowed = delta / max(1, proposed.count())
    # The first proposed rule that rejects a held-out document, or none.
    share = F.create_map(*[x for rule in RULES for x in (F.lit(rule), F.col(rule))])
    hits = F.transform("steps", lambda s, i: F.when(F.element_at(share, s["rule"]) > s["cutoff"], i))
    held = judged.where("not choosing").join(broadcast_checked(proposed), "stratum")
    at_step = (
        held.select("stratum", "good", F.get(F.filter(hits, lambda i: i.isNotNull()), F.lit(0)).alias("first"))
        .groupBy("stratum", "first")
        .agg(F.sum("good").cast("bigint").alias("good"))
    )
    tested = (
        at_step.groupBy("stratum")
        .agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good")).alias("firsts"))
        .join(proposed, "stratum")
        .select("stratum", "n", "firsts", F.posexplode("steps").alias("m", "step"))
    )
    upto = F.filter("firsts", lambda x: x["first"] <= F.col("m"))
    rejected = F.aggregate(upto, F.lit(0).cast("bigint"), lambda a, x: a + x["good"])
    sound = tested.withColumn("k", rejected).where(binomial_tail(F.col("k"), F.col("n"), risk) <= allowed)
    return sound.select("stratum", "step.rule", "step.cutoff")


def judge(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: false if base_failed or a share exceeds its stratum's cutoff."""
    wide = chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]
    )
    joined = rows.join(broadcast_checked(wide), "stratum", "left")
    rejected = F.col("base_failed")
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~rejected).select(*rows.columns, "kept")


def quality_verdicts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Features and verdict of every row of ``docs``."""
    store = Store(docs.sparkSession, "quality")
    rows = store.put(features(docs, **columns), "features")
    chosen = store.put(cutoffs(rows, labels), "cutoffs")
    return judge(rows, chosen)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    verdicts = quality_verdicts(docs, labels, id_col=id_col, text_col=text_col, stratum_col=stratum_col)
    gone = broadcast_checked(verdicts.where("not kept").select(*KEYS).distinct())
    a, b = row_keys(docs[id_col], docs[text_col])
    return docs.join(gone, (a == gone["key_a"]) & (b == gone["key_b"]), "left_anti")
