"""Exact quantiles of a corpus column by refining a histogram around the wanted ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = 32  # approximate quantiles between which a pass counts
ACCURACY = 1_000  # of those quantiles: ranks off by a thousandth of the interval at most
SMALL = 10_000  # an interval with at most this many rows is read out


@dataclass
class _Open:
    """The value of 0-based ``rank`` lies in [low, high]; ``below`` rows lie under it, ``rows`` in it."""

    rank: int
    low: float
    high: float
    below: int
    rows: int

    def holds(self, value: Column) -> Column:
        return value.between(F.lit(self.low), F.lit(self.high))


def _narrow(values: DataFrame, asked: Sequence[_Open]) -> list[_Open]:
    """The cells that hold the asked ranks, from two scans for all of them together.

    A cell is either one of the splits itself or the values strictly between two of them, so each
    pass shuts at least one value out, however often a value repeats."""
    v = F.col("v")
    shares = [(i + 0.5) / SPLITS for i in range(SPLITS)]
    cuts = values.agg(
        *[F.percentile_approx(F.when(o.holds(v), v), shares, ACCURACY).alias(f"s{i}") for i, o in enumerate(asked)]
    ).first()
    cells = []
    for i, o in enumerate(asked):
        splits = sorted(set(cuts[f"s{i}"]))
        cell = sum(((v > s).cast("int") + (v >= s).cast("int") for s in splits), F.lit(0))
        cells.append(F.when(o.holds(v), F.struct(F.lit(i).alias("i"), cell.alias("cell"))))
    counted = (
        values.select("v", F.explode(F.array_compact(F.array(*cells))).alias("at"))
        .groupBy("at.i", "at.cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .orderBy("i", "cell")
        .collect()
    )
    out = []
    for i, o in enumerate(asked):
        below = o.below
        for r in counted:
            if r["i"] != i:
                continue
            if o.rank < below + r["n"]:
                out.append(_Open(o.rank, r["low"], r["high"], below, r["n"]))
                break
            below += r["n"]
    return out


def _read_out(values: DataFrame, asked: Sequence[_Open]) -> dict[int, float]:
    """The values of ranks whose intervals are small: at most ``SMALL`` rows each reach the driver."""
    v = F.col("v")
    within = F.lit(False)
    for o in asked:
        within = within | o.holds(v)
    rows = values.where(within).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    out = {}
    for o in asked:
        at = o.below
        for r in rows:
            if o.low <= r["v"] <= o.high:
                at += r["n"]
                if o.rank < at:
                    out[o.rank] = r["v"]
                    break
    return out


def quantiles(df: DataFrame, col: str, shares: Sequence[float], small: int = SMALL) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row ``(share, value)`` per asked share.

    No task or driver holds more than a histogram: each pass counts the rows of 2 * SPLITS + 1
    cells around every wanted rank and keeps the cell that holds it, about SPLITS times fewer rows,
    until a cell is one value or at most ``small`` rows.  A column of 10**12 rows takes six passes of
    two scans, so a column that is dear to compute is stored first.  Null and NaN are left out;
    without values every result is null."""
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n, schema = ends["n"], "share double, value double"
    if n == 0:
        return df.sparkSession.createDataFrame([(float(q), None) for q in shares], schema)
    places = {q: q * (n - 1) for q in shares}
    ranks = sorted({r for p in places.values() for r in (math.floor(p), math.ceil(p))})
    asked = [_Open(r, ends["low"], ends["high"], 0, n) for r in ranks]
    while wide := [o for o in asked if o.rows > small and o.low < o.high]:
        asked = [o for o in asked if o not in wide] + _narrow(values, wide)
    found = {o.rank: o.low for o in asked if o.low == o.high}
    if open_ := [o for o in asked if o.low < o.high]:
        found |= _read_out(values, open_)
    rows = []
    for q in shares:
        at = places[q]
        a, b = found[math.floor(at)], found[math.ceil(at)]
        rows.append((float(q), a + (b - a) * (at - math.floor(at))))
    return df.sparkSession.createDataFrame(rows, schema)
