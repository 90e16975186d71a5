"""Row-local array helpers built on Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column used inside a lambda may be inlined by the optimizer and then run once per
    element (a sort inside a loop).  Binding it as a lambda variable rules that out."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_runs(items: Column) -> Column:
    """``array<T>`` -> ``array<struct<value: T, n: int>>``, one entry per distinct value, sorted.

    Sort, keep the positions where a run starts, subtract neighbours: O(n log n) inside the
    row, so counting words per document needs no explode and no shuffle."""

    def on_sorted(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("value"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), on_sorted)


def array_sum(items: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x).cast("double"))


def array_mean(items: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Mean over the elements; 0 for an empty array."""
    return let(items, lambda a: ratio(array_sum(a, of), F.size(a)))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double; 0 when ``den`` is 0; null when either side is null."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive n-grams joined by one blank; empty array when there are fewer than n tokens.

    The last ``n - 1`` positions give null (``concat`` of a missing neighbour) and are dropped."""

    def at(t: Column, x: Column, i: Column) -> Column:
        parts = [x]
        for k in range(1, n):
            parts += [F.lit(" "), F.get(t, i + k)]
        return F.concat(*parts)

    if n == 1:
        return tokens
    return let(tokens, lambda t: F.array_compact(F.transform(t, lambda x, i: at(t, x, i))))


def round2(x: Column) -> Column:
    """Two decimals, halves to even.  The inner rounding removes summation-order noise, so
    that a value which is exactly on a boundary falls the same way on every plan."""
    return F.rint(F.round(x, 9) * 100.0) / 100.0
