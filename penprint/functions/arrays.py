"""In-row array helpers.

A row here is one text or one sentence, so an array is as large as that text. Doing
this work inside the row needs no shuffle, however the rows are distributed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """``[0, .., n-1]``, empty for ``n = 0`` (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def run_starts(ordered: Column) -> Column:
    """Positions at which a new value begins in a sorted array."""
    return bind(
        ordered,
        lambda v: F.filter(
            positions(F.size(v)), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1))
        ),
    )


def run_lengths(ordered: Column) -> Column:
    """Sorted array to ``array<struct<value, n>>``, one entry per distinct value."""
    return bind(
        ordered,
        lambda s: bind(
            run_starts(s),
            lambda starts: F.transform(
                starts,
                lambda st, k: F.struct(
                    F.get(s, st).alias("value"),
                    (F.coalesce(F.get(starts, k + 1), F.size(s)) - st).alias("n"),
                ),
            ),
        ),
    )


def total(values: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Sum of a numeric array as BIGINT, 0 when empty."""
    return F.aggregate(
        values, F.lit(0).cast("bigint"), lambda acc, x: acc + of(x).cast("bigint")
    )
