"""Even ranges of rows in the order of a key, whatever its skew, from a bounded sample of keys.

Both native operators that need a row's place or neighbour in a total order cut the table into ranges and do the rest
within a range. Bounds are quantiles of a sample; they decide how even the ranges are and never a result. A key is a
number of bigint columns without nulls. Rows equal in their whole key can't be told apart by any bound; where they would
fill ranges of their own they get one range, which ``heavy`` marks, for the caller to aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most ranges, and keys drawn for their bounds: a number for each range, and at most.
MAX_RANGES = 1 << 16
DRAWN, MAX_DRAWN = 16, 1 << 18


def _numbers(xs) -> Column:
    """An array of numbers as a constant, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def _bounds(rows: DataFrame, add_key: Callable[[DataFrame], DataFrame], key: list[str], range_rows: int) -> list[tuple[int, ...]]:
    """Lower bounds of ranges of about ``range_rows`` rows, in order; a key that fills k ranges comes k times."""
    n = rows.count()
    ranges = min(MAX_RANGES, -(-n // range_rows))
    if ranges < 2:
        return []
    want = min(n, DRAWN * ranges, MAX_DRAWN)
    drawn = rows if want == n else rows.filter(F.rand(7) < 1.05 * want / n)
    keys = sorted(map(tuple, add_key(drawn).select(*key).collect()))
    return [keys[len(keys) * r // ranges] for r in range(1, ranges)] if keys else []


def _place(bounds: list[tuple[int, ...]], key: list[str]) -> Column:
    """How many of the bounds are at most the row's key, by binary search in constants."""
    columns = [_numbers(x) for x in zip(*bounds, strict=True)]
    row = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])

    def step(at, size):
        to = (at + size - 1).cast("int")
        bound = F.struct(*[F.get(c, to).alias(f"k{i}") for i, c in enumerate(columns)])
        return F.when((at + size <= len(bounds)) & (bound <= row), at + size).otherwise(at)

    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), step).cast("bigint")


def in_ranges(rows: DataFrame, add_key: Callable[[DataFrame], DataFrame], key: list[str], range_rows: int) -> tuple[DataFrame, Column | None]:
    """``add_key(rows)`` with _range, which rises with the key, and what tells ranges of one heavy key; None without any."""
    drawn = _bounds(rows, add_key, key, range_rows)
    heavy = sorted({a for a, b in zip(drawn, drawn[1:], strict=False) if a == b})
    bounds = sorted({*drawn, *(_after(k) for k in heavy)})
    keyed = add_key(rows)
    if not bounds:
        return keyed.withColumn("_range", F.lit(0).cast("bigint")), None
    # a generator, as a filter on _range would else be pushed below it and the key worked out anew at each step of the search
    placed = keyed.select("*", F.explode(F.array(_place(bounds, key))).alias("_range"))
    return placed, F.array_contains(_numbers(bounds.index(k) + 1 for k in heavy), F.col("_range")) if heavy else None


def _after(key: tuple[int, ...]) -> tuple[int, ...]:
    """The least key above ``key``."""
    out = list(map(int, key))
    for k in range(len(out) - 1, -1, -1):
        if out[k] < 2**63 - 1:
            out[k] += 1
            break
        out[k] = -(2**63)
    return tuple(out)
