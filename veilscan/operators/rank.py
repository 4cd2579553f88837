"""The value at a rank of a large table, found by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges counted at a time: 2^16.
LEVEL_BITS = 16


def value_at(df: DataFrame, column: str, k: int, low: int, high: int) -> int:
    """The ``k``-th smallest (from 0) of a whole-number column without nulls that lies in low..high.

    The range that holds it is found from counts of at most 2^16 equal ranges, which tasks combine before
    the shuffle, then cut into as many again until it is one number: four rounds for any long, one for
    numbers that differ by less than 65,536. Nothing is sorted and no task sees more than the counts.
    """
    shift, left, start = max((high - low).bit_length(), 1), k, low
    while shift > 0:
        width = min(LEVEL_BITS, shift)
        shift -= width
        inside = df.select(F.col(column).alias("x")).filter(F.col("x").between(start, start + (1 << (shift + width)) - 1))
        counts = inside.groupBy(F.shiftright(F.col("x") - F.lit(start), shift).alias("range")).agg(F.count("*").alias("n"))
        for place, n in sorted(tuple(r) for r in counts.collect()):
            if left < n:
                start += place << shift
                break
            left -= n
    return start
