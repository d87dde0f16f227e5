"""Sums of doubles that no order changes: each value is cut into three integers, whose sums are exact.

A value is hi * 2^-20 + mid * 2^-51 + low * 2^-82 with integers 0 <= mid, low < 2^31; what lies below 2^-82 is cut off.  Sums of
longs are the same in any order and partitioning, carries make one form of them, and that form becomes one double.  Values must be
finite, and their sum of sizes below 2^43; up to 2^32 of them can be summed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 31


def exact_sum(value: Column) -> Column:
    """An aggregate: the sum of doubles, bit for bit the same whatever the order of rows; null if there are none."""
    unit, step = F.lit(float(1 << 20)), F.lit(float(1 << _LOW))
    scaled = value * unit
    hi = F.floor(scaled)
    rest = (scaled - hi) * step
    mid = F.floor(rest)
    low = F.floor((rest - mid) * step)
    hi, mid, low = F.sum(hi), F.sum(mid), F.sum(low)
    carried = mid + F.shiftright(low, _LOW)
    mask = F.lit((1 << _LOW) - 1)
    below = carried.bitwiseAND(mask) + low.bitwiseAND(mask) / step
    return ((hi + F.shiftright(carried, _LOW)) + below / step) / unit


def exact_avg(value: Column) -> Column:
    """An aggregate: exact_sum over the number of values that are not null."""
    return exact_sum(value) / F.count(value)
