"""Transforms of one stock's daily series, as columns over the window of its days.

Nulls are the only missing value. A frame of w days counts its non-null values; fewer than m give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def days(last: int | None = None) -> WindowSpec:
    """The stock's days in order; with `last`, the frame of the last so many days."""
    w = Window.partitionBy("StockId").orderBy("Date")
    return w if last is None else w.rowsBetween(-(last - 1), 0)


def enough(x: Column, w: int, m: int, value: Column) -> Column:
    return F.when(F.count(x).over(days(w)) >= m, value)


def rolling_mean(x: Column, w: int, m: int | None = None) -> Column:
    return enough(x, w, w if m is None else m, F.avg(x).over(days(w)))


def rolling_std(x: Column, w: int, m: int | None = None) -> Column:
    return enough(x, w, w if m is None else m, F.stddev_samp(x).over(days(w)))


def zscore(x: Column, w: int = 20, m: int | None = None, eps: float = 1e-8) -> Column:
    """(x - mean) / (sample deviation + eps) over the last w days; m is half of w by default."""
    return enough(x, w, max(1, w // 2) if m is None else m, (x - F.avg(x).over(days(w))) / (F.stddev_samp(x).over(days(w)) + eps))


def ewm(x: Column, span: int, m: int | None = None) -> Column:
    """Exponentially weighted mean with weights (1 - a)^age, a = 2 / (span + 1), over all days so far.

    Days so old that their weights are below the last bit of a double are left out, so a day's work has a bound.
    """
    decay = 1 - 2 / (span + 1)
    back = max(2, math.ceil(40 / -math.log(decay)))
    held = F.collect_list(F.struct(x.alias("x"))).over(days(back))
    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("weight"))

    def step(acc: Column, row: Column) -> Column:
        top, weight = acc["top"] * decay, acc["weight"] * decay
        return F.struct(F.when(row["x"].isNull(), top).otherwise(top + row["x"]).alias("top"), F.when(row["x"].isNull(), weight).otherwise(weight + 1).alias("weight"))

    mean = F.aggregate(held, zero, step, lambda acc: F.when(acc["weight"] > 0, acc["top"] / acc["weight"]))
    return F.when(F.count(x).over(days().rowsBetween(Window.unboundedPreceding, 0)) >= (max(span // 2, 2) if m is None else m), mean)


def _recursive(x: Column, span: int, finish) -> Column:
    """A fold over the days so far, from the first value on: mean m, and weight, squared weights and squares about m. Days whose
    weights are below the last bit of a double are left out; a null day changes nothing."""
    a = 2 / (span + 1)
    back = max(2, math.ceil(40 / -math.log(1 - a)))
    held = F.collect_list(x).over(days(back))
    zero = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w2"))

    def step(acc: Column, y: Column) -> Column:
        # Weights sum to one: (1 - a) of the old, a of the new; v is the weighted mean square about m, w2 the sum of squared weights.
        old = acc["m"].isNull()
        return F.struct(F.when(old, y).otherwise((1 - a) * acc["m"] + a * y).alias("m"), F.when(old, F.lit(0.0)).otherwise((1 - a) * (acc["v"] + a * (y - acc["m"]) * (y - acc["m"]))).alias("v"), F.when(old, F.lit(1.0)).otherwise((1 - a) ** 2 * acc["w2"] + a * a).alias("w2"))

    return F.aggregate(held, zero, step, finish)


def ewm_recursive(x: Column, span: int) -> Column:
    """m = (1 - a) m + a x, from the first value on, a = 2 / (span + 1)."""
    return _recursive(x, span, lambda acc: acc["m"])


def ewm_recursive_std(x: Column, span: int) -> Column:
    """The deviation that belongs to it, corrected for bias by the sum of squared weights; null for one value."""
    return _recursive(x, span, lambda acc: F.when(acc["w2"] < 1, F.sqrt(acc["v"] / (1 - acc["w2"]))))


def pct_rank(x: Column, w: int, m: int) -> Column:
    """The share of the last w values at or below the current one; equal values have their mean rank."""
    held = F.collect_list(x).over(days(w))
    below, same = F.size(F.filter(held, lambda y: y < x)), F.size(F.filter(held, lambda y: y == x))
    return F.when(x.isNotNull() & (F.size(held) >= m), (below + (same + 1) / 2) / F.size(held))


def ffill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(days().rowsBetween(Window.unboundedPreceding, 0))


def shift(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(days()) if k >= 0 else F.lead(x, -k).over(days())


def diff(x: Column, k: int = 1) -> Column:
    return x - shift(x, k)


def pct_change(x: Column, k: int = 1) -> Column:
    return x / F.nullif(shift(x, k), F.lit(0.0)) - 1


def cumulative(x: Column) -> Column:
    return F.sum(x).over(days().rowsBetween(Window.unboundedPreceding, 0))


def filled(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rolling_max(x: Column, w: int, m: int | None = None) -> Column:
    return enough(x, w, w if m is None else m, F.max(x).over(days(w)))


def rolling_sum(x: Column, w: int, m: int | None = None) -> Column:
    return enough(x, w, w if m is None else m, F.sum(x).over(days(w)))


def rolling_min(x: Column, w: int, m: int | None = None) -> Column:
    return enough(x, w, w if m is None else m, F.min(x).over(days(w)))


def rolling_quantile(x: Column, w: int, m: int, q: float) -> Column:
    """With linear interpolation."""
    return enough(x, w, m, F.percentile(x, F.lit(q)).over(days(w)))


def rolling_skew(x: Column, w: int, m: int) -> Column:
    """Corrected for bias; null where nothing varies."""
    n = F.count(x).over(days(w))
    return enough(x, w, max(m, 3), F.when(F.stddev_samp(x).over(days(w)) > 0, F.skewness(x).over(days(w)) * F.sqrt(n * (n - 1)) / (n - 2)))


def rolling_corr(x: Column, other: str, w: int, m: int) -> Column:
    """With another column that has no nulls where x has none; 0 for fewer than m days or where one does not vary."""
    y, mean = F.col(other), lambda c: F.avg(c).over(days(w))
    vx, vy = mean(x * x) - mean(x) * mean(x), mean(y * y) - mean(y) * mean(y)
    value = F.when((vx > 1e-12) & (vy > 1e-12), (mean(x * y) - mean(x) * mean(y)) / F.sqrt(vx * vy))
    return F.coalesce(enough(x, w, m, value), F.lit(0.0))


def rolling_slope(x: Column, w: int) -> Column:
    """Of a line through the last w days; null if any of them is."""
    middle = (w - 1) / 2
    total = sum((k - middle) ** 2 for k in range(w))
    out = x * (middle / total)
    for j in range(1, w):
        out = out + shift(x, j) * ((w - 1 - j - middle) / total)
    return out


def zscore_transform(x: Column, w: int = 20) -> Column:
    """The z-score of whole windows, 0 where there is none, within -3 and 3."""
    return clipped(filled(enough(x, w, w, (x - F.avg(x).over(days(w))) / F.nullif(F.stddev_samp(x).over(days(w)), F.lit(0.0)))), -3.0, 3.0)


def zscore_population(x: Column, w: int, m: int, eps: float = 1e-9) -> Column:
    """The z-score by the population's deviation."""
    return enough(x, w, m, (x - F.avg(x).over(days(w))) / (F.stddev_pop(x).over(days(w)) + eps))


def mad_zscore(x: Column, median: str, w: int, m: int, eps: float = 1e-8) -> Column:
    """The distance from the median of the window (a column) over the median distance from it."""
    held = F.array_sort(F.transform(F.collect_list(x).over(days(w)), lambda v: F.abs(v - F.col(median))))
    n = F.size(held)
    middle = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
    return F.when(n >= m, (x - F.col(median)) / (middle + eps))


def rank_by_date(x: Column) -> Column:
    """The share of the date's stocks at or below this one; equal values have their mean rank. A date is one group: as many rows as stocks."""
    of_date = Window.partitionBy("Date")
    same = F.count("*").over(Window.partitionBy("Date", x))
    return F.when(x.isNotNull(), (F.rank().over(of_date.orderBy(x.asc_nulls_last())) + (same - 1) / 2) / F.count(x).over(of_date))
