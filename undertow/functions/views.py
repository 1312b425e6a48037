"""Array expressions that make classifier inputs of views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(v: Column) -> Column:
    s = F.array_sort(F.filter(v, lambda x: ~F.isnan(x)))
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def normalize_view(v: Column) -> Column:
    """Divided by the median less 1, if the median is there and not 0; what isn't finite becomes 0."""

    def scaled(pair: Column) -> Column:  # the median is named once, not worked out for every element
        m = pair["m"]
        use = m.isNotNull() & (m != 0)
        return F.transform(pair["v"], lambda x: F.when(use, x / m - 1).otherwise(x))

    out = F.element_at(F.transform(F.array(F.struct(v.alias("v"), array_median(v).alias("m"))), scaled), 1)
    return F.transform(out, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def pad_view(v: Column, n: int) -> Column:
    return F.concat(F.slice(v, 1, n), F.array_repeat(F.lit(0.0), F.lit(n) - F.least(F.size(v), F.lit(n))))


def resample_view(v: Column, n: int) -> Column:
    """Linear interpolation to n points, ends on ends."""
    step = (F.size(v) - 1) / F.lit(float(n - 1))

    def at(i: Column) -> Column:
        x = i * step
        lo = F.least(F.floor(x).cast("int"), F.size(v) - 2)
        a, b = F.element_at(v, lo + 1), F.element_at(v, lo + 2)
        return a + (b - a) * (x - lo)

    return F.when(F.size(v) == n, v).when(F.size(v) == 1, F.array_repeat(F.element_at(v, 1), n)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def two_channel(global_view: Column, local_view: Column, n: int = 2048) -> Column:
    return F.array(resample_view(normalize_view(global_view), n), pad_view(normalize_view(local_view), n))
