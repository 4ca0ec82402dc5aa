"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.array_join(F.array_sort(F.array(a, b)), ",")


def members(feature: Column) -> Column:
    return F.split(feature, ",")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; null where bc is zero."""
    return ratio(a.cast("double") * d.cast("double"), b.cast("double") * c.cast("double"))


def odds_ci(a: Column, b: Column, c: Column, d: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the odds ratio; null where a cell is zero."""
    whole = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    mid = F.log(odds_ratio(a, b, c, d))
    spread = z * F.sqrt(sum((F.lit(1.0) / x for x in (b, c, d)), F.lit(1.0) / a))
    return F.when(whole, F.exp(mid - spread)), F.when(whole, F.exp(mid + spread))


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)
