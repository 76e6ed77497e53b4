"""Column expressions with the semantics of the dialect."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def asc(c):
    """Ascending; NULL is larger than every value."""
    return F.asc_nulls_last(c)


def desc(c):
    return F.desc_nulls_first(c)


def idiv(a, b) -> Column:
    """Division of integers without the fraction."""
    a, b = (F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.call_function("div", a, b)


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; positions below 1 use up length."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, first, F.length(s) + 1)
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(s, first, F.greatest(start + length, first) - first)


def rows(partition=(), order=()):
    """A window from its first row to the current one, counted in rows."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def find(s: Column, part: str, start: Column | int = 0) -> Column:
    """0-based place of part at or after start, -1 if there is none."""
    start = F.lit(start) if isinstance(start, int) else start
    at = F.instr(F.substring(s, start + 1, F.length(s) + 1), part)
    return F.when(at > 0, at - 1 + start).otherwise(-1)


def ordinal(s: Column) -> Column:
    return F.ascii(s)


def truth(p: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(p, F.lit(False))


def null_safe_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end, truncated."""
    size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    gap = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (F.signum(gap) * F.floor(F.abs(gap) / (size * 1_000_000))).cast("bigint")


def erf(x: Column) -> Column:
    """Error function to about 1e-15: its Taylor series near 0, a continued fraction beyond."""
    z = F.abs(x)
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(60)),
        F.struct(z.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, n: F.struct((-acc["term"] * z * z / (n + 1)).alias("term"), (acc["sum"] + acc["term"] / (2 * n + 1)).alias("sum")),
        lambda acc: acc["sum"] * 2 / F.sqrt(F.pi()),
    )
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, n: (n / 2.0) / (z + acc))
    far = 1 - F.exp(-z * z) / F.sqrt(F.pi()) / (z + tail)
    return F.signum(x) * F.when(z < 2.5, series).otherwise(far)


def list_set(a: Column, i: Column | int, v: Column) -> Column:
    """Copy of array a with element i (0-based) replaced."""
    return F.transform(a, lambda x, k: F.when(k == i, v).otherwise(x))


def dict_set(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))


def random_in_range(low: int, high: int, seed: int | None = None) -> Column:
    """Whole numbers from low to high, high left out."""
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("bigint")


def avg_exact(c: Column) -> Column:
    """Average of integers as a decimal: exact sum over the count."""
    return F.sum(c.cast("decimal(19,0)")) / F.count(c)
