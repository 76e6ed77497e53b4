"""Set operations, roll-ups, windows and top-k with the dialect's semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns matched by place, both cast to a common type, under left's names."""
    if len(left.columns) != len(right.columns):
        raise ValueError("the sides of a set operation differ in width")
    probe = left.limit(0).toDF(*left.columns).union(right.limit(0).toDF(*left.columns))
    cast = lambda df: df.toDF(*left.columns).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in probe.schema.fields))
    return cast(left), cast(right)


def union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    a, b = aligned(a, b)
    return a.unionAll(b) if all else a.unionAll(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    a, b = aligned(a, b)
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    a, b = aligned(a, b)
    return a.exceptAll(b) if all else a.subtract(b)


def rollup(df: DataFrame, keys: list, *aggregates: Column) -> DataFrame:
    """GROUP BY ROLLUP with a grouping_<key> bit for each key."""
    return df.rollup(*keys).agg(*aggregates, *(F.grouping(k).alias(f"grouping_{k}") for k in keys))


def top_k(df: DataFrame, order: list, k: int, offset: int = 0) -> DataFrame:
    """First k rows after offset; order: (column, descending)."""
    sorted_ = df.orderBy(*(expr.desc(c) if down else expr.asc(c) for c, down in order))
    return (sorted_.offset(offset) if offset else sorted_).limit(k)


def running(df: DataFrame, name: str, value: Column, partition: list, order: list) -> DataFrame:
    """value over the rows from the partition's first to the current one."""
    w = Window.partitionBy(*partition).orderBy(*(expr.desc(c) if down else expr.asc(c) for c, down in order))
    return df.withColumn(name, value.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def moving(df: DataFrame, name: str, value: Column, partition: list, order: list, before: int, after: int) -> DataFrame:
    """value over a frame of before rows, the current one and after rows."""
    w = Window.partitionBy(*partition).orderBy(*(expr.desc(c) if down else expr.asc(c) for c, down in order))
    return df.withColumn(name, value.over(w.rowsBetween(-before, after)))


def tracked(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """df and an observation whose ["rows"] holds the rows that passed, once an action ran."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
