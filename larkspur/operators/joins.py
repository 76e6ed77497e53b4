"""Joins that Spark has no name for, as compositions of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _equal(left: DataFrame, right: DataFrame, keys: list) -> Column:
    return reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in keys))


def mark_join(left: DataFrame, right: DataFrame, keys: list, mark: str = "mark") -> DataFrame:
    """left with a boolean: whether right has a partner; keys are (left, right) names.

    The partner side is one row per key, so no row of left is repeated."""
    side = right.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).distinct().withColumn("_hit", F.lit(True))
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)))
    return left.join(side, on, "left").select(*left.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias(mark))


def single_join(left: DataFrame, right: DataFrame, keys: list, values: list, check: bool = False) -> DataFrame:
    """left with the values of its only partner, NULL without one; check raises if there are several."""
    side = right.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).agg(F.count("*").alias("_n"), *(F.any_value(v).alias(f"_v{i}") for i, v in enumerate(values)))
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)))
    value = lambda i: F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row for a scalar"))).otherwise(F.col(f"_v{i}")) if check else F.col(f"_v{i}")
    return left.join(side, on, "left").select(*left.columns, *(value(i).alias(v) for i, v in enumerate(values)))


def collection_join(left: DataFrame, right: DataFrame, keys: list, values: list, name: str = "collected") -> DataFrame:
    """left with the list of its partners' values (structs, sorted), empty without one."""
    side = right.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("_list"))
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)))
    return left.join(side, on, "left").select(*left.columns, F.coalesce(F.col("_list"), F.array().cast(side.schema["_list"].dataType)).alias(name))


def group_join(left: DataFrame, right: DataFrame, keys: list, aggregates: list, how: str = "inner") -> DataFrame:
    """left, whose key is unique, with aggregates over its partners: right is aggregated first, so the join is of one row each."""
    side = right.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys))).agg(*aggregates)
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)))
    return left.join(side, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def compatible_join(left: DataFrame, right: DataFrame, shared: list, certain: list, how: str = "inner") -> DataFrame:
    """Join in which NULL of a shared column agrees with anything; the merged value is the one there is.

    Columns in certain are never NULL on either side and make it an equi-join."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns))
    conds = [F.col(c) == F.col(f"_r_{c}") for c in certain]
    conds += [F.col(c).isNull() | F.col(f"_r_{c}").isNull() | (F.col(c) == F.col(f"_r_{c}")) for c in shared if c not in certain]
    out = left.join(r, reduce(lambda a, b: a & b, conds), how)
    merged = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in shared else F.col(c) for c in left.columns]
    return out.select(*merged, *(F.col(f"_r_{c}").alias(c) for c in right.columns if c not in left.columns))


def not_exists(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """NOT IN without the NULL trap: rows of left without a partner."""
    r = right.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)))
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)))
    return left.join(r, on, "left_anti")
