"""The relational operators one by one, on frames with or without a tag column.

Each takes and gives DataFrames whose columns other than the tag are the tuple. The
tag decides about ⊗ (join, product, intersect, contains) and ⊕ (dedupe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import TAG, Unit

_UNIT = Unit()


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != TAG]


def _other(df: DataFrame) -> tuple[DataFrame, bool]:
    return (df.withColumnRenamed(TAG, "_right"), True) if TAG in df.columns else (df, False)


def _times(df: DataFrame, tag: Unit, right: bool) -> DataFrame:
    if not right:
        return df
    if TAG not in df.columns:
        return df.withColumnRenamed("_right", TAG)
    return df.withColumn(TAG, tag.mult(F.col(TAG), F.col("_right"))).drop("_right")


def source(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def project(df: DataFrame, *columns: Column | str, tag: Unit = _UNIT) -> DataFrame:
    """The columns, with equal tuples merged."""
    return dedupe(df.select(*columns, *([TAG] if TAG in df.columns else [])), tag)


def select(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def find(df: DataFrame, column: str, key: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(key))


def join(left: DataFrame, right: DataFrame, on: Sequence[str], tag: Unit = _UNIT) -> DataFrame:
    right, tagged = _other(right)
    return _times(left.join(right, list(on)), tag, tagged)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def product(left: DataFrame, right: DataFrame, tag: Unit = _UNIT) -> DataFrame:
    right, tagged = _other(right)
    return _times(left.crossJoin(right), tag, tagged)


def intersect(left: DataFrame, right: DataFrame, tag: Unit = _UNIT) -> DataFrame:
    if TAG not in left.columns and TAG not in right.columns:
        return left.intersect(right.select(*left.columns))
    return join(left, right, data_columns(left), tag)


def union(*frames: DataFrame, tag: Unit = _UNIT) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return dedupe(out, tag)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The tuples of left that are not in right."""
    names = data_columns(left)
    out = left.join(right.select(*names), names, "left_anti")
    return out if TAG in left.columns else out.distinct()


def antijoin(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_anti")


def contains_chain(first: DataFrame, key: dict[str, object], second: DataFrame, tag: Unit = _UNIT) -> DataFrame:
    """All of second, if first has the tuple key; with its tag."""
    for c, v in key.items():
        first = first.where(F.col(c) == F.lit(v))
    if TAG not in first.columns:
        return second.crossJoin(F.broadcast(first.limit(1).select(F.lit(0).alias("_gate")))).drop("_gate")
    gate = tag.merge(first.select(F.lit(0).alias("_gate"), TAG), ["_gate"])
    return product(second, F.broadcast(gate), tag).drop("_gate")


def dedupe(df: DataFrame, tag: Unit = _UNIT) -> DataFrame:
    return tag.merge(df, data_columns(df)) if TAG in df.columns else df.distinct()


def delta(new: DataFrame, full: DataFrame) -> DataFrame:
    names = data_columns(new)
    return new.join(full.select(*names), names, "left_anti")
