"""Relations from literals, DataFrames and files, as frames with columns c0, c1, ..."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.tags import TAG, Unit

SQL_TYPES = {"Int": "bigint", "Symbol": "bigint", "Bool": "boolean", "String": "string"}
#: A relation without columns has this one.
NULLARY = "_u"


def keys(types: Sequence[str]) -> list[str]:
    return [f"c{i}" for i in range(len(types))] or [NULLARY]


def frame_schema(types: Sequence[str], tag: Unit) -> T.StructType:
    fields = [T.StructField(c, T._parse_datatype_string(SQL_TYPES[t])) for c, t in zip(keys(types), types or ["Int"], strict=True)]
    return T.StructType(fields + ([T.StructField(TAG, tag.column_type)] if tag.column_type else []))


def local(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A local relation, whose size the optimiser knows."""
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


def empty(spark: SparkSession, types: Sequence[str], tag: Unit) -> DataFrame:
    return local(spark, [], frame_schema(types, tag))


def from_columns(df: DataFrame, types: Sequence[str], columns: Sequence[str] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """df's columns (by position, or those named) cast to the declared types; rows with a null go."""
    names = list(columns) if columns is not None else [c for c in df.columns if c not in extra][: len(types)]
    if len(names) != len(types):
        raise ValueError(f"{len(types)} columns are needed, {len(names)} given")
    cast = [F.col(f"`{c}`").cast(SQL_TYPES[t]).alias(k) for c, t, k in zip(names, types, keys(types), strict=False)]
    kept = df.select(*(cast or [F.lit(0).cast("bigint").alias(NULLARY)]), *[F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(extra)])
    return kept.dropna()


def from_rows(spark: SparkSession, rows: Iterable[tuple], types: Sequence[str]) -> DataFrame:
    data = [tuple(r) if types else (0,) for r in rows]
    fields = [T.StructField(c, T._parse_datatype_string(SQL_TYPES[t])) for c, t in zip(keys(types), types or ["Int"], strict=True)]
    return local(spark, data, T.StructType(fields))


def fact_id(predicate: str, insert: int, names: Sequence[str], prob: Column) -> Column:
    """An identifier that depends on nothing but the fact and the insert it came with."""
    return F.xxhash64(F.lit(predicate), F.lit(insert), *[F.col(c) for c in names], prob)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def with_fields(schema: T.StructType, **more: str) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items()])
