"""Joins with a side whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast.
MOST = 16 << 20


def row_bytes(schema: T.StructType) -> F.Column:
    """About what a row takes in memory: 16 bytes a column, and the length of texts and byte strings."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [f for f in schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    long += [F.octet_length(F.to_json(F.struct(f.name))) for f in nested]
    return sum(long, F.lit(16 * len(schema))).cast("long")


def sized(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df``, to be broadcast if its rows take at most ``most`` bytes; a larger one is joined by a shuffle."""
    return F.broadcast(df) if fits(df, most) else df


def fits(df: DataFrame, most: int = MOST) -> bool:
    """Whether the rows take at most ``most`` bytes."""
    return df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()[0] <= most


def flagged(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: whether its ``key`` is among ``ids`` (one column, repeats allowed)."""
    marks = sized(ids.toDF(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True)))
    return df.drop(flag).join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
