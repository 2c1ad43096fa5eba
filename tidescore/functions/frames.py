"""Small whole-frame helpers without storage: set operations and inline rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str,
                distinct: bool = True) -> DataFrame:
    """Literal rows as a frame, repeated rows once unless ``distinct`` is off."""
    df = spark.createDataFrame(list(rows), schema)
    return df.distinct() if distinct else df


def stack_distinct(dfs: Sequence[DataFrame], columns: Sequence[str], alias: str | None = None) -> DataFrame:
    """The distinct values (null counts as one) of several columns of several frames, in one column.

    Every frame is scanned once for all its columns, and repeated values are combined before the shuffle.
    """
    name = alias or columns[0]
    stacked = [df.select(F.explode(F.array(*columns)).alias(name)) for df in dfs]
    return reduce(DataFrame.unionByName, stacked).distinct()


def pending(df: DataFrame, column: str) -> DataFrame:
    """Rows of a work list whose result column is still null."""
    return df.filter(F.col(column).isNull())
