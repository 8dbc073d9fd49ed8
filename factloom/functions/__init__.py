"""Column functions; each takes and returns Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A column used n times in an expression is n copies of its tree; nesting such functions grows plans
    exponentially. A bound variable keeps them small. Plain table columns need no binding.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, keep: list, array: Column, item: str, position: str = "position") -> DataFrame:
    """One row per array element with its position; rows with an empty array vanish.

    A plain explode makes Spark test the array's size in a filter below it, which computes the array twice.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias("_pos", item)).filter(F.col("_pos").isNotNull())
    return out.withColumn(position, F.col("_pos").cast("long")).drop("_pos")
