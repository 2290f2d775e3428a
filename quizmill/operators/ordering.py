"""Numbering and running values over a global order, without a single-task window.

Rows are spread by range on a unique order, so that one hot key still spans many parts.
Each part runs its own window; the parts are then joined to the totals of the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill.storage import materialize

PART = "_part"


def spread(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range-partition on ``order`` and fix each row's part number in a written table."""
    return materialize(
        df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name
    )


def running(
    df: DataFrame, chain: list[str], order: list[str], value: Column, how: str, name: str
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` (this row included) along each chain."""
    agg = {"sum": F.sum, "max": F.max}[how]
    keys = [PART, *chain]
    local = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = (
        W.partitionBy(*(chain or [F.lit(0)]))
        .orderBy(PART)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    before = (
        df.groupBy(*keys)
        .agg(agg(value).alias("_total"))
        .withColumn("_before", agg("_total").over(earlier))
        .where(F.col("_before").isNotNull())
        .drop("_total")
    )
    here = df.withColumn("_here", agg(value).over(local))
    joined = here.join(before, keys, "left")
    both = (
        F.coalesce(F.col("_before"), F.lit(0)) + F.col("_here")
        if how == "sum"
        else F.greatest("_before", "_here")
    )
    return joined.withColumn(name, both).drop("_here", "_before")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of ``order`` (which must be unique)."""
    parts = spread(df, order, "numbered")
    out = running(parts, [], order, F.lit(1), "sum", name)
    return out.withColumn(name, F.col(name).cast("bigint")).drop(PART)
