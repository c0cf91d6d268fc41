"""Consecutive row numbers without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut

_PART, _AT = "_tessera_part", "_tessera_at"


def number_rows(df: DataFrame, out: str, start: int = 0, order: Sequence[Column] = ()) -> tuple[DataFrame, int]:
    """(df with consecutive numbers from start in column out, the number after the last).

    With an order the rows are range partitioned and sorted by it; without one they are numbered as they lie. The rows
    are written once to the shared folder, since numbers must not change when a task is run again; each partition's
    first number comes from one small row per partition.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of the id count rows within the partition
    placed = cut(df.withColumn(_PART, F.spark_partition_id()).withColumn(_AT, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy(_PART).agg(F.count("*").alias("_n"))
    firsts = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    # one row per partition of the input
    numbered = placed.join(F.broadcast(firsts.select(_PART, "_first")), _PART)
    return numbered.withColumn(out, F.col("_first") + F.col(_AT) + F.lit(start)).drop(_PART, _AT, "_first"), start + total
