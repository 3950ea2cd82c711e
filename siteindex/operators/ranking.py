"""Positions in large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_LOW = (1 << 32) - 1


def place(major: str, minor: str) -> Column:
    """Two ordinals in one number that sorts the same way.

    The minimum of a number is kept by hash aggregation, that of a struct needs a sort.
    """
    return F.shiftleft(F.col(major).cast("bigint"), 32) + F.col(minor)


def major(code: str) -> Column:
    return F.shiftright(F.col(code), 32).cast("int")


def minor(code: str) -> Column:
    return F.col(code).bitwiseAND(F.lit(_LOW)).cast("int")


def numbered(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], name: str
) -> DataFrame:
    """Position of each row in its group, from 0, by ``block`` and then ``order``.

    Only rows of one block are sorted together; the counts of the blocks before it give
    the rest. A group that holds much of the table is so spread over many tasks. ``df``
    is read twice: pass a written table.
    """
    inner = Window.partitionBy(*group, block).orderBy(*order)
    earlier = (
        Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *group, block, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    placed = df.withColumn("_in_block", F.row_number().over(inner))
    return (
        placed.join(offsets, [*group, block])
        .withColumn(name, (F.col("_before") + F.col("_in_block") - 1).cast("int"))
        .drop("_before", "_in_block")
    )
