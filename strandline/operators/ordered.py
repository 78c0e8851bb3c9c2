"""Ordered neighbours within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_neighbours(df: DataFrame, group: list[str], order: list[str], block: Column, out: str, value: Column, previous: bool = False) -> DataFrame:
    """df with column `out`: value of the next (or previous) row of the group in (block, *order), null at the end.

    block must be monotone in the wanted order, or the order be free. A group is worked on block by block, so no task holds more
    than a block's rows; a second window over one row for each block joins the ends.
    """
    flip = (lambda c: F.col(c).desc()) if previous else (lambda c: F.col(c).asc())
    rows = df.withColumn("_block", block)
    inner = Window.partitionBy(*group, "_block").orderBy(*(flip(c) for c in order))
    rows = rows.withColumn("_value", value).withColumn("_at", F.row_number().over(inner)).withColumn("_next", F.lead("_value").over(inner))
    heads = rows.where("_at = 1").select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_block").alias("_hb"), F.col("_value").alias("_head"))
    outer = Window.partitionBy(*(f"_g{i}" for i in range(len(group)))).orderBy(flip("_hb"))
    heads = heads.withColumn("_head_next", F.lead("_head").over(outer)).drop("_head")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = rows.join(heads, [*same, F.col("_block").eqNullSafe(F.col("_hb"))], "left")
    return joined.withColumn(out, F.coalesce("_next", "_head_next")).drop("_block", "_value", "_at", "_next", "_hb", "_head_next", *(f"_g{i}" for i in range(len(group))))


def blocked_last(df: DataFrame, group: list[str], order: str, size: int, column: str) -> DataFrame:
    """df with the nulls of a column filled from the row before in its group, in blocks of `size` numbers of the order.

    No task holds more than a block's rows, and one row for each block of a group.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / size))
    inner = Window.partitionBy(*group, "_block").orderBy(order)
    rows = rows.withColumn("_own", F.last(column, ignorenulls=True).over(inner))
    ends = rows.where(F.col(column).isNotNull()).groupBy(*group, "_block").agg(F.max_by(column, order).alias("_end"))
    blocks = rows.select(*group, "_block").distinct().join(ends, [*group, "_block"], "left")
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return rows.join(blocks, [*group, "_block"]).withColumn(column, F.coalesce("_own", "_before")).drop("_block", "_own", "_before")
