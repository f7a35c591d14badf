"""Numbers for all rows of a table in a stated order, without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestep.llm._shared import Scratch, fresh


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in ``order``, the same however the table is split; rows that tie are in any order.

    Rows go to ranges of the order, are sorted within them and written with their range and place; a range starts where those
    before it end. Rows that tie are spread over ranges by where they were read, so a key that a third of the rows hold is not one task's. What is
    broadcast is one row of 16 bytes a range, and a shuffle has a set number of those.
    """
    spread, place, part, start = fresh(df, "order_spread", "order_place", "order_part", "order_start")
    keys = [*order, F.col(spread)]
    dealt = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = scratch.write(dealt.withColumn(place, F.monotonically_increasing_id()).drop(spread))  # partition in the high bits, place in it in the low 33
    written = written.withColumn(part, F.shiftright(place, 33))
    sizes = written.groupBy(part).agg(F.count("*").alias(start))
    before = F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias(start))
    row = F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(F.broadcast(starts), part).select(*[written[f"`{c}`"] for c in df.columns], row.alias(name))
