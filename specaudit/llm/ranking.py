"""Places and running totals over a whole table without one task that sees all rows.

Rows are dealt to ranges of the order, sorted in each range and written with their place in it; a range's totals
are one short row, and those of the ranges before it are added.  The driver sees nothing but the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import materialize

#: A row's place: ``monotonically_increasing_id`` holds the partition above 33 bits of the row's number in it.
_ROW_BITS = 33


def ordered(df: DataFrame, *order: Column, label: str) -> DataFrame:
    """``df`` written in order, with ``range`` and ``at`` (from 0 in its range)."""
    place = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.monotonically_increasing_id())
    return materialize(place.select(*df.columns, F.shiftright("range", _ROW_BITS).alias("range"), F.col("range").bitwiseAND((1 << _ROW_BITS) - 1).alias("at")), label)


def with_rank(df: DataFrame, name: str) -> DataFrame:
    """A table of :func:`ordered` with each row's place in the whole order, from 0, instead of the place in its range."""
    sizes = df.groupBy("range").agg(F.count(F.lit(1)).alias("__n"))
    # one row a range: a window over them all is as small as the number of partitions
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return df.join(F.broadcast(first), "range").select(*(c for c in df.columns if c not in ("range", "at")), (F.col("__first") + F.col("at")).alias(name))


def running_total(df: DataFrame, measure: Column, keys: list[str], chunk: str, *order: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``measure`` over the rows of the same keys that precede a row.

    ``chunk`` is a column whose order agrees with ``order`` and that splits a key's rows, so that a hot key is summed on
    many tasks; a key has few chunks by construction.
    """
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    chunks = df.groupBy(*keys, chunk).agg(F.sum(measure).alias("__sum"))
    first = chunks.select(*keys, chunk, F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__first"))
    inside = df.withColumn("__inside", F.coalesce(F.sum(measure).over(inner), F.lit(0)))
    return inside.join(first, [*keys, chunk]).withColumn("before", F.col("__first") + F.col("__inside")).drop("__first", "__inside")
