"""Exact numbering of large groups without sending a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lenforge.session import written

#: Rows of the table of shifts that are broadcast, at most; a larger one is joined by a shuffle.
SENT_ROWS = 100_000


def shifted(placed: DataFrame, groups: Sequence[str], first: Column, size: Column) -> DataFrame:
    """(_p, _g0 …, _first, _before, _total): per partition and group of a sorted table, the group's first place there, and its size in the partitions before and in all.

    Partitions plus groups: a small table, whatever the rows.
    """
    counts = placed.groupBy("_part", *groups).agg(F.min(first).alias("_first"), F.sum(size).alias("_n"))
    named = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_first", "_n")
    # A constant stands for no group: the whole table is one.
    by = Window.partitionBy(*(f"_g{i}" for i in range(len(groups)))) if groups else Window.partitionBy(F.lit(0))
    return named.withColumn("_before", F.sum("_n").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_total", F.sum("_n").over(by))


def sent(table: DataFrame) -> tuple[DataFrame, bool]:
    """A small table by way of the driver, to be broadcast, and True; one of more than ``SENT_ROWS`` rows as it is, to be joined by a shuffle, and False."""
    rows = table.limit(SENT_ROWS + 1).collect()
    if len(rows) > SENT_ROWS:
        return table, False
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)), True


def same_part(groups: Sequence[str]) -> Column:
    """The condition that joins a sorted table with its shifts."""
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return same


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds the 0-based rank of each row in its group. ``order`` must be unique in a group.

    One shuffle: rows are sorted over range partitions and written with their place in the partition; ranks are the places, shifted by
    the group's first place in the partition and by its count in the partitions before.
    """
    n = partitions or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*groups, *order]
    sorted_ = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # Written, so that the place of each row stays the one its group was counted by.
    placed = written(sorted_.select(*rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")))
    few, _ = sent(shifted(placed, groups, F.col("_place"), F.lit(1)))
    rank = F.col("_place") - F.col("_first") + F.col("_before")
    return placed.join(few, same_part(groups)).withColumn(name, rank.cast("long")).select(*rows.columns, name)
