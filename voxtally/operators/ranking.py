"""Exact ranks without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.session import bounded_broadcast, written

_ROW_BITS = 33


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in the given order, which must be total (end in a unique key).

    A window without partitions would pull everything into one task. Here Spark's range sort
    spreads the rows over all partitions, cutting inside runs of equal leading values too, as
    the unique key is part of the order. Each row then holds its partition and its place there;
    the sizes of the partitions, one row each, turn that into the global number. The sorted rows are
    written out so that both reads see the same partitions even if executors are lost.
    Select only the needed columns first: all that is passed in gets sorted.
    """
    slots = written(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    partition = F.shiftright("_slot", _ROW_BITS)
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy(partition.alias("_partition"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        slots.withColumn("_partition", partition)
        .join(bounded_broadcast(offsets), "_partition")
        .withColumn(name, F.col("_offset") + place + 1)
        .drop("_partition", "_offset", "_slot")
    )


def top_per_group(
    df: DataFrame, group: str, order: list[Column], k: int, spread_by: str, spread: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``.

    A group is first cut into ``spread`` parts by the hash of ``spread_by`` and each part keeps
    its own first ``k``; the final rank sees ``spread * k`` rows of a group at most, however
    large the group is.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(spread))
    in_part = Window.partitionBy(group, "_part").orderBy(*order)
    in_group = Window.partitionBy(group).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_rank", F.row_number().over(in_part))
        .filter(F.col("_rank") <= k)
        .drop("_rank", "_part")
        .withColumn("rank", F.row_number().over(in_group))
        .filter(F.col("rank") <= k)
    )
