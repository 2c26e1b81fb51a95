"""Global row numbers and running sums without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlight.plans.lineage import cut


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` and written to the checkpoint folder; ``_at`` is a row's place.

    The place is the partition in the high bits and the row in it in the low 33, fixed once the rows are written.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("_at", F.monotonically_increasing_id()))


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``order``. Rows that tie get neighbouring numbers in an arbitrary order.

    One range shuffle; then the row counts of the partitions (one small row each) are summed before each partition.
    """
    placed = _ordered(df, order).withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row = F.col("_at") - F.shiftleft("_part", 33)
    return placed.join(offsets, "_part").withColumn(name, F.col("_off") + row).drop("_at", "_part", "_off")


def running_sum_before(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``group`` that come before in ``order``.

    Nulls in ``group`` are one group. A group of any size is spread over range partitions: each partition's sum for a
    group gives the offset of the next ones, and a window runs only inside one partition's part of a group.
    """
    placed = _ordered(df, [F.col(group), *order]).withColumn("_part", F.shiftrightunsigned("_at", 33))
    sums = placed.groupBy(group, "_part").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(offsets, local[group].eqNullSafe(offsets["_g"]) & (local["_part"] == offsets["_p"]))
    return joined.withColumn(name, F.col("_off") + F.col("_in")).drop("_at", "_part", "_in", "_off", "_g", "_p")


def with_next(df: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """Add ``next_<name>`` for each of ``names``: its value in the row that follows in ``order``, null after the last.

    A window runs only inside one range partition; what follows its last row is the first row of the next partition
    that has any, found among one small row for each partition.
    """
    placed = _ordered(df, order).withColumn("_part", F.shiftrightunsigned("_at", 33))
    row = F.struct(*names)
    firsts = placed.groupBy("_part").agg(F.min_by(row, "_at").alias("_first"))
    after = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_over"))
    local = placed.withColumn("_in", F.lead(row).over(Window.partitionBy("_part").orderBy("_at")))
    joined = local.join(after, "_part").withColumn("_next", F.coalesce("_in", "_over"))
    return joined.select(*df.columns, *[F.col(f"_next.{name}").alias(f"next_{name}") for name in names])
