"""Joins and first rows of groups whose keys may be as frequent as a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has more than one of so many parts of the rows, and more rows than this.
PARTS, LEAST = 100_000, 1_000


def split_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has each of the ``keys`` once.

    ``weight``, a column of ``facts`` that is not in the result, is the number of rows of the key. The facts of hot keys,
    of which there are fewer than ``parts`` by their definition, are broadcast; the rows of all others are shuffled, so
    no key gathers more rows in a task than a ``parts``-th of all, or ``least``. Null keys join nothing. ``facts`` is
    read several times and should be written.
    """
    total, most = facts.agg(F.sum(weight), F.max(weight)).first()
    limit = max(least, (total or 0) / parts)
    if (most or 0) <= limit:
        return rows.join(facts.drop(weight), keys)
    hot, cold = facts.where(F.col(weight) > limit).drop(weight), facts.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


#: Hash slots that the rows of groups are counted by, and the share of all rows beyond which a slot is dealt in slices.
SLOTS, SLICE_PARTS = 65_536, 2_000


def least_in_group(rows: DataFrame, keys: list[str], value: str, order: Column, name: str, least: int = LEAST) -> DataFrame:
    """Add ``name``: whether ``value`` is the first of its group in ``order``, an ordering of ``value`` alone.

    Rows are range-partitioned by the hash of the ``keys`` and sorted by key and value, so a group is a run of rows
    that a window streams over. Slots of the hash that hold over a ``SLICE_PARTS``-th of all rows (fewer than
    ``SLICE_PARTS`` by their definition, and told to all tasks) are dealt in slices by the value: a row that is not
    the first of its slice is not the first of the group, and the firsts of the slices, few rows, are compared again.
    Nulls in ``keys`` and in ``value`` are values. Rows with the least value are all marked. ``rows`` is read several
    times and should be written.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*keys))
    slot = F.pmod(F.col("_h"), F.lit(SLOTS)).alias("_slot")
    counts = hashed.groupBy(slot).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(least, (total or 0) // SLICE_PARTS)
    hot = (most or 0) > limit
    if hot:
        slices = counts.where(F.col("n") > limit).select("_slot", F.ceil(F.col("n") / limit).alias("_slices"))
        hashed = hashed.withColumn("_slot", slot).join(F.broadcast(slices), "_slot", "left")
        hashed = hashed.withColumn("_salt", F.pmod(F.xxhash64(value), F.coalesce("_slices", F.lit(1)))).drop("_slot")
    else:
        hashed = hashed.withColumn("_slices", F.lit(None).cast("long")).withColumn("_salt", F.lit(0).cast("long"))
    dealt = hashed.repartitionByRange("_h", "_salt")

    def first(frame: DataFrame, by: list[str]) -> DataFrame:
        run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return frame.withColumn(name, F.col(value).eqNullSafe(F.first(value).over(run)))

    found = first(dealt, ["_h", "_salt", *keys])
    if hot:
        open_ = F.col("_slices").isNotNull() & F.col(name)
        again = first(found.where(open_).drop(name), ["_h", *keys])
        found = found.where(~open_).unionByName(again)
    return found.drop("_h", "_salt", "_slices")
