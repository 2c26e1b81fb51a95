"""Degrees, dense ids and replayable samples of node pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.operators.ranking import global_row_number
from pathlight.sources.graphs import nodes_of


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, out_degree, in_degree)`` of every node, 0 where there is no edge; one shuffle of both ends."""
    ends = edges.select(F.explode(F.array(F.struct("src", F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("src"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.src").alias("id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    if nodes is None:
        return counts
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return nodes.join(counts, "id", "left").select("id", zero("out_degree"), zero("in_degree"))


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``(id, neighbour)`` along the edges for the nodes ``of(id)``."""
    return of.join(edges, of["id"] == edges["src"]).select("id", F.col("dst").alias("neighbour"))


def dense_ids(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, dense_id)``: 0, 1, ... in the order of the ids."""
    return global_row_number(nodes_of(edges) if nodes is None else nodes, [F.col("id")], "dense_id").select("id", "dense_id")


def renumber(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges in dense ids."""
    a = ids.select(F.col("id").alias("src"), F.col("dense_id").alias("a"))
    b = ids.select(F.col("id").alias("dst"), F.col("dense_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _draw(key: str, index: Column, n: int) -> Column:
    """A number below ``n``: 60 bits of an MD5 of the key and a counter, the same in any engine, modulo ``n``."""
    digest = F.substring(F.md5(F.concat(F.lit(key), index.cast("string")).cast("binary")), 1, 15)
    return F.conv(digest, 16, 10).cast("long") % n


def sample_pairs(spark: SparkSession, n: int, start: int, stop: int, seed: int, phase: int = 0) -> DataFrame:
    """``(pair_id, u, v)`` in dense ids, ``u`` and ``v`` different, for the counters ``start`` to ``stop``.

    Each pair depends on seed, phase and counter alone, so batches can be drawn anew and never overlap.
    """
    if n < 2:
        return spark.range(0, 0).select(F.col("id").alias("pair_id"), F.col("id").alias("u"), F.col("id").alias("v"))
    u = _draw(f"{seed}:{phase}:u:", F.col("id"), n)
    v = _draw(f"{seed}:{phase}:v:", F.col("id"), n - 1)
    rows = spark.range(start, stop).select(F.col("id").alias("pair_id"), u.alias("u"), v.alias("v"))
    return rows.withColumn("v", F.col("v") + F.when(F.col("v") >= F.col("u"), 1).otherwise(0))


def rademacher_signs(pair_id: Column, seed: int, trials: int) -> Column:
    """An array of ``trials`` signs of a sample, +1 or -1, shared by all nodes of the sample."""
    text = F.md5(F.concat(F.lit(f"{seed}:r:"), pair_id.cast("string")).cast("binary"))
    bits = F.conv(F.substring(text, 1, 15), 16, 10).cast("long")
    return F.array(*[(F.shiftrightunsigned(bits, j).bitwiseAND(F.lit(1)) * 2 - 1).cast("double") for j in range(trials)])
