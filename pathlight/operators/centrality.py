"""Betweenness centrality: exact, sampled, and the aggregates that its stopping rules need."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.functions.bounds import TRIALS
from pathlight.operators import classes as Q
from pathlight.operators.levels import Adjacency, LevelTable, adjacency
from pathlight.operators.shape import rademacher_signs
from pathlight.operators.traversal import level_table
from pathlight.plans.lineage import cut, removed, scratch_path, shuffles_end_with_queries

#: Pairs of a source and a node that exact centrality holds at once, about; one source's are held in any case.
PAIRS = 100_000_000


def exact_betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, bc)`` of every node: the mean over all ordered pairs of the share of shortest paths through it.

    Endpoints do not count; unreachable pairs count as 0. One search from every node forward, then the dependencies
    flow back level by level: a node passes ``sigma(v) / sigma(w) * (1 + dependency(w))`` to each predecessor. The
    work is the number of reachable pairs times the degree, so this is for checking and for small graphs. Sources are
    taken in batches of about ``PAIRS`` pairs, whose tables are deleted before the next, so the space is bounded. Where
    half of the nodes or more are told by others, in rows or as twins, the searches are those of the classes of nodes.
    """
    nodes = cut(nodes.select("id"))
    n = nodes.count()
    scale = 1.0 / (n * (n - 1)) if n > 1 else 0.0
    few = Q.fewer(edges)
    if few is not None:
        through = nodes.select(F.col("id").alias("node")).join(Q.betweenness(few), "node", "left")
        return cut(through.select("node", (F.coalesce("through", F.lit(0.0)) * scale).alias("bc")))
    graph = adjacency(edges)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both_ways = edges.join(turned, ["src", "dst"], "left_anti").isEmpty()
    batches = max(1, math.ceil(n * n / PAIRS))
    sums = LevelTable(edges.sparkSession, "sums", "node", rows=n)
    sums.add(nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("dep")), 0, deal=True)
    with shuffles_end_with_queries(edges.sparkSession):
        for i in range(batches):
            sources = nodes.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
            for found in _dependencies(edges, graph, sources, both_ways):
                sums.add(found, 1)
    graph.drop()
    total = cut(sums.rows().groupBy("node").agg(F.sum("dep").alias("dep")))
    sums.drop()
    return total.select("node", (F.col("dep") * scale).alias("bc"))


def _dependencies(edges: DataFrame, graph: Adjacency, sources: DataFrame, both_ways: bool) -> Iterator[DataFrame]:
    """``(node, dep)``, summed over the ``sources``, level by level from the deepest; each is to be used before the next."""
    spark = edges.sparkSession
    table, number = level_table(graph, sources, both_ways=both_ways)
    deeper, kept = table.rows(number - 1).select("source", "node", "sigma", F.lit(0.0).alias("dep")), []
    for d in range(number - 2, 0, -1):
        passed = deeper.select("source", F.col("node").alias("to"), ((1 + F.col("dep")) / F.col("sigma")).alias("give"))
        into = passed.join(edges, passed["to"] == edges["dst"]).groupBy("source", F.col("src").alias("node")).agg(F.sum("give").alias("got"))
        cur = table.rows(d).join(into, ["source", "node"], "left")
        made = cur.select("source", "node", "sigma", (F.col("sigma") * F.coalesce("got", F.lit(0.0))).alias("dep"))
        path = scratch_path(spark, "dependencies")
        made.write.option("compression", "zstd").parquet(path)
        deeper = spark.read.schema(made.schema).parquet(path)
        if kept:
            removed(spark, kept.pop())
        kept.append(path)
        yield deeper.groupBy("node").agg(F.sum("dep").alias("dep"))
    for path in kept:
        removed(spark, path)
    table.drop()


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the greatest ``bc``; ties go to the smaller id."""
    return scores.orderBy(F.desc("bc"), "node").limit(k)


def node_sums(weights: DataFrame, seed: int, trials: int = TRIALS) -> DataFrame:
    """``(node, sum_w, sum_w2, hits, rade)`` over ``(pair_id, node, weight)``.

    ``rade`` are the signed sums of the Rademacher trials: a sample has one sign a trial, the same for all its nodes.
    """
    signed = weights.where("weight > 0").withColumn("signs", rademacher_signs(F.col("pair_id"), seed, trials))
    sums = [F.sum(F.col("signs")[j] * F.col("weight")) for j in range(trials)]
    return signed.groupBy("node").agg(
        F.sum("weight").alias("sum_w"),
        F.sum(F.col("weight") * F.col("weight")).alias("sum_w2"),
        F.count("*").alias("hits"),
        F.array(*sums).alias("rade"),
    )


def add_sums(a: DataFrame | None, b: DataFrame) -> DataFrame:
    """Running totals of ``node_sums`` after another batch."""
    if a is None:
        return cut(b)
    trials = TRIALS
    both = a.unionByName(b)
    return cut(
        both.groupBy("node").agg(
            F.sum("sum_w").alias("sum_w"),
            F.sum("sum_w2").alias("sum_w2"),
            F.sum("hits").alias("hits"),
            F.array(*[F.sum(F.col("rade")[j]) for j in range(trials)]).alias("rade"),
        )
    )


def peeled(nodes: DataFrame, sums: DataFrame, m: int, base: float) -> DataFrame:
    """``(node, part)``: partitions of all nodes by the order of magnitude of their second moment."""
    moment = F.coalesce("sum_w2", F.lit(0.0)) / m
    inverse = F.least(1 / F.nullif(moment, F.lit(0.0)), F.lit(float(m)))  # m where the moment is 0
    part = F.lit(0) if base <= 1 else F.floor(F.log(inverse) / F.log(F.lit(base)) + 1).cast("int")
    return nodes.select(F.col("id").alias("node")).join(sums.select("node", "sum_w2"), "node", "left").select("node", part.alias("part"))


def partition_maxima(parts: DataFrame, sums: DataFrame) -> DataFrame:
    """``(part, nodes, max_w, max_w2, max_rade)``: suprema over all nodes, those never hit counting as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = parts.join(sums, "node", "left")
    return joined.groupBy("part").agg(
        F.count("*").alias("nodes"),
        F.max(zero("sum_w")).alias("max_w"),
        F.max(zero("sum_w2")).alias("max_w2"),
        F.array(*[F.max(zero(F.col("rade")[j])) for j in range(TRIALS)]).alias("max_rade"),
    )


def mcera(maxima: DataFrame, m: int) -> DataFrame:
    """``(part, nodes, wimpy, mcera)`` after ``m`` samples: largest second moment, mean of the trials' suprema."""
    mean = F.aggregate("max_rade", F.lit(0.0), lambda a, x: a + x) / F.size("max_rade") / m
    return maxima.select("part", "nodes", (F.col("max_w2") / m).alias("wimpy"), mean.alias("mcera"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``(internal, pairs)`` of connected pairs, ``internal`` the nodes inside their paths; adjacent pairs have 0."""
    return lengths.groupBy((F.col("dist") - 1).alias("internal")).agg(F.count("*").alias("pairs"))
