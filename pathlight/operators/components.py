"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.operators.skew import split_join
from pathlight.plans.lineage import cut

#: Edge sets of at most so many rows, two numbers each, are one partition: rounds of them shuffle nothing.
ONE_PARTITION = 100_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _joined(rows: DataFrame, low: DataFrame, n_edges: int) -> DataFrame:
    return rows.join(low.drop("n"), "a") if n_edges <= ONE_PARTITION else split_join(cut(rows), cut(low), ["a"], "n")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every endpoint with the smallest id that it can reach, edges taken as undirected.

    Returns ``(node, component)``. Edges with a null end and self-loops link nothing; a node that has only those is
    not in the result, and no edges give no rows. Each round hangs every neighbour of a node on its smallest
    neighbour, once over the larger and once over the smaller ones, so the number of rounds is logarithmic in
    practice. Only joins and aggregates are used: no group is gathered in one task, those of a hub neither, whose
    smallest neighbour is told to all tasks; and the edge set (at most as large as the input) is written to the
    checkpoint folder once a round.
    """
    a, b = F.col(src), F.col(dst)
    cur = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        a.isNotNull() & b.isNotNull() & (a != b)
    )
    cur = cut(cur.distinct())
    seen = _digest(cur)
    one = seen[0] <= ONE_PARTITION  # the edges become no more
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if one else both
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = _joined(both.where("b > a"), low, seen[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined(large, low, seen[0])
        nxt = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = nxt.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        cur = cut((nxt.coalesce(1) if one else nxt).distinct())
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
