"""Breadth-first search with path counts as level-synchronous joins.

A search never gathers a frontier: a level is a table, expanding it a join with the edges and a sum by node. Levels are
rounds of one bucketed table in the shared folder, so a plan holds one expansion at a time, and testing whether a node was
reached before moves nothing that was written before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathlight.operators.levels import BUCKET_ROWS, Adjacency, LevelTable, adjacency
from pathlight.plans.lineage import cut, stored

#: Rows, of two or three numbers each, up to which what is told of open pairs is broadcast.
TOLD = 500_000


def expand(frontier: DataFrame, graph: Adjacency, seen: LevelTable, since: int = 0) -> DataFrame:
    """The next level ``(source, node, sigma, d0)``: path counts summed over the edges into nodes not seen ``since`` a level."""
    steps = graph.follow(frontier, F.lit(0), F.col("d0"), dead=True).withColumnRenamed("to", "_to")
    reached = steps.groupBy("source", F.col("_to").alias("node")).agg(F.sum("sigma").alias("sigma"), F.first("to0").alias("d0"))
    return reached.join(seen.rows(since=since).select("source", "node"), ["source", "node"], "left_anti")


def level_table(graph: Adjacency, sources: DataFrame, most: int | None = None, both_ways: bool = False) -> tuple[LevelTable, int]:
    """Levels 0, 1, ... of the searches from all ``sources(id)`` as rounds ``(source, node, sigma, d0)``, and their number.

    Where all edges are there ``both_ways``, an edge leads one level up or down at most, so no older levels are looked at.
    """
    table = LevelTable(sources.sparkSession, "levels", "source", "node", rows=min(100, graph.edges) * sources.count())
    first = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("sigma"))
    n, number = table.add(first.join(graph.degree.select("node", "d0"), "node", "left").select("source", "node", "sigma", F.coalesce("d0", F.lit(0)).alias("d0")), 0, deal=True)["n"], 0
    while n and (most is None or number < most):
        number += 1
        n = table.add(expand(table.rows(number - 1), graph, table, number - 2 if both_ways else 0), number)["n"]
    return table, max(number + (n > 0), 1)


def levels(edges: DataFrame, sources: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Levels 0, 1, ... of the searches from all ``sources(id)``, each ``(source, node, sigma)``; no empty ones."""
    graph = adjacency(edges)
    table, number = level_table(graph, sources, most)
    graph.drop()
    return [table.rows(k).select("source", "node", "sigma") for k in range(number)]


def path_counts(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """``(source, node, dist, sigma)``: distance and number of shortest paths of every node that a source reaches."""
    rows = [x.withColumn("dist", F.lit(d)) for d, x in enumerate(levels(edges, sources, most))]
    return _union(rows).select("source", "node", "dist", "sigma")


@dataclass
class PairPaths:
    """Shortest paths between pairs of nodes.

    ``lengths``: ``(pair_id, dist, sigma)`` of the pairs that are connected, sigma being the number of shortest paths.
    ``weights``: ``(pair_id, node, weight)``, the share of the pair's paths through each internal node.
    ``draws``, where paths are drawn: ``(pair_id, pos, node, n)``, the draws through each node at a distance from u.
    """

    lengths: DataFrame
    weights: DataFrame
    visited: int = 0  # edges that the searches followed
    draws: DataFrame | None = None
    rounds: list[dict] = field(default_factory=list)  # of each round of the search: open pairs and edges followed


def _of(side: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.when(F.col(side) == 0 if isinstance(side, str) else side == 0, a).otherwise(b)


def _told(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= TOLD else rows


@dataclass
class _Search:
    """All searches of a batch of pairs: ``(pair_id, node, side, level, sigma, d0, d1, other, back)``.

    ``back`` is null but where the two sides of a pair meet: there it is the other side's number of paths, and ``other``
    the other side's level.
    """

    table: LevelTable
    visited: int = 0
    rounds: list[dict] = field(default_factory=list)


def _search(graph: Adjacency, pairs: DataFrame) -> _Search:
    """Level by level; in each round every open pair goes on at the end with fewer edges to follow (ties: at u).

    Dead ends are left out where they are not the other end of the pair, so the leaves of a hub are neither followed nor
    stored; the choice of the end counts them.
    """
    guess = min(20 + math.isqrt(graph.edges), graph.edges) * pairs.count()  # nodes that a pair's search sees, some
    found = _Search(LevelTable(pairs.sparkSession, "search", "pair_id", "node", rows=guess))
    ends = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("side")), F.struct(F.col("v").alias("node"), F.lit(1).alias("side")))).alias("e"))
    first = ends.select("pair_id", "e.node", "e.side").join(graph.degree, "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = [F.lit(0).alias("level"), F.lit(1.0).alias("sigma"), zero("d0"), zero("d1"), F.lit(None).cast("int").alias("other"), F.lit(None).cast("double").alias("back")]
    found.table.add(first.select("pair_id", "node", "side", *none), 0, deal=True)
    costs = found.table.rows(0).groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, F.col("d0"))).alias("cu"), F.max(F.when(F.col("side") == 1, F.col("d1"))).alias("cv"))
    dead = first.where("dead").groupBy("pair_id").agg(*[F.max(F.when(F.col("side") == i, F.col("node"))).alias(c) for i, c in enumerate(("du", "dv"))])
    state = costs.join(dead, "pair_id", "left").select("pair_id", "cu", "cv", F.lit(0).alias("lu"), F.lit(0).alias("lv"), "du", "dv").where("cu > 0 and cv > 0")
    number = 0
    while True:
        # Open pairs, with the edges that the next round follows, are counted as they are written.
        seen = Observation()
        state = stored(state.observe(seen, F.count(F.lit(1)).alias("open_pairs"), F.sum(F.least("cu", "cv")).alias("edges")), "open")
        told = seen.get
        if not told["open_pairs"]:
            return found
        found.rounds.append(told)
        found.visited += told["edges"]
        number += 1
        at_u = F.col("cu") <= F.col("cv")
        go = state.select(
            "pair_id", F.when(at_u, 0).otherwise(1).alias("side"), F.when(at_u, F.col("lu")).otherwise(F.col("lv")).alias("level"),
            F.when(at_u, F.col("lv")).otherwise(F.col("lu")).alias("other"),
            F.when(at_u, F.col("dv")).otherwise(F.col("du")).alias("_end"),
        )
        front = found.table.rows().drop("other", "back").join(_told(go, told["open_pairs"]), ["pair_id", "side", "level"])
        front = front.withColumn("_degree", _of("side", F.col("d0"), F.col("d1"))).withColumnRenamed("side", "_from")
        steps = graph.follow(front.drop("d0", "d1"), F.col("_from"), F.col("_degree"), F.col("_end")).withColumnRenamed("node", "_node")
        # A pair moves one end in a round, so its nodes need no mark of the side to be told apart.
        reached = steps.groupBy("pair_id", F.col("to").alias("node")).agg(
            F.first("_from").alias("side"), (F.first("level") + 1).alias("level"), F.sum("sigma").alias("sigma"),
            F.first("to0").alias("d0"), F.first("to1").alias("d1"), F.first("other").alias("other"),
        )
        # The ends of an open pair have no node in common yet, so a node was reached from one of them at most.
        before = found.table.rows().select("pair_id", "node", F.col("side").alias("_side"), F.col("sigma").alias("back"))
        joined = reached.join(before, ["pair_id", "node"], "left").where("_side is null or _side <> side")
        columns = ["pair_id", "node", "side", "level", "sigma", "d0", "d1", F.when(F.col("back").isNotNull(), F.col("other")).alias("other"), "back"]
        found.table.add(joined.select(*columns), number)
        new = found.table.rows(number).groupBy("pair_id").agg(F.sum(_of("side", F.col("d0"), F.col("d1"))).alias("cost"), F.max(F.col("back").isNotNull()).alias("met"))
        after = state.join(new.where(~F.col("met")), "pair_id")  # the others have met or cannot
        moved = F.col("cu") <= F.col("cv")
        state = after.select(
            "pair_id", F.when(moved, F.col("cost")).otherwise(F.col("cu")).alias("cu"), F.when(moved, F.col("cv")).otherwise(F.col("cost")).alias("cv"),
            (F.col("lu") + moved.cast("int")).alias("lu"), (F.col("lv") + (~moved).cast("int")).alias("lv"), "du", "dv",
        ).where("cu > 0 and cv > 0")


def _flow_back(graph: Adjacency, found: _Search) -> DataFrame:
    """``(pair_id, node, pos, beta, through, d0)`` of the internal nodes of all shortest paths.

    ``pos`` is the distance from u, ``beta`` the number of paths from the node to v, ``through`` that of the pair's paths
    through it. All pairs flow back at once from where their ends met, one level a round on either side.
    """
    meet = found.table.rows().where(F.col("back").isNotNull())
    lu, lv = _of("side", F.col("level"), F.col("other")), _of("side", F.col("other"), F.col("level"))
    ahead, back = _of("side", F.col("sigma"), F.col("back")), _of("side", F.col("back"), F.col("sigma"))
    meet = meet.select("pair_id", "node", lu.alias("lu"), lv.alias("lv"), ahead.alias("ahead"), back.alias("back"), "d0", "d1")
    table = LevelTable(graph.degree.sparkSession, "paths", "pair_id", "node", rows=found.table.buckets * BUCKET_ROWS - 1)
    # At the meeting of a side the other side's paths are to come.
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lu").alias("level"), F.col("back").alias("rest")), F.struct(F.lit(1).alias("side"), F.col("lv").alias("level"), F.col("ahead").alias("rest"))))
    dist = (F.col("lu") + F.col("lv")).alias("dist")
    starts = meet.select("pair_id", "node", dist, both.alias("s"), "ahead", "back", "d0", "d1")
    starts = starts.select("pair_id", "node", "s.side", "s.level", "s.rest", F.col("back").alias("beta"), (F.col("ahead") * F.col("back")).alias("through"), "dist", "d0", "d1")
    number, n = 0, table.add(starts, 0, deal=True, n=F.count_if(F.col("level") > 1))["n"]
    while n:
        number += 1
        cur = table.rows(number - 1).where("level > 1").select("pair_id", "node", "side", "level", "rest", "dist", "d0", "d1")
        # The steps of the other side lead from a node to those before it.
        cur = cur.withColumn("_degree", _of("side", F.col("d1"), F.col("d0"))).withColumnRenamed("side", "_mine").drop("d0", "d1")
        steps = graph.follow(cur, 1 - F.col("_mine"), F.col("_degree")).withColumnRenamed("node", "_node")
        side = lambda k, c: F.when(F.col("_mine") == k, F.col(c))
        come = steps.groupBy("pair_id", F.col("to").alias("node")).agg(
            F.sum(side(0, "rest")).alias("r0"), F.sum(side(1, "rest")).alias("r1"), F.max(side(0, "level")).alias("l0"), F.max(side(1, "level")).alias("l1"), F.first("dist").alias("dist"),
        )
        of = found.table.rows().where(F.col("back").isNull()).select("pair_id", "node", "side", "level", "sigma", "d0", "d1")
        joined = come.join(of, ["pair_id", "node"]).where(F.col("level") == _of("side", F.col("l0"), F.col("l1")) - 1)
        rest = _of("side", F.col("r0"), F.col("r1"))
        made = joined.select("pair_id", "node", "side", "level", rest.alias("rest"), _of("side", rest, F.col("sigma")).alias("beta"), (F.col("sigma") * rest).alias("through"), "dist", "d0", "d1")
        n = table.add(made, number, n=F.count_if(F.col("level") > 1))["n"]
    # The node of a meeting stands there for both sides, and the ends of an edge that join two nodes are no internal ones.
    pos = _of("side", F.col("level"), F.col("dist") - F.col("level"))
    every = table.rows().select("pair_id", "node", pos.alias("pos"), "beta", "through", "dist", "d0").where("pos > 0 and pos < dist")
    out = cut(every.drop("dist").dropDuplicates(["pair_id", "node"]))
    table.drop()
    return out


def spread(pair_id: Column, node: Column, seed: int) -> Column:
    """A number from 0 to 1 for a pair and a node: 52 bits of an MD5, the same in any engine."""
    text = F.md5(F.concat(F.lit(f"{seed}:d:"), pair_id.cast("string"), F.lit(":"), node.cast("string")).cast("binary"))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _draw(graph: Adjacency, pairs: DataFrame, lengths: DataFrame, on_path: DataFrame, alpha: float, seed: int) -> DataFrame:
    """``(pair_id, pos, node, n, draws)``: how many of a pair's draws go through its nodes.

    Draws go down from u level by level as counts, never as rows of their own. At a node of n draws and beta paths ahead
    the next nodes, in their order, get the whole numbers that floor(n C / beta + U) passes, C being the sum of their
    paths so far and U the node's ``spread``. So each next node gets its share of the n in the mean, every path is as
    likely as any other, and a single draw is one path drawn uniformly.
    """
    guess = 5 * lengths.count()
    table = LevelTable(graph.degree.sparkSession, "draws", "pair_id", "node", rows=guess)
    n = F.greatest(F.lit(1.0), F.floor(F.lit(alpha) * F.col("sigma")).cast("double"))
    first = lengths.where("dist > 1").select("pair_id", n.alias("n"), F.col("sigma").alias("beta")).join(pairs.select("pair_id", F.col("u").alias("node")), "pair_id")
    first = first.join(graph.degree.select("node", "d0"), "node").select("pair_id", "node", F.lit(0).alias("pos"), "n", "beta", F.col("n").alias("draws"), "d0")
    number, left = 0, table.add(first, 0, deal=True)["n"]
    paths = LevelTable(graph.degree.sparkSession, "on_path", "pair_id", "node", rows=guess)
    paths.add(on_path.select("pair_id", "node", "pos", "beta", "d0"), 0, deal=True)
    while left:
        cur = table.rows(number).select("pair_id", F.col("node"), "pos", "n", F.col("beta").alias("all"), "draws", "d0")
        steps = graph.follow(cur, F.lit(0), F.col("d0")).select("pair_id", F.col("node").alias("_from"), (F.col("pos") + 1).alias("_pos"), "n", "all", "draws", F.col("to").alias("node"))
        ahead = steps.join(paths.rows(), ["pair_id", "node"]).where(F.col("pos") == F.col("_pos"))
        run = Window.partitionBy("pair_id", "_from").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        split = ahead.withColumn("_sum", F.sum("beta").over(run)).withColumn("_u", spread(F.col("pair_id"), F.col("_from"), seed))
        upto = lambda c: F.floor(F.col("n") * c / F.col("all") + F.col("_u"))
        got = split.withColumn("_k", (upto(F.col("_sum")) - upto(F.col("_sum") - F.col("beta"))).cast("double")).where("_k > 0")
        nxt = got.groupBy("pair_id", "node").agg(F.first("pos").alias("pos"), F.sum("_k").alias("n"), F.first("beta").alias("beta"), F.first("draws").alias("draws"), F.first("d0").alias("d0"))
        number += 1
        left = table.add(nxt, number)["n"]
    out = cut(table.rows().where("pos > 0").select("pair_id", "pos", "node", "n", "draws"))
    table.drop()
    paths.drop()
    return out


def pair_paths(edges: DataFrame | Adjacency, pairs: DataFrame, mode: str = "exact", alpha: float = 2.3, seed: int = 1) -> PairPaths:
    """Bidirectional search between ``pairs(pair_id, u, v)``.

    In each round every open pair expands the end whose frontier has fewer edges (ties: the end u), in one join for both
    ends of all pairs, until its two ends meet; a pair whose frontier is empty is not connected. All shortest paths
    cross the level at which the frontiers meet, so their number is the sum of the products of both counts there, and
    the counts flow back from it, level by level on each side.

    ``mode`` tells what a pair contributes: ``exact`` all its paths in equal shares, ``single`` one path drawn
    uniformly, ``multi`` as many draws as ``alpha`` times the number of paths, one at least. Pairs of a node with itself,
    and of nodes without an edge, are not connected. ``edges`` may be the ``Adjacency`` of a graph that is searched often.
    """
    pairs = pairs.where("u <> v")
    graph = edges if isinstance(edges, Adjacency) else adjacency(edges)
    found = _search(graph, pairs)
    meet = found.table.rows().where(F.col("back").isNotNull())
    lengths = cut(meet.groupBy("pair_id").agg(F.max(F.col("level") + F.col("other")).alias("dist"), F.sum(F.col("sigma") * F.col("back")).alias("sigma")))
    on_path = _flow_back(graph, found)
    draws = None
    if mode == "exact":
        total = lengths.select("pair_id", F.col("sigma").alias("total"))
        weights = cut(on_path.join(total, "pair_id").select("pair_id", "node", (F.col("through") / F.col("total")).alias("weight")))
    else:
        draws = _draw(graph, pairs, lengths, on_path, alpha if mode == "multi" else 0.0, seed)
        weights = draws.select("pair_id", "node", (F.col("n") / F.col("draws")).alias("weight"))
        draws = draws.drop("draws")
    found.table.drop()
    if graph is not edges:
        graph.drop()
    return PairPaths(lengths, weights, found.visited, draws, found.rounds)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
