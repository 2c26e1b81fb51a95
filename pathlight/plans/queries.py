"""The registered queries of the graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.operators import centrality as C
from pathlight.operators import chains as H
from pathlight.operators import classes as Q
from pathlight.operators import condensation as K
from pathlight.operators import shape as S
from pathlight.operators import traversal as T
from pathlight.plans import progressive as P
from pathlight.plans.lineage import cut
from pathlight.sources import fixtures as X
from pathlight.sources import graphs as G

#: Samples, seed and partition base of the replayable sampling queries.
SAMPLES, SEED, PEEL = 2_000, 42, 2.0
ROUND = 9


def _user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.simplify(X.user_seq(spark, sf_dir)))


def _gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.simplify(X.user_gap(spark, sf_dir, 4)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.simplify(X.page_link(spark, sf_dir), directed=False))


def edges_dedup(spark, sf_dir):
    return G.simplify(X.cust_seq(spark, sf_dir))


def edges_symmetrised(spark, sf_dir):
    return G.simplify(X.supp_part(spark, sf_dir), directed=False)


def graph_summary(spark, sf_dir):
    return G.graph_summary(cut(G.simplify(X.supp_part(spark, sf_dir), directed=False)))


def degrees(spark, sf_dir):
    edges = X.cust_seq(spark, sf_dir)
    return S.degrees(edges, G.nodes_of(edges))


def dense_ids(spark, sf_dir):
    return S.dense_ids(X.supp_part(spark, sf_dir))


def dense_edges(spark, sf_dir):
    edges = cut(X.supp_part(spark, sf_dir))
    return S.renumber(edges, S.dense_ids(edges))


def isolated_nodes(spark, sf_dir):
    """Ids from 0 to the greatest one that no edge has."""
    edges = cut(X.cust_seq(spark, sf_dir))
    return G.nodes_of(edges, dense=True).join(G.nodes_of(edges), "id", "left_anti")


def components_undirected(spark, sf_dir):
    edges = _pages(spark, sf_dir)
    return K.weak_components(edges, G.nodes_of(edges))


def components_forest(spark, sf_dir):
    edges = cut(G.simplify(X.geo_forest(spark, sf_dir), directed=False))
    return K.weak_components(edges, G.nodes_of(edges))


def _scc(spark, sf_dir):
    edges = _gap(spark, sf_dir)
    return edges, cut(K.strong_components(edges, G.nodes_of(edges)))


def scc(spark, sf_dir):
    return _scc(spark, sf_dir)[1]


def condensation(spark, sf_dir):
    return K.condensation(*_scc(spark, sf_dir))


def pivots(spark, sf_dir):
    return K.pivots(*_scc(spark, sf_dir))


def pivot_ecc(spark, sf_dir):
    return K.pivot_eccentricities(*_scc(spark, sf_dir))


def diameter_bound(spark, sf_dir):
    bound = K.diameter_bound(*_scc(spark, sf_dir))
    return spark.range(1).select(F.lit(bound).cast("long").alias("diameter_bound"))


def bfs_levels(spark, sf_dir):
    """Nodes at each distance from the node of the most edges of every strong component."""
    edges, comps = _scc(spark, sf_dir)
    starts = K.pivots(edges, comps).select(F.col("pivot").alias("id"))
    found = T.path_counts(edges, starts)
    return found.groupBy("source", F.col("dist").cast("long").alias("dist")).agg(F.count("*").alias("nodes"))


def path_counts(spark, sf_dir):
    edges = _user(spark, sf_dir)
    nodes = cut(G.nodes_of(edges))
    few = Q.fewer(edges)
    found = T.path_counts(edges, nodes) if few is None else Q.path_counts(few)
    return found.select("source", "node", F.col("dist").cast("long").alias("dist"), F.col("sigma").cast("double").alias("sigma"))


def _exact(edges: DataFrame) -> DataFrame:
    return C.exact_betweenness(edges, cut(G.nodes_of(edges)))


def bc_exact_directed(spark, sf_dir):
    return _exact(_user(spark, sf_dir)).select("node", F.round("bc", ROUND).alias("bc"))


def bc_exact_undirected(spark, sf_dir):
    return _exact(_pages(spark, sf_dir)).select("node", F.round("bc", ROUND).alias("bc"))


def bc_topk_exact(spark, sf_dir):
    return C.top_nodes(_exact(_user(spark, sf_dir)), 10).select("node", F.round("bc", ROUND).alias("bc"))


def _sample(edges: DataFrame):
    """Dense ids, pairs and paths of the replayable sample."""
    ids = cut(S.dense_ids(edges))
    dense = cut(S.renumber(edges, ids))
    pairs = cut(S.sample_pairs(edges.sparkSession, ids.count(), 0, SAMPLES, SEED))
    return ids, pairs, T.pair_paths(dense, pairs)


def _node_ids(ids: DataFrame, rows: DataFrame) -> DataFrame:
    back = ids.select(F.col("id"), F.col("dense_id").alias("node"))
    return rows.join(back, "node").drop("node").withColumnRenamed("id", "node")


def sample_pairs(spark, sf_dir):
    n = G.nodes_of(_user(spark, sf_dir)).count()
    return S.sample_pairs(spark, n, 0, SAMPLES, SEED)


def pair_sigma(spark, sf_dir):
    _, _, paths = _sample(_gap(spark, sf_dir))
    return paths.lengths.select("pair_id", F.col("dist").cast("long").alias("dist"), "sigma")


def void_samples(spark, sf_dir):
    """Samples without an internal node, unreachable or adjacent."""
    _, pairs, paths = _sample(_gap(spark, sf_dir))
    joined = pairs.join(paths.lengths, "pair_id", "left")
    return joined.agg(
        F.count_if(F.col("dist").isNull()).alias("unreachable"), F.count_if(F.col("dist") == 1).alias("adjacent"), F.count_if(F.col("dist") > 1).alias("with_path")
    )


def path_length_hist(spark, sf_dir):
    _, _, paths = _sample(_gap(spark, sf_dir))
    return C.length_histogram(paths.lengths).select(F.col("internal").cast("long").alias("internal"), "pairs")


def _sums(spark, sf_dir):
    ids, _, paths = _sample(_user(spark, sf_dir))
    return ids, C.node_sums(paths.weights, SEED)


def bc_sampled(spark, sf_dir):
    ids, sums = _sums(spark, sf_dir)
    return _node_ids(ids, sums.select("node", F.round(F.col("sum_w") / SAMPLES, ROUND).alias("bc")))


def wimpy_variance(spark, sf_dir):
    ids, sums = _sums(spark, sf_dir)
    return _node_ids(ids, sums.select("node", "hits", F.round(F.col("sum_w2") / SAMPLES, ROUND).alias("second_moment")))


def rademacher_sums(spark, sf_dir):
    ids, sums = _sums(spark, sf_dir)
    rows = sums.select("node", F.posexplode("rade").alias("trial", "signed"))
    return _node_ids(ids, rows.select("node", F.col("trial").cast("long").alias("trial"), F.round("signed", ROUND - 3).alias("signed")))


def _parts(spark, sf_dir):
    ids, sums = _sums(spark, sf_dir)
    sums = cut(sums)
    nodes = ids.select(F.col("dense_id").alias("id"))
    return ids, sums, C.peeled(nodes, sums, SAMPLES, PEEL)


def peeling_partitions(spark, sf_dir):
    _, _, parts = _parts(spark, sf_dir)
    return parts.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("nodes"))


def _mcera(spark, sf_dir):
    _, sums, parts = _parts(spark, sf_dir)
    return C.mcera(C.partition_maxima(parts, sums), SAMPLES)


def mcera_by_partition(spark, sf_dir):
    rows = _mcera(spark, sf_dir)
    return rows.select(
        F.col("part").cast("long").alias("part"), "nodes", F.round("wimpy", ROUND).alias("wimpy"), F.round("mcera", ROUND).alias("mcera")
    )


def eps_by_partition(spark, sf_dir):
    from pathlight.functions.bounds import rademacher_eps

    rows = _mcera(spark, sf_dir).collect()
    found = [(r["part"], rademacher_eps(r["wimpy"], r["mcera"], 0.05 / len(rows), SAMPLES, r["nodes"])) for r in rows]
    return spark.createDataFrame(found, "part long, eps double").select("part", F.round("eps", 7).alias("eps"))


def rho_bound(spark, sf_dir):
    from pathlight.functions import bounds as B

    given = _gap(spark, sf_dir)
    ids = cut(S.dense_ids(given))
    edges, nodes = cut(S.renumber(given, ids)), ids.select(F.col("dense_id").alias("id"))
    comps = cut(K.strong_components(edges, nodes))
    near = H.near(edges, nodes)
    diameter = K.diameter_bound(edges, comps, near and near.eccentricities(edges, comps))
    pairs = cut(S.sample_pairs(spark, ids.count(), 0, SAMPLES, SEED))
    paths = near.pair_paths(pairs) if near else T.pair_paths(edges, pairs)
    hist = {r["internal"]: r["pairs"] for r in C.length_histogram(paths.lengths).collect()}
    mean, var = B.path_moments(hist, SAMPLES)
    row = [(mean, var, B.rho_bound(hist, diameter, SAMPLES, 0.05))]
    made = spark.createDataFrame(row, "mean double, variance double, rho double")
    return made.select(*[F.round(c, 7).alias(c) for c in made.columns])


def top1_bound(spark, sf_dir):
    from pathlight.functions.bounds import top_bound

    _, sums = _sums(spark, sf_dir)
    r = sums.agg(F.max("sum_w").alias("a"), F.max("sum_w2").alias("b")).first()
    tops = [((r["a"] or 0.0) / SAMPLES, (r["b"] or 0.0) / SAMPLES)]
    rows = [(a, top_bound(a, 0.05, SAMPLES), b, top_bound(b, 0.05, SAMPLES)) for a, b in tops]
    made = spark.createDataFrame(rows, "top_bc double, top_bc_bound double, top_moment double, top_moment_bound double")
    return made.select(*[F.round(c, 7).alias(c) for c in made.columns])


def _drawn(edges: DataFrame, mode: str, alpha: float) -> DataFrame:
    """``(node, draws, bc)``: draws through each node over all samples, and the mean share of a sample's draws."""
    ids = cut(S.dense_ids(edges))
    dense = cut(S.renumber(edges, ids))
    pairs = cut(S.sample_pairs(edges.sparkSession, ids.count(), 0, SAMPLES, SEED))
    paths = T.pair_paths(dense, pairs, mode, alpha, SEED)
    shares = paths.weights.join(paths.draws, ["pair_id", "node"]).groupBy("node")
    sums = shares.agg(F.sum("n").cast("long").alias("draws"), (F.sum("weight") / SAMPLES).alias("bc"))
    return _node_ids(ids, sums).select("node", "draws", F.round("bc", ROUND).alias("bc"))


def bc_single_path(spark, sf_dir):
    """One uniformly drawn path for each sample."""
    return _drawn(_user(spark, sf_dir), "single", 0.0)


def bc_multi_path(spark, sf_dir):
    """Several drawn paths for each sample, 2.3 times their number."""
    return _drawn(cut(G.simplify(X.supp_part(spark, sf_dir), directed=False)), "multi", 2.3)


def _within(scores: DataFrame, exact: DataFrame, eps: float) -> DataFrame:
    """``(node, within_eps, covered)``: whether a score is within ``eps`` of the exact one and its bounds hold it."""
    joined = exact.select("node", F.col("bc").alias("exact")).join(scores, "node", "left")
    inside = F.col("exact").between(F.col("lower") - 1e-12, F.col("upper") + 1e-12)
    close = F.abs(F.col("bc") - F.col("exact")) <= eps
    return joined.select("node", F.coalesce(close, F.lit(False)).alias("within_eps"), F.coalesce(inside, F.lit(False)).alias("covered"))


def bc_absolute(spark, sf_dir):
    """Every node's score by progressive sampling, held against the exact one."""
    edges = _user(spark, sf_dir)
    return _within(P.approximate_betweenness(edges, eps=0.03, directed=True).scores, _exact(edges), 0.03)


def bc_absolute_star(spark, sf_dir):
    """The customers and suppliers of nation 0 around it: no shortest path has more than two edges."""
    edges = cut(G.simplify(X.geo_forest(spark, sf_dir).where("dst = 1000000"), directed=False))
    n = G.nodes_of(edges).count()
    hub = F.when(F.col("id") == 1_000_000, F.lit((n - 2) / n)).otherwise(F.lit(0.0))
    exact = G.nodes_of(edges).select(F.col("id").alias("node"), hub.alias("bc"))
    return _within(P.approximate_betweenness(edges, eps=0.05).scores, exact, 0.05)


def _forest_exact(edges: DataFrame) -> DataFrame:
    """``(node, bc)`` of the regions and nations of the forest, whose paths are told by the sizes of its branches."""
    leaves = edges.where("src < 1000000 or src >= 3000000").groupBy(F.col("dst").alias("nation")).agg(F.count("*").alias("k"))
    nations = edges.where("src >= 1000000 and src < 2000000").select(F.col("src").alias("nation"), F.col("dst").alias("region"))
    nations = cut(nations.join(leaves, "nation", "left").select("nation", "region", (F.coalesce("k", F.lit(0)) + 1).alias("s")))
    regions = nations.groupBy("region").agg((F.sum("s") + 1).alias("size"), F.sum(F.col("s") * F.col("s")).alias("squares"))
    n = G.nodes_of(edges).count()
    rest = F.col("size") - 1
    inner = nations.join(regions, "region")
    through = rest * rest - (F.col("s") - 1) - (F.col("size") - F.col("s")) * (F.col("size") - F.col("s"))
    both = inner.select(F.col("nation").alias("node"), through.alias("pairs")).unionByName(
        regions.select(F.col("region").alias("node"), (rest * rest - F.col("squares")).alias("pairs"))
    )
    return both.select("node", (F.col("pairs") / (n * (n - 1.0))).alias("bc"))


def _topk_forest(spark, sf_dir):
    edges = cut(X.geo_forest(spark, sf_dir))
    return P.approximate_betweenness(edges, eps=0.25, k=5).scores, _forest_exact(edges)


def bc_topk_relative(spark, sf_dir):
    """The five most central nodes of the forest: whether the run holds them, within a relative 0.25."""
    scores, exact = _topk_forest(spark, sf_dir)
    top = C.top_nodes(exact, 5).select("node", F.col("bc").alias("exact")).join(scores, "node", "left")
    close = F.abs(F.col("bc") - F.col("exact")) <= 0.25 * F.col("exact")
    return top.select("node", F.col("bc").isNotNull().alias("member"), F.coalesce(close, F.lit(False)).alias("within_eps"))


def bc_topk_bounds(spark, sf_dir):
    """Estimates of a sample with the bounds of each node's own deviation, and whether they hold the exact centrality."""
    from pathlight.functions import bounds as B

    edges = cut(G.simplify(X.geo_forest(spark, sf_dir), directed=False))
    ids, _, paths = _sample(edges)
    hist = {r["internal"]: r["pairs"] for r in C.length_histogram(paths.lengths).collect()}
    diameter = K.diameter_bound(edges, cut(K.weak_components(edges, G.nodes_of(edges))))
    n, rho = ids.count(), B.rho_bound(hist, diameter, SAMPLES, 0.01)
    sums = C.node_sums(paths.weights, SEED).select("node", "sum_w")
    every = ids.select(F.col("dense_id").alias("node")).join(sums, "node", "left")

    def bound(frames):
        for f in frames:
            f["lower"], f["upper"] = B.node_bounds_of(f["bc"].to_numpy(), rho, n, SAMPLES, 0.01)
            yield f

    est = every.select("node", (F.coalesce("sum_w", F.lit(0.0)) / SAMPLES).alias("bc"))
    bounds = _node_ids(ids, est.mapInPandas(bound, "node long, bc double, lower double, upper double"))
    exact = _forest_exact(X.geo_forest(spark, sf_dir)).withColumnRenamed("bc", "exact")
    inside = F.coalesce("exact", F.lit(0.0)).between(F.col("lower") - 1e-12, F.col("upper") + 1e-12)
    joined = bounds.join(exact, "node", "left")
    return joined.select("node", F.round("bc", ROUND).alias("bc"), F.round("lower", 7).alias("lower"), F.round("upper", 7).alias("upper"), inside.alias("covered"))


def text_round_trip(spark, sf_dir):
    """The graph of suppliers and parts, written as an edge list and read back."""
    from pathlight.plans.lineage import scratch_path

    path = scratch_path(spark, "edges")
    G.write_graph(X.supp_part(spark, sf_dir), path, sep="\t")
    return G.simplify(G.read_edge_list(spark, path), directed=False)


def scores_round_trip(spark, sf_dir):
    """The ten most central users, written as a result file and read back."""
    from pathlight.plans.lineage import scratch_path

    path = scratch_path(spark, "scores")
    G.write_scores(_exact(_user(spark, sf_dir)).select("node", F.round("bc", ROUND).alias("bc")), path, k=10)
    return spark.read.csv(path, schema="node long, bc double")


#: Settings of the grid: error, failure probability and k.
GRID = ((0.06, 0.1, 0), (0.03, 0.05, 0), (0.5, 0.1, 3))


def bc_grid(spark, sf_dir):
    """Runs of several settings over one sample: of all nodes, or of the true top k, how many are found, within eps and bounds."""
    edges = _user(spark, sf_dir)
    exact = cut(_exact(edges))
    out = None
    for (eps, delta, k), run in zip(GRID, P.betweenness_grid(edges, [P.Setting(*x) for x in GRID], directed=True), strict=True):
        due = (C.top_nodes(exact, k) if k else exact).withColumnRenamed("bc", "exact")
        joined = due.join(run.scores, "node", "left")
        close = F.abs(F.col("bc") - F.col("exact")) <= (eps * F.col("exact") if k else F.lit(eps))
        inside = F.col("exact").between(F.col("lower") - 1e-12, F.col("upper") + 1e-12)
        row = joined.agg(F.count("bc").alias("found"), F.count_if(close).alias("within_eps"), F.count_if(inside).alias("covered"))
        row = row.select(F.lit(eps).alias("epsilon"), F.lit(delta).alias("delta"), F.lit(k).cast("long").alias("k"), "found", "within_eps", "covered", F.lit(run.metrics["settled"]).alias("settled"))
        out = row if out is None else out.unionByName(row)
    return out


#: Epsilons of the planned grid and runs wanted of each.
EPSILONS, RUNS = (0.01, 0.005, 0.0025, 0.001, 0.0005), 10


def _event_runs(spark, sf_dir):
    """Events taken as the statistics of runs, those of views and clicks not having terminated where their value is low."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    eps = F.element_at(F.array(*map(F.lit, EPSILONS)), (F.col("event_id") % len(EPSILONS) + 1).cast("int"))
    return events.select(
        (F.col("user_id") % 40).cast("string").alias("graph_name"), F.col("event_type").alias("estimator"), eps.alias("epsilon"), F.lit(0.1).alias("delta"),
        F.lit(0).alias("k"), (F.col("event_id") % 7).alias("run_id"), ((F.col("value") > 0.3) | (F.col("user_id") % 3 == 0)).cast("int").alias("terminated"), "event_id",
    )


def _grid_of(done: DataFrame) -> DataFrame:
    return done.select("graph_name", "estimator").distinct().withColumn("epsilon", F.explode(F.array(*map(F.lit, EPSILONS))))


def grid_plan(spark, sf_dir):
    """Which settings of a grid are to be run, and why not the others."""
    from pathlight.plans import experiments as E

    done = _event_runs(spark, sf_dir)
    return E.planned(_grid_of(done), done, RUNS)


def grid_resume(spark, sf_dir):
    """Settings without a run after those of all events were recorded, three runs of each twice: repeats add no row."""
    from pathlight.plans import experiments as E
    from pathlight.plans.lineage import scratch_path

    done = _event_runs(spark, sf_dir)
    keyed = cut(done.groupBy(*E.KEY).agg(F.max("event_id").alias("m"), F.min("terminated").alias("terminated")))
    path = scratch_path(spark, "statistics")
    E.record(keyed, path)
    E.record(keyed.where("run_id < 3"), path)
    found = E.recorded(spark, path, keyed.select("m", "terminated", *E.KEY).schema.simpleString()[7:-1].replace(":", " "))
    grid = _grid_of(keyed).withColumn("delta", F.lit(0.1)).withColumn("k", F.lit(0)).withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    left = E.to_do(grid, found).groupBy("graph_name").agg(F.count("*").alias("to_do"))
    counts = found.groupBy("graph_name").agg(F.count("*").alias("recorded")).join(left, "graph_name", "left")
    return counts.select("graph_name", "recorded", F.coalesce("to_do", F.lit(0)).cast("long").alias("to_do"))  # none is left of a whole grid


def log_statistics(spark, sf_dir):
    """Events written as logs of runs, one file each, and read back."""
    from pathlight.plans import experiments as E
    from pathlight.plans.lineage import scratch_path

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("run", F.col("user_id") % 40)
    taking = F.concat(F.lit("12:00 [INFO ]: Iteration "), F.col("event_id").cast("string"), F.lit(", taking "), F.floor(F.col("value") * 10).cast("string"), F.lit(" samples"))
    ms = F.concat(F.lit("done ("), F.col("value").cast("string"), F.lit(" millisecs)"))
    line = F.when(F.col("event_type") == "purchase", taking).when(F.col("event_type") == "click", ms).otherwise(F.lit("nothing to tell, taking 999999 done (1 millisecs)"))
    lines = events.select("run", "ts", "event_id", line.alias("line"))
    ends = events.where("run % 3 <> 0").groupBy("run").agg(F.max("ts").alias("ts")).select("run", "ts", F.lit(1 << 60).alias("event_id"), F.lit("INFO: Getting results...done").alias("line"))
    path = scratch_path(spark, "logs")
    both = lines.unionByName(ends).repartition("run").sortWithinPartitions("run", "ts", "event_id")
    both.select("run", "line").write.partitionBy("run").text(path)
    found = E.parse_logs(E.read_logs(spark, path))
    return found.select(F.regexp_extract("file", "run=([0-9]+)", 1).cast("long").alias("run"), "m", "time", "terminated")


QUERIES = {
    f.__name__: f
    for f in (
        edges_dedup, edges_symmetrised, graph_summary, degrees, dense_ids, dense_edges, isolated_nodes, components_undirected,
        components_forest, scc, condensation, pivots, pivot_ecc, diameter_bound, bfs_levels, path_counts, bc_exact_directed,
        bc_exact_undirected, bc_topk_exact, sample_pairs, pair_sigma, void_samples, path_length_hist, bc_sampled,
        wimpy_variance, rademacher_sums, peeling_partitions, mcera_by_partition, eps_by_partition, rho_bound, top1_bound,
        bc_single_path, bc_multi_path, bc_absolute, bc_absolute_star, bc_topk_relative, bc_topk_bounds, text_round_trip,
        scores_round_trip, bc_grid, grid_plan, grid_resume, log_statistics,
    )
}

_USER = """select distinct u src, v dst from (
  select user_id u, lead(user_id) over (order by ts, event_id) v
  from events where event_type = 'purchase' and value > 40) where v is not null and u <> v"""
_GAP = """select distinct u src, v dst from (
  select user_id u, ts t, lead(user_id) over (order by ts, event_id) v, lead(ts) over (order by ts, event_id) t2
  from events where event_type = 'purchase') where v is not null and u <> v and t2 - t < interval 4 minute"""
_CUST = """select distinct u src, v dst from (
  select o_custkey u, lead(o_custkey) over (order by o_orderdate, o_orderkey) v
  from orders where o_orderstatus = 'F' and o_orderpriority like '1%') where v is not null and u <> v"""
_SUPP = "select distinct l_suppkey + 1000000 src, l_partkey dst from lineitem where l_quantity >= 49"
_PAGE = """select distinct page_id src, id dst from
  (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) w from pages)
  join (select w, 1000000 + row_number() over (order by w) id from
    (select distinct unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) w from pages)) using (w)"""
_GEO = """select n_nationkey + 1000000 src, n_regionkey + 2000000 dst from nation
  union select c_custkey, c_nationkey + 1000000 from customer
  union select s_suppkey + 3000000, s_nationkey + 1000000 from supplier"""


def _graph(edges: str, directed: bool = True) -> str:
    """Common tables ``e`` (edges) and ``n`` (nodes)."""
    both = f"raw as ({edges}), "
    both += "e as (select src::bigint src, dst::bigint dst from raw" + ("" if directed else " union select dst, src from raw") + "), "
    return both + "n as (select src v from e union select dst from e)"


#: Distances by a walk of growing length, and path counts along them.
_DIST = """
  walk as (select v s, v, 0 d from n union select w.s, e.dst, w.d + 1 from walk w join e on w.v = e.src where w.d < {most}),
  dist as (select s, v, min(d) d from walk group by s, v),
  pc as (select s, v, d, 1.0::double sigma from dist where d = 0 union all
         select p.s, e.dst, p.d + 1, sum(p.sigma) from pc p join e on p.v = e.src
         join dist t on t.s = p.s and t.v = e.dst and t.d = p.d + 1 group by p.s, e.dst, p.d + 1)"""
#: Exact centrality: the share of paths through every node, summed over all pairs.
_BC = """
  through as (select a.v node, sum(a.sigma * b.sigma / c.sigma) total from pc a join pc b on a.v = b.s
    join pc c on c.s = a.s and c.v = b.v and c.d = a.d + b.d where a.d > 0 and b.d > 0 group by a.v),
  bc as (select n.v node, coalesce(total, 0) / ((select count(*) from n) * ((select count(*) from n) - 1.0)) bc
    from n left join through on n.v = node)"""
_REACH = """
  reach as (select v a, v b from n union select r.a, e.dst from reach r join e on r.b = e.src),
  comp as (select x.a id, min(x.b) comp from reach x join reach y on x.a = y.b and x.b = y.a group by x.a)"""
_PIVOT = """
  deg as (select v, (select count(*) from e where src = v) + (select count(*) from e where dst = v) deg from n),
  piv as (select comp, arg_max(v, deg * 1000000000 - v) p from comp join deg on id = v group by comp)"""
#: Distances from and to the pivots inside their components.
_ECC = """
  inner_e as (select src, dst from e join comp a on src = a.id join comp b on dst = b.id where a.comp = b.comp),
  fw as (select p s, p v, 0 d from piv union select f.s, i.dst, f.d + 1 from fw f join inner_e i on f.v = i.src where f.d < {most}),
  bw as (select p s, p v, 0 d from piv union select f.s, i.src, f.d + 1 from bw f join inner_e i on f.v = i.dst where f.d < {most}),
  ecc as (select comp, p, f.m forward, b.m backward from piv
    join (select s, max(d) m from (select s, v, min(d) d from fw group by s, v) group by s) f on f.s = p
    join (select s, max(d) m from (select s, v, min(d) d from bw group by s, v) group by s) b on b.s = p)"""
_FAR = """
  ce as (select distinct a.comp cs, b.comp cd from e join comp a on src = a.id join comp b on dst = b.id where a.comp <> b.comp),
  far as (select comp, forward f from ecc union
    select ce.cs, x.forward + 1 + y.backward + far.f from far join ecc y using (comp) join ce on ce.cd = far.comp join ecc x on x.comp = ce.cs),
  bound as (select max(backward + f) diameter_bound from far join ecc using (comp))"""
_DRAW = "cast('0x' || substr(md5('{seed}:{phase}:{key}:' || i), 1, 15) as bigint)"
_PAIRS = """
  cnt as (select count(*) n from n),
  ids as (select v id, row_number() over (order by v) - 1 dense_id from n),
  drawn as (select i pair_id, {u} % n u, {v} % (n - 1) v0 from range({m}) t(i), cnt),
  pairs as (select pair_id, u, v0 + case when v0 >= u then 1 else 0 end v from drawn),
  paired as (select pair_id, a.id u, b.id v from pairs join ids a on a.dense_id = u join ids b on b.dense_id = v)""".format(
    m=SAMPLES, u=_DRAW.format(seed=SEED, phase=0, key="u"), v=_DRAW.format(seed=SEED, phase=0, key="v")
)
_LENGTHS = """
  lengths as materialized (select pair_id, q.u, q.v, pc.d dist, pc.sigma from paired q join pc on pc.s = q.u and pc.v = q.v)"""
_WEIGHTS = """
  ahead as materialized (select l.pair_id, l.v, l.dist, l.sigma, a.v node, a.sigma ahead, l.dist - a.d rest
    from lengths l join pc a on a.s = l.u where a.d > 0 and a.d < l.dist),
  weights as materialized (select pair_id, node, ahead * b.sigma / h.sigma w
    from ahead h join pc b on b.s = h.node and b.v = h.v and b.d = h.rest)"""
_SUMS = f"""
  sums as materialized (select node, sum(w) sum_w, sum(w * w) sum_w2, count(*) hits from weights group by node),
  bits as (select i pair_id, cast('0x' || substr(md5('{SEED}:r:' || i), 1, 15) as bigint) b from range({SAMPLES}) t(i)),
  rade as materialized (select node, j, sum(w * (((b >> j::int) & 1) * 2 - 1)) signed from weights join bits using (pair_id), range(25) r(j) group by node, j)"""
#: Draws that go down the shortest paths of a sample as counts; ``split`` are the shares of the next nodes of a node.
_DRAWS = """
  on_path as materialized (select l.pair_id, a.d pos, a.v node, i.dense_id, b.sigma beta, l.dist, l.sigma total
    from lengths l join pc a on a.s = l.u and a.d < l.dist join pc b on b.s = a.v and b.v = l.v and b.d = l.dist - a.d join ids i on i.id = a.v),
  split as materialized (select p.pair_id, p.pos, p.node, q.node to_node, p.beta total, q.beta,
      sum(q.beta) over (partition by p.pair_id, p.node order by q.dense_id) upto,
      cast('0x' || substr(md5('{seed}:d:' || p.pair_id || ':' || p.dense_id), 1, 13) as bigint)::double / 4503599627370496 u
    from on_path p join e on e.src = p.node join on_path q on q.pair_id = p.pair_id and q.node = e.dst and q.pos = p.pos + 1),
  draws as (
    select pair_id, pos, node, greatest(1.0, floor({alpha} * total))::double n from on_path where pos = 0 and dist > 1 union all
    select d.pair_id, s.pos + 1, s.to_node, sum(floor(d.n * s.upto / s.total + s.u) - floor(d.n * (s.upto - s.beta) / s.total + s.u))
    from draws d join split s on s.pair_id = d.pair_id and s.node = d.node and s.pos = d.pos where d.n > 0 group by d.pair_id, s.pos, s.to_node),
  shares as (select node, n, n / first_value(n) over (partition by pair_id order by pos) w, pos from draws)"""
_PARTS = f"""
  moment as (select v node, coalesce(sum_w, 0) sum_w, coalesce(sum_w2, 0) sum_w2 from n left join sums on v = node),
  part as (select *, floor(ln(case when sum_w2 > 0 then least({SAMPLES} / sum_w2, {SAMPLES}.0) else {SAMPLES}.0 end) / ln({PEEL}) + 1)::bigint part
    from moment),
  sup as (select part, p.j, max(coalesce(signed, 0)) s from (select part, node, j from part, range(25) r(j)) p
    left join rade on rade.node = p.node and rade.j = p.j group by part, p.j),
  mc as (select part, nodes, wimpy, mcera from (select part, count(*) nodes, max(sum_w2) / {SAMPLES} wimpy from part group by part)
    join (select part, avg(s) / {SAMPLES} mcera from sup group by part) using (part))"""


def _with(*tables: str, select: str) -> str:
    return "with recursive " + ",".join(tables) + " " + select


#: Ordered pairs whose path goes through a nation or region of the forest, by the sizes of the branches.
_FOREST = """
  nat as (select e.src nation, e.dst region, 1 + (select count(*) from e l where l.dst = e.src) s
    from e where e.src between 1000000 and 1999999),
  reg as (select region, 1 + sum(s) size, sum(s * s) squares from nat group by region),
  forest as (select nation node, (size - 1) * (size - 1) - (s - 1) - (size - s) * (size - s) pairs from nat join reg using (region)
    union all select region, (size - 1) * (size - 1) - squares from reg)"""

#: Mean and variance of the number of internal nodes of a sample's paths.
_SPREAD = f"""
  h as (select dist - 1 i, count(*)::double c from lengths where dist > 1 group by 1 union all select 0, {SAMPLES} - count(*) from lengths where dist > 1),
  moments as (select (select sum(i * c) / {SAMPLES} from h) mean,
    (select sum((a.i - b.i) * (a.i - b.i) * a.c * b.c) / ({SAMPLES} * ({SAMPLES} - 1.0)) from h a join h b on a.i < b.i) variance)"""
#: A node's own bounds by thirty bisections: of ``up`` the greatest t with b + slack(t) >= t, else the least with b - slack(t) <= t.
_SLACK = f"(ln(greatest(200 * least(n, greatest(rho, 1e-9) / greatest((lo + hi) / 2, 1e-300)), 1)) / {SAMPLES})"
_SLACK = f"({_SLACK} / 3 + sqrt(2 * {_SLACK} * greatest((lo + hi) / 2, 1e-300) * greatest(1 - greatest((lo + hi) / 2, 1e-300), 0)))"
_BISECT = f"""
  bis as (select node, b, rho, n, 0 i, b lo, 1.0::double hi, true up from est union all select node, b, rho, n, 0, 0.0, b, false from est union all
    select node, b, rho, n, i + 1, case when b + case when up then {_SLACK} else -{_SLACK} end >= (lo + hi) / 2 then (lo + hi) / 2 else lo end,
      case when b + case when up then {_SLACK} else -{_SLACK} end >= (lo + hi) / 2 then hi else (lo + hi) / 2 end, up from bis where i < 30),
  bounds as (select x.node, x.b, x.n, least(y.lo, x.b) lower, greatest(x.hi, x.b) upper
    from bis x join bis y on x.node = y.node and x.up and not y.up and x.i = 30 and y.i = 30)"""
_DRAWN = f"""select node, sum(n)::bigint draws, round(sum(w) / {SAMPLES}, {ROUND}) bc from shares where pos > 0 group by node having sum(n) > 0"""

_U, _G, _P = _graph(_USER), _graph(_GAP), _graph(_PAGE, False)
_D8, _D40 = _DIST.format(most=14), _DIST.format(most=32)
_ST = 0.05

_EVENT_RUNS = f"""
  done as (select (user_id % 40)::varchar graph_name, event_type estimator, ([{", ".join(map(str, EPSILONS))}])[event_id % {len(EPSILONS)} + 1]::double epsilon,
    event_id % 7 run_id, (value > 0.3 or user_id % 3 = 0)::int terminated, event_id from events)"""

SQL = {
    "bc_grid": _with(
        _U, "g(epsilon, delta, k) as (values {})".format(", ".join(f"({e}::double, {d}::double, {k}::bigint)" for e, d, k in GRID)),
        "m as (select *, case when k = 0 then (select count(*) from n) else k end found from g)",
        select="select epsilon, delta, k, found, found within_eps, found covered, true settled from m",
    ),
    "grid_plan": "with " + _EVENT_RUNS + f""",
        grid as (select distinct graph_name, estimator, unnest([{", ".join(map(str, EPSILONS))}])::double epsilon from done),
        own as (select *, (select count(*) from done d where d.graph_name = g.graph_name and d.estimator = g.estimator and d.epsilon = g.epsilon) finished,
          (select min(terminated) from done d where d.graph_name = g.graph_name and d.estimator = g.estimator and d.epsilon >= g.epsilon) worst from grid g)
        select graph_name, estimator, epsilon, finished, case when epsilon = (select max(epsilon) from grid) and finished = 0 then null
          when worst = 0 then 'hopeless' when finished >= {RUNS} then 'enough' end reason from own""",
    "grid_resume": "with " + _EVENT_RUNS + """,
        keyed as (select distinct graph_name, estimator, epsilon, run_id from done),
        grid as (select graph_name, estimator, count(*) n from keyed group by all)
        select graph_name, sum(n)::bigint recorded, (count(*) * 35 - sum(n))::bigint to_do from grid group by graph_name""",
    "log_statistics": """
        with r as (select user_id % 40 run, *, row_number() over (partition by user_id % 40 order by ts, event_id) i from events),
             x as (select run, coalesce(max(floor(value * 10)::bigint) filter (event_type = 'purchase'), 0) m,
                          coalesce(arg_max(value, i) filter (event_type = 'click') / 1000, 0) ms from r group by run)
        select run, case when run % 3 <> 0 then m else 0 end m, case when run % 3 <> 0 then ms else 0 end "time", (run % 3 <> 0)::int terminated from x""",
    "edges_dedup": _with(_graph(_CUST), select="select src, dst from e"),
    "edges_symmetrised": _with(_graph(_SUPP, False), select="select src, dst from e"),
    "graph_summary": _with(
        _graph(_SUPP, False),
        select="""select (select count(*) from n) n_nodes, (select count(*) from e) n_edges, (select max(v) from n) max_id,
        (select max(c) from (select count(*) c from e group by src)) max_out_degree,
        (select max(c) from (select count(*) c from e group by dst)) max_in_degree""",
    ),
    "degrees": _with(
        _graph(_CUST),
        select="""select v id, coalesce(o, 0) out_degree, coalesce(i, 0) in_degree from n
        left join (select src, count(*) o from e group by src) on src = v left join (select dst, count(*) i from e group by dst) on dst = v""",
    ),
    "dense_ids": _with(_graph(_SUPP), select="select v id, row_number() over (order by v) - 1 dense_id from n"),
    "dense_edges": _with(
        _graph(_SUPP), "d as (select v, row_number() over (order by v) - 1 i from n)",
        select="select a.i src, b.i dst from e join d a on src = a.v join d b on dst = b.v",
    ),
    "isolated_nodes": _with(
        _graph(_CUST), select="select i id from range((select max(v) + 1 from n)) t(i) where i not in (select v from n)"
    ),
    "components_undirected": _with(_P, "r as (select v a, v b from n union select r.a, e.dst from r join e on r.b = e.src)", select="select a id, min(b) comp from r group by a"),
    "components_forest": _with(
        _graph(_GEO, False), "r as (select v a, v b from n union select r.a, e.dst from r join e on r.b = e.src)",
        select="select a id, min(b) comp from r group by a",
    ),
    "scc": _with(_G, _REACH, select="select id, comp from comp"),
    "condensation": _with(_G, _REACH, select="select distinct a.comp comp_src, b.comp comp_dst from e join comp a on src = a.id join comp b on dst = b.id where a.comp <> b.comp"),
    "pivots": _with(_G, _REACH, _PIVOT, select="select comp, p as \"pivot\" from piv"),
    "pivot_ecc": _with(_G, _REACH, _PIVOT, _ECC.format(most=32), select="select comp, p as \"pivot\", forward, backward from ecc"),
    "diameter_bound": _with(_G, _REACH, _PIVOT, _ECC.format(most=32), _FAR, select="select diameter_bound::bigint diameter_bound from bound"),
    "bfs_levels": _with(_G, _REACH, _PIVOT, _D40, select="select s source, d::bigint dist, count(*) nodes from dist join piv on s = p group by s, d"),
    "path_counts": _with(_U, _D8, select="select s source, v node, d::bigint dist, sigma from pc"),
    "bc_exact_directed": _with(_U, _D8, _BC, select=f"select node, round(bc, {ROUND}) bc from bc"),
    "bc_exact_undirected": _with(_P, _D8, _BC, select=f"select node, round(bc, {ROUND}) bc from bc"),
    "bc_topk_exact": _with(_U, _D8, _BC, select=f"select node, round(bc, {ROUND}) bc from (select * from bc order by bc.bc desc, node limit 10)"),
    "sample_pairs": _with(_U, _PAIRS, select="select pair_id, u, v from pairs"),
    "pair_sigma": _with(_G, _D40, _PAIRS, _LENGTHS, select="select pair_id, dist::bigint dist, sigma from lengths"),
    "void_samples": _with(
        _G, _D40, _PAIRS, _LENGTHS,
        select=f"select {SAMPLES} - count(*) unreachable, count(*) filter (dist = 1) adjacent, count(*) filter (dist > 1) with_path from lengths",
    ),
    "path_length_hist": _with(_G, _D40, _PAIRS, _LENGTHS, select="select (dist - 1)::bigint internal, count(*) pairs from lengths group by 1"),
    "bc_sampled": _with(_U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, select=f"select node, round(sum_w / {SAMPLES}, {ROUND}) bc from sums"),
    "wimpy_variance": _with(_U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, select=f"select node, hits, round(sum_w2 / {SAMPLES}, {ROUND}) second_moment from sums"),
    "rademacher_sums": _with(_U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, select=f"select node, j::bigint trial, round(signed, {ROUND - 3}) signed from rade"),
    "peeling_partitions": _with(_U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, _PARTS, select="select part, count(*) nodes from part group by part"),
    "mcera_by_partition": _with(_U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, _PARTS, select=f"select part, nodes, round(wimpy, {ROUND}) wimpy, round(mcera, {ROUND}) mcera from mc"),
    "eps_by_partition": _with(
        _U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, _PARTS,
        f"a as (select part, nodes, wimpy, greatest(mcera, 0) mcera, ln(5 / ({_ST} / (select count(*) from mc))) / {SAMPLES} l from mc)",
        "b as (select *, least(0.25, wimpy + l + sqrt(l * l + 2 * l * wimpy)) v, mcera + sqrt(4 * wimpy * l / 25) e from a)",
        "c as (select *, case when nodes = 1 then 0 else e + l + sqrt(l * l + 2 * l * e) end r from b)",
        f"k as (select *, l + ln(nodes) / {SAMPLES} q from c)",
        select="""select part, round(least(2 * r + sqrt(2 * l * (v + 4 * r)) + l / 3, 2 * r + sqrt(l / 2), sqrt(2 * v * q) + q / 3), 7) eps from k""",
    ),
    "rho_bound": _with(
        _G, _D40, _REACH, _PIVOT, _ECC.format(most=32), _FAR, _PAIRS, _LENGTHS,
        f"h as (select dist - 1 i, count(*)::double c from lengths where dist > 1 group by 1 union all select 0, {SAMPLES} - count(*) from lengths where dist > 1)",
        f"s as (select (select sum(i * c) / {SAMPLES} from h) mean, (select sum((a.i - b.i) * (a.i - b.i) * a.c * b.c) / ({SAMPLES} * ({SAMPLES} - 1.0)) from h a join h b on a.i < b.i) variance, (select greatest(diameter_bound - 1, 0) from bound) w)",
        f"t as (select *, w * ln(1 / {_ST / 2}) / {SAMPLES} c, ln(2 / {_ST / 2}) / {SAMPLES} g from s)",
        select="select round(mean, 7) mean, round(variance, 7) variance, round(greatest(1e-9, mean, least(mean + c + sqrt(2 * c * mean + c * c), mean + 7 * w * g / 3 + sqrt(2 * variance * g), w)), 7) rho from t",
    ),
    "bc_single_path": _with(_U, _D8, _PAIRS, _LENGTHS, _DRAWS.format(seed=SEED, alpha=0.0), select=_DRAWN),
    "bc_multi_path": _with(_graph(_SUPP, False), _D8, _PAIRS, _LENGTHS, _DRAWS.format(seed=SEED, alpha=2.3), select=_DRAWN),
    "bc_absolute": _with(_U, select="select v node, true within_eps, true covered from n"),
    "bc_absolute_star": _with(_graph(f"select * from ({_GEO}) where dst = 1000000", False), select="select v node, true within_eps, true covered from n"),
    "bc_topk_relative": _with(_graph(_GEO), _FOREST, select="select node, true member, true within_eps from (select * from forest order by pairs desc, node limit 5)"),
    "bc_topk_bounds": _with(
        _graph(_GEO, False), _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS, _SPREAD,
        "own as (select s v, min(v) comp from dist group by s)",
        "deg as (select src v, count(*) deg from e group by src)",
        "piv as (select comp, arg_max(v, deg * 1000000000 - v) p from own join deg using (v) group by comp)",
        "w as (select greatest(2 * max(d) - 1, 0) w from dist join piv on s = p)",
        "t as (select mean, variance, w, w * ln(200) / {m} c, ln(400) / {m} g from moments, w)".format(m=SAMPLES),
        "rho as (select greatest(1e-9, mean, least(mean + c + sqrt(2 * c * mean + c * c), mean + 7 * w * g / 3 + sqrt(2 * variance * g), w)) rho from t)",
        f"est as (select v node, coalesce(sum_w, 0) / {SAMPLES} b, rho, (select count(*) from n)::double n from n left join sums on node = v, rho)",
        _BISECT,
        f"one_way as ({_GEO})", _FOREST.replace("e.", "one_way.").replace("from e", "from one_way"),
        select=f"""select node, round(b, {ROUND}) bc, round(lower, 7) "lower", round(upper, 7) "upper",
        coalesce(pairs / (n * (n - 1)), 0) between lower - 1e-12 and upper + 1e-12 covered from bounds left join forest using (node)""",
    ),
    "text_round_trip": _with(_graph(_SUPP, False), select="select src, dst from e"),
    "scores_round_trip": _with(_U, _D8, _BC, select=f"select node, round(bc, {ROUND}) bc from (select * from bc order by bc.bc desc, node limit 10)"),
    "top1_bound": _with(
        _U, _D8, _PAIRS, _LENGTHS, _WEIGHTS, _SUMS,
        f"t as (select max(sum_w) / {SAMPLES} a, max(sum_w2) / {SAMPLES} b, ln(1 / {_ST}) / {SAMPLES} c from sums)",
        select="""select round(a, 7) top_bc, round(least(1, a + c + sqrt(2 * c * a + c * c)), 7) top_bc_bound,
        round(b, 7) top_moment, round(least(1, b + c + sqrt(2 * c * b + c * c)), 7) top_moment_bound from t""",
    ),
}
