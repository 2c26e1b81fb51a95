"""Graph operators on hand-made graphs and against a plain version of exact centrality."""

import math
import random
from collections import defaultdict, deque

import pytest
from pathlight.operators import centrality as C
from pathlight.operators import condensation as K
from pathlight.operators import levels as L
from pathlight.operators import shape as S
from pathlight.operators import traversal as T
from pathlight.operators.components import connected_components
from pathlight.operators.ranking import global_row_number, running_sum_before
from pathlight.plans import progressive as P
from pathlight.plans.lineage import cut
from pathlight.sources import fixtures as X
from pathlight.sources import graphs as G
from pyspark.sql import functions as F


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brandes(pairs, n=None):
    nodes = {x for e in pairs for x in e}
    out = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
    bc = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        dep = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                dep[v] += sigma[v] / sigma[w] * (1 + dep[w])
            if w != s:
                bc[w] += dep[w]
    n = len(nodes)
    return {v: x / (n * (n - 1)) for v, x in bc.items()}


def both(pairs):
    return pairs + [(b, a) for a, b in pairs]


def random_graph(seed, n=14, m=26):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("directed", [True, False])
def test_exact_equals_plain(spark, directed):
    pairs = [e for e in random_graph(3) if e[0] != e[1]]
    edges = G.simplify(frame(spark, pairs), directed)
    got = {r["node"]: r["bc"] for r in C.exact_betweenness(edges, G.nodes_of(edges)).collect()}
    want = brandes(pairs if directed else both(pairs))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_exact_in_batches_holds_one_batch(spark, monkeypatch):
    """Batches of sources give the same scores, and the tables of one are gone before those of the next are made."""
    pairs = both([e for e in random_graph(5, 10, 14) if e[0] != e[1]])
    made, live = [], set()
    start, drop = C.level_table, T.LevelTable.drop

    def begun(*a, **k):
        assert not live
        table, number = start(*a, **k)
        live.add(table.name)
        made.append(table.name)
        return table, number

    monkeypatch.setattr(C, "PAIRS", 60)
    monkeypatch.setattr(C, "level_table", begun)
    monkeypatch.setattr(T.LevelTable, "drop", lambda self: (live.discard(self.name), drop(self))[1])
    edges = G.simplify(frame(spark, pairs))
    got = {r["node"]: r["bc"] for r in C.exact_betweenness(edges, G.nodes_of(edges)).collect()}
    want = brandes(pairs)
    assert len(made) > 1 and not live
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_closed_forms(spark):
    def exact(pairs):
        edges = G.simplify(frame(spark, pairs), directed=False)
        return {r["node"]: r["bc"] for r in C.exact_betweenness(edges, G.nodes_of(edges)).collect()}

    n = 5
    path = exact([(i, i + 1) for i in range(n - 1)])
    assert all(abs(path[i] - 2 * i * (n - 1 - i) / (n * (n - 1))) < 1e-12 for i in range(n))
    star = exact([(0, i) for i in range(1, 5)])
    assert abs(star[0] - 12 / 20) < 1e-12 and all(star[i] == 0 for i in range(1, 5))
    assert set(exact([(0, 1), (1, 2), (2, 0), (2, 3), (3, 0), (1, 3)]).values()) == {0.0}  # complete
    assert set(exact([(0, 1), (2, 3)]).values()) == {0.0}


# From 0 to 9 there are three paths over 4 and one over 8: 4 has 3, 8 has 1 of the 4 shortest paths.
DIAMOND = [(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (0, 7), (7, 8), (4, 9), (8, 9)]


def test_pair_paths_count_and_weigh(spark):
    edges = frame(spark, DIAMOND)
    pairs = spark.createDataFrame([(0, 0, 9), (1, 0, 1), (2, 9, 0), (3, 0, 4)], "pair_id long, u long, v long")
    paths = T.pair_paths(edges, pairs)
    assert sorted(map(tuple, paths.lengths.collect())) == [(0, 3, 4.0), (1, 1, 1.0), (3, 2, 3.0)]
    got = {(r["pair_id"], r["node"]): r["weight"] for r in paths.weights.collect()}
    want = {(0, 4): 0.75, (0, 8): 0.25, (0, 7): 0.25} | {(p, x): (0.25 if p == 0 else 1 / 3) for p in (0, 3) for x in (1, 2, 3)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def calibration(edges, pairs, mode, alpha=0.0):
    """Chi-square over all (pair, node): draws against the shares of all paths, by size of the share."""
    every = T.pair_paths(edges, pairs).weights.where("weight > 0 and weight < 1")
    drawn = T.pair_paths(edges, pairs, mode, alpha, seed=5).weights.withColumnRenamed("weight", "drawn")
    off = F.coalesce("drawn", F.lit(0.0)) - F.col("weight")
    rows = every.join(drawn, ["pair_id", "node"], "left").groupBy(F.floor(F.col("weight") * 5).alias("size"))
    rows = rows.agg(F.sum(off).alias("off"), F.sum(F.col("weight") * (1 - F.col("weight"))).alias("spread")).collect()
    return sum(r["off"] ** 2 / r["spread"] for r in rows) / len(rows)


def test_drawn_paths_are_uniform(spark, monkeypatch):
    """A path is drawn in proportion to path counts; draws that ignore the counts fail by the same measure."""
    edges = cut(frame(spark, [(a + 10 * i, b + 10 * i) for i in range(40) for a, b in DIAMOND]))
    pairs = spark.range(2000).select(F.col("id").alias("pair_id"), (F.col("id") % 40 * 10).alias("u"), (F.col("id") % 40 * 10 + 9).alias("v"))
    pairs = cut(pairs)
    one = T.pair_paths(edges, pairs, "single", seed=5)
    assert one.weights.where("weight <> 1").count() == 0
    assert calibration(edges, pairs, "single") < 8
    assert calibration(edges, pairs, "multi", 2.3) < 8
    flow = T._flow_back
    monkeypatch.setattr(T, "_flow_back", lambda *a: cut(flow(*a).withColumn("beta", F.lit(1.0))))
    draw = T._draw
    monkeypatch.setattr(T, "_draw", lambda g, p, ls, on, a, s: draw(g, p, ls.withColumn("sigma", F.lit(2.0)), on, a, s))
    assert calibration(edges, pairs, "single") > 30


def test_draws_are_counts(spark):
    """Five diamonds in a row have 32 shortest paths; 3,200 draws are a row for each node, not for each draw."""
    edges = frame(spark, [e for i in range(0, 15, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))])
    paths = T.pair_paths(edges, spark.createDataFrame([(0, 0, 15)], "pair_id long, u long, v long"), "multi", 100.0)
    by_level = defaultdict(float)
    for r in paths.draws.collect():
        by_level[r["pos"]] += r["n"]
    assert set(by_level.values()) == {3200.0} and len(by_level) == 9
    assert paths.draws.count() == 14
    assert all(abs(r["weight"] - 0.5) < 0.01 for r in paths.weights.where("node % 3 > 0").collect())


def by_batch(edges, pairs):
    """Edges followed if all open pairs of a batch expand the same end, the one that is cheaper for all together."""
    ahead, back = defaultdict(set), defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)
        back[b].add(a)
    fronts = [[{u}, {v}, {u}, {v}] for u, v in pairs if u != v]
    followed = 0
    while fronts:
        costs = [sum(len(s[x]) for f in fronts for x in f[i]) for i, s in enumerate((ahead, back))]
        i = int(costs[0] > costs[1])
        if not costs[i]:
            break
        followed += costs[i]
        for f in fronts:
            f[i] = {y for x in f[i] for y in (ahead, back)[i][x]} - f[i + 2]
            f[i + 2] |= f[i]
        fronts = [f for f in fronts if f[i] and not f[i] & f[1 - i]]
    return followed


def test_each_pair_chooses_its_side(spark, sf):
    edges = cut(G.simplify(X.cust_seq(spark, "/root/testdata/sf0.01")))
    ids = cut(S.dense_ids(edges))
    dense = cut(S.renumber(edges, ids))
    pairs = cut(S.sample_pairs(spark, ids.count(), 0, 500, 42))
    paths = T.pair_paths(dense, pairs)
    batch = by_batch([tuple(r) for r in dense.collect()], [(r["u"], r["v"]) for r in pairs.collect()])
    assert 0 < paths.visited < 0.9 * batch
    assert sum(r["edges"] for r in paths.rounds) == paths.visited and paths.rounds[0]["open_pairs"] <= 500


def test_visited_test_moves_no_former_level(spark, monkeypatch):
    """With tables too large to broadcast, what was written before is joined where it lies."""
    import contextlib
    import io

    plans = []
    add = T.LevelTable.add

    def told(self, rows, number, *a, **k):
        if self.name.startswith(("search", "levels")) and number == 2:
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                rows.explain()
            plans.append(out.getvalue())
        return add(self, rows, number, *a, **k)

    monkeypatch.setattr(T.LevelTable, "add", told)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = frame(spark, [(i, i + 1) for i in range(12)])
        T.pair_paths(edges, spark.createDataFrame([(0, 0, 9)], "pair_id long, u long, v long"))
        T.levels(edges, spark.createDataFrame([(0,)], "id long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2
    for plan in plans:
        lines = plan.splitlines()
        last = max(i for i, x in enumerate(lines) if "Scan parquet" in x)  # the side of the former levels
        assert "Bucketed: true" in lines[last]
        top = max(i for i in range(last) if "SortMergeJoin" in lines[i])
        depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
        chain, at = [], last
        for i in range(last - 1, top, -1):
            if depth(lines[i]) < depth(lines[at]):
                chain.append(lines[i])
                at = i
        assert chain and not any("Exchange" in x for x in chain)


def test_hub_is_many_tasks_work(spark, monkeypatch):
    """The leaves of a star are dealt in parts of about HUB, whatever their number."""
    monkeypatch.setattr(L, "HUB", 1_000)
    n = 40_000
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    graph = L.adjacency(edges)
    parts = graph.steps.where("side = 0").groupBy("part").count().agg(F.count("*"), F.max("count"), F.median("count")).first()
    assert parts[0] == 40 and parts[1] < 1.2 * parts[2]
    first = T.expand(spark.createDataFrame([(0, 0, 1.0, n)], "source long, node long, sigma double, d0 long"), graph, _empty_levels(spark))
    assert first.count() == n
    paths = T.pair_paths(G.simplify(edges, directed=False), spark.createDataFrame([(0, 1, 2), (1, 0, 7)], "pair_id long, u long, v long"))
    assert sorted(map(tuple, paths.lengths.collect())) == [(0, 2, 1.0), (1, 1, 1.0)]
    graph.drop()


def test_dead_ends_are_not_stored(spark):
    """Of two stars that are joined a search sees hubs and its own ends, not the leaves; their paths are found all the same."""
    rows = [(0, i) for i in range(2, 400)] + [(1, i) for i in range(400, 800)] + [(0, 1)]
    graph = L.adjacency(G.simplify(frame(spark, rows), directed=False))
    pairs = spark.createDataFrame([(0, 2, 401), (1, 2, 3), (2, 0, 500), (3, 500, 0), (4, 0, 1)], "pair_id long, u long, v long")
    found = T._search(graph, pairs)
    assert found.table.rows().count() <= 5 * 6
    found.table.drop()
    paths = T.pair_paths(graph, pairs)
    assert sorted(map(tuple, paths.lengths.collect())) == [(0, 3, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 1, 1.0)]
    assert sorted((r["pair_id"], r["node"], r["weight"]) for r in paths.weights.collect()) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    graph.drop()


def _empty_levels(spark):
    table = T.LevelTable(spark, "levels", "source", "node")
    table.add(spark.createDataFrame([(9, 9)], "source long, node long"), 0, deal=True)
    return table


def test_sampled_mean_equals_exact_over_all_pairs(spark):
    pairs = [e for e in random_graph(8, 10, 22) if e[0] != e[1]]
    edges, want = frame(spark, pairs), brandes(pairs)
    nodes = sorted(want)
    every = [(i, u, v) for i, (u, v) in enumerate((u, v) for u in nodes for v in nodes if u != v)]
    paths = T.pair_paths(edges, spark.createDataFrame(every, "pair_id long, u long, v long"))
    sums = {r["node"]: r["sum_w"] / len(every) for r in C.node_sums(paths.weights, 1).collect()}
    assert all(abs(sums.get(v, 0.0) - want[v]) < 1e-12 for v in want)


def test_components_and_condensation(spark):
    # Two strong components in a chain, a tail, and a pair apart.
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (8, 9)]
    edges = frame(spark, pairs)
    comps = K.strong_components(edges, G.nodes_of(edges)).cache()
    assert {r["id"]: r["comp"] for r in comps.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 8: 8, 9: 9}
    assert sorted(map(tuple, K.condensation(edges, comps).collect())) == [(1, 4), (4, 6), (8, 9)]
    assert {r["comp"]: r["pivot"] for r in K.pivots(edges, comps).collect()} == {1: 3, 4: 4, 6: 6, 8: 8, 9: 9}
    ecc = {r["comp"]: (r["forward"], r["backward"]) for r in K.pivot_eccentricities(edges, comps).collect()}
    assert ecc[1] == (2, 2) and ecc[4] == (1, 1) and ecc[6] == (0, 0)
    assert K.diameter_bound(edges, comps) >= 5
    weak = {r["id"]: r["comp"] for r in K.weak_components(edges, G.nodes_of(edges)).collect()}
    assert weak == dict.fromkeys((1, 2, 3, 4, 5, 6), 1) | {8: 8, 9: 8}


def longest(pairs):
    out, nodes = defaultdict(set), {x for e in pairs for x in e}
    for a, b in pairs:
        out[a].add(b)
    best = 0
    for s in nodes:
        dist, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        best = max(best, *dist.values())
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_diameter_bound_holds(spark, seed):
    pairs = [e for e in random_graph(seed, 16, 24) if e[0] != e[1]]
    edges = frame(spark, pairs)
    comps = K.strong_components(edges, G.nodes_of(edges))
    assert K.diameter_bound(edges, comps) >= longest(pairs)
    sym = G.simplify(edges, directed=False)
    weak = K.weak_components(sym, G.nodes_of(sym))
    assert longest(both(pairs)) <= K.diameter_bound(sym, weak) <= 2 * longest(both(pairs))


def test_connected_components_of_a_long_path(spark):
    r = random.Random(0)
    ids = list(range(200))
    r.shuffle(ids)
    pairs = [(ids[i], ids[i + 1]) for i in range(199)] + [(300, 301), (301, 302), (400, 400), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(frame(spark, pairs)).collect()}
    assert got == dict.fromkeys(range(200), 0) | dict.fromkeys((300, 301, 302), 300)
    assert connected_components(frame(spark, [(1, 1)])).count() == 0


def test_row_numbers_and_running_sums(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 else None, r.randrange(50), r.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    numbers = [x["i"] for x in global_row_number(df, [F.col("k")], "i").orderBy("i").collect()]
    assert numbers == list(range(400))
    got = running_sum_before(df, "g", [F.col("k")], "v", "before").collect()
    for g in ("hot", None):
        mine = sorted(((x["k"], x["before"], x["v"]) for x in got if x["g"] == g), key=lambda x: x[:2] + (x[2] != 0,))
        # In the order of the key each row starts where the ones before end, whatever the order among ties.
        ends = sorted(b + v for _, b, v in mine)
        assert sorted(b for _, b, _ in mine) == [0, *ends[:-1]] and ends[-1] == sum(v for gg, _, v in rows if gg == g)
        assert all(a[1] <= b[1] for a, b in zip(mine, mine[1:]) if a[0] < b[0])


def test_edge_list_reader(spark, tmp_path):
    text = "# comment\n1 2\n2\t3\n  \n3  4 17\n5\nx y\n1 2\n2 2\n#9 9\n4 # 5\n"
    (tmp_path / "g.txt").write_text(text)
    edges = G.read_edge_list(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 2), (2, 2), (2, 3), (3, 4)]
    assert sorted(map(tuple, G.simplify(edges).collect())) == [(1, 2), (2, 3), (3, 4)]
    assert G.simplify(edges, directed=False).count() == 6
    with pytest.raises(Exception, match="not an edge"):
        G.read_edge_list(spark, str(tmp_path / "g.txt"), strict=True).collect()
    (tmp_path / "raw.txt").write_text("% head\n1 2 0.5 1234\n3\t4 % c\n5 6\n")
    assert sorted(map(tuple, G.read_raw_graph(spark, str(tmp_path / "raw.txt")).collect())) == [(1, 2), (5, 6)]


def test_summary_nodes_and_degrees(spark):
    edges = frame(spark, [(0, 2), (0, 4), (4, 2)])
    assert G.nodes_of(edges, dense=True).count() == 5 and G.nodes_of(edges).count() == 3
    assert tuple(G.graph_summary(edges).first()) == (3, 3, 4, 2, 2)
    assert {r["id"]: (r["out_degree"], r["in_degree"]) for r in S.degrees(edges, G.nodes_of(edges, dense=True)).collect()} == {0: (2, 0), 1: (0, 0), 2: (0, 2), 3: (0, 0), 4: (1, 1)}
    none = frame(spark, [])
    assert tuple(G.graph_summary(none).first()) == (0, 0, None, 0, 0) and G.nodes_of(none, dense=True).count() == 0
    dense = {r["id"]: r["dense_id"] for r in S.dense_ids(edges).collect()}
    assert dense == {0: 0, 2: 1, 4: 2}
    assert sorted(map(tuple, S.renumber(edges, S.dense_ids(edges)).collect())) == [(0, 1), (0, 2), (2, 1)]
    assert sorted(r["neighbour"] for r in S.neighbours(edges, spark.range(1)).collect()) == [2, 4]


def test_writers_and_catalogue(spark, tmp_path):
    cat = spark.createDataFrame([("a", "D"), ("b", "U")], "graph_name string, directed string")
    G.write_catalogue(cat, f"{tmp_path}/cat")
    assert sorted(map(tuple, G.read_catalogue(spark, f"{tmp_path}/cat").collect())) == [("a", "D"), ("b", "U")]
    assert [r["graph_name"] for r in G.missing_graphs(cat, cat.where("graph_name = 'a'")).collect()] == ["b"]
    scores = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.5)], "node long, bc double")
    G.write_scores(scores, f"{tmp_path}/top", k=2)
    assert sorted(x for p in (tmp_path / "top").glob("part*") for x in p.read_text().split()) == ["1,0.5", "2,0.7"]
    G.write_graph(frame(spark, [(1, 2)]), f"{tmp_path}/g", sep="\t")
    assert sorted(map(tuple, G.read_edge_list(spark, f"{tmp_path}/g").collect())) == [(1, 2)]


def test_sample_pairs(spark):
    rows = S.sample_pairs(spark, 10, 0, 4000, 42).collect()
    counts = defaultdict(int)
    for r in rows:
        assert r["u"] != r["v"] and 0 <= r["u"] < 10 and 0 <= r["v"] < 10
        counts[r["u"], r["v"]] += 1
    assert len(counts) == 90 and sum((c - 4000 / 90) ** 2 / (4000 / 90) for c in counts.values()) / 89 < 1.4
    # Equal parity of both ends is as frequent as it should be.
    assert abs(sum((r["u"] - r["v"]) % 2 == 0 for r in rows) / 4000 - 4 / 9) < 0.03
    again = S.sample_pairs(spark, 10, 1000, 1010, 42).collect()
    assert again == rows[1000:1010] and S.sample_pairs(spark, 10, 0, 9, 42, phase=2).collect() != rows[:9]
    assert S.sample_pairs(spark, 1, 0, 5, 1).count() == 0


def test_rademacher_sums_are_real_valued(spark):
    weights = spark.range(4000).select(F.col("id").alias("pair_id"), F.lit(7).cast("long").alias("node"), F.lit(0.5).alias("weight"))
    row = C.node_sums(weights, 3).first()
    assert row["sum_w"] == 2000 and row["sum_w2"] == 1000 and len(row["rade"]) == 25
    spread = math.sqrt(sum(x * x for x in row["rade"]) / 25)
    assert 0.5 * math.sqrt(1000) < spread < 2 * math.sqrt(1000)


def test_untouched_nodes_count_as_zero(spark):
    nodes = spark.range(5)
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.5)], "pair_id long, node long, weight double")
    sums = C.node_sums(weights, 1)
    parts = C.peeled(nodes, sums, 2, 2.0)
    rows = C.partition_maxima(parts, sums).collect()
    assert sum(r["nodes"] for r in rows) == 5 and min(r["max_w"] for r in rows) == 0.0
    assert all(x >= 0 for r in rows if r["max_w"] == 0 for x in r["max_rade"])


def test_absolute_run_is_within_eps(spark):
    pairs = [e for e in random_graph(5, 30, 70) if e[0] != e[1]]
    want = brandes(pairs)
    result = P.approximate_betweenness(frame(spark, pairs), eps=0.05, directed=True)
    got = {r["node"]: r for r in result.scores.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[v]["bc"] - want[v]) <= 0.05 and got[v]["lower"] <= want[v] <= got[v]["upper"] for v in want)
    assert result.metrics["eps"] <= 0.05 and result.metrics["m"] <= result.metrics["samples_bound"]
    row = P.status_rows(spark, "g", result, 0.05, 0.05, 0, True, 2.0, 2.3).first()
    assert row["graph_name"] == "g" and row["m"] == result.metrics["m"]


@pytest.mark.parametrize("seed", [0, 1])
def test_graphs_of_small_diameter_keep_their_guarantee(spark, seed):
    """A star's paths have one internal node, a ring's of five as well; the complete graph's have none."""
    shapes = {"star": [(0, i) for i in range(1, 10)], "ring": [(i, (i + 1) % 5) for i in range(5)], "complete": [(i, j) for i in range(5) for j in range(i)]}
    for pairs in shapes.values() if seed == 0 else [shapes["star"]]:
        want = brandes(both(pairs))
        result = P.approximate_betweenness(frame(spark, pairs), eps=0.1, seed=seed)
        got = {r["node"]: r for r in result.scores.collect()}
        assert all(abs(got[v]["bc"] - x) <= 0.1 and got[v]["lower"] - 1e-9 <= x <= got[v]["upper"] + 1e-9 for v, x in want.items())


def test_hopeless_pairs_are_told_by_heights(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (5, 4), (5, 6)]
    edges = frame(spark, pairs)
    comps = K.strong_components(edges, G.nodes_of(edges)).cache()
    diameter, heights = K.diameter_and_heights(edges, comps)
    assert {r["comp"]: r["height"] for r in heights.collect()} == {1: 2, 3: 1, 4: 0, 5: 1, 6: 0} and diameter >= 3


def test_topk_run_holds_the_top(spark):
    pairs = [(0, i) for i in range(1, 12)] + [(0, 20), (20, 21)] + [(20, 30 + i) for i in range(6)]
    want = brandes(both(pairs))
    result = P.approximate_betweenness(frame(spark, pairs), eps=0.3, k=2)
    got = {r["node"]: r["bc"] for r in result.scores.collect()}
    assert {0, 20} <= set(got) and all(abs(got[v] - want[v]) <= 0.3 * want[v] + 1e-9 for v in (0, 20))


def test_degenerate_runs(spark):
    star = P.approximate_betweenness(frame(spark, [(0, 1)]), eps=0.1)
    assert {r["bc"] for r in star.scores.collect()} == {0.0}
    assert P.approximate_betweenness(frame(spark, []), eps=0.1).scores.count() == 0
    assert P.approximate_betweenness(frame(spark, [(3, 3)]), eps=0.1).scores.count() == 0
    alone = P.approximate_betweenness(frame(spark, [(0, 1)]), eps=0.1, nodes=spark.range(4))
    assert alone.scores.count() == 4
    for bad in ({"eps": 0.0}, {"eps": 1.0}, {"eps": 0.1, "delta": 0.0}, {"eps": 0.1, "k": -1}, {"eps": 0.1, "mode": "x"}):
        with pytest.raises(ValueError):
            P.approximate_betweenness(frame(spark, [(0, 1)]), **bad)


def strong(pairs):
    """Strong components of a small graph by reachability."""
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    nodes = {x for e in pairs for x in e}

    def reach(s):
        seen, todo = {s}, [s]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    to = {x: reach(x) for x in nodes}
    return {x: min(y for y in to[x] if x in to[y]) for x in nodes}


@pytest.mark.parametrize("one", [100_000, 0])
def test_chains_and_cycles(spark, one, monkeypatch):
    """Chains between components, chains inside one, cycles apart, a chain that returns to where it came from."""
    monkeypatch.setattr(K, "ONE_PARTITION", one)
    ring = [(i, i + 1) for i in range(100, 140)] + [(140, 100)]
    path = [(i + 1, i) for i in range(200, 237)]
    ear = [(300, 301), (301, 302), (302, 300), (300, 303), (303, 304), (304, 305), (305, 300), (305, 400), (400, 401), (401, 402), (402, 500)]
    back = [(500, 501), (501, 500), (500, 50), (50, 51), (51, 501), (3, 2), (2, 1), (1, 3), (9, 9)]
    pairs = ring + path + ear + back
    edges = frame(spark, pairs)
    got = {r["id"]: r["comp"] for r in K.strong_components(edges, G.nodes_of(edges)).collect()}
    assert got == strong(pairs)
    r = random.Random(7)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(75)]
    edges = frame(spark, pairs)
    assert {x["id"]: x["comp"] for x in K.strong_components(edges, G.nodes_of(edges)).collect()} == strong(pairs)


def test_long_chain_takes_few_jobs(spark):
    edges = cut(spark.range(10_000).select("id", (F.col("id") + 1).alias("dst")).withColumnRenamed("id", "src"))
    nodes = cut(G.nodes_of(edges))
    spark.sparkContext.setJobGroup("chain", "")
    try:
        comps = K.strong_components(edges, nodes)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    assert jobs < 60
    assert comps.where("id = comp").count() == 10_001


def test_grid_equals_single_runs(spark):
    """A run in a grid sees the samples that it sees alone, so its scores are the same."""
    edges = frame(spark, random_graph(5, 40, 160))
    settings = [P.Setting(0.2, 0.1), P.Setting(0.12, 0.1)]
    told = []
    results = P.betweenness_grid(edges, settings, directed=True, progress=told.append)
    alone = P.approximate_betweenness(edges, 0.12, 0.1, directed=True)
    a, b = (sorted(map(tuple, x.scores.collect())) for x in (alone, results[1]))
    assert [r[0] for r in a] == [r[0] for r in b] and all(abs(x - y) < 1e-9 for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))
    assert {x["phase"] for x in told} == {1, 2} and all(r.metrics["settled"] for r in results)
    assert max(x["m"] for x in told if x["phase"] == 2) == max(r.metrics["m"] for r in results)
    with pytest.raises(ValueError):
        P.betweenness_grid(edges, [P.Setting(0.1, alpha=2.0), P.Setting(0.1, alpha=3.0)], mode="multi")


def test_runs_end_at_most_samples(spark):
    edges = frame(spark, random_graph(5, 30, 90))
    result = P.approximate_betweenness(edges, 0.001, 0.1, directed=True, most_samples=1500)
    assert result.metrics["m"] == 1500 and not result.metrics["settled"] and result.metrics["stopped_by"] == "most_samples"
    exact = brandes([e for e in random_graph(5, 30, 90) if e[0] != e[1]])
    assert all(r["lower"] - 1e-12 <= exact[r["node"]] <= r["upper"] + 1e-12 for r in result.scores.collect())
