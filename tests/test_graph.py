"""Graph operators against fixed expectations and brute-force versions on random multigraphs."""

import itertools
import math
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.operators import communities, incremental, ranking, structure, traverse
from tessera.plans.graph import PropertyGraph


def graph(spark, edges, n=None, weights=None, both=False):
    if both:
        edges = edges + [(b, a) for a, b in edges]
    rows = [(a, b, i, float(weights[i]) if weights else 1.0) for i, (a, b) in enumerate(edges)]
    e = spark.createDataFrame(rows, "src long, dst long, eid long, weight double")
    v = None if n is None else spark.range(n)
    return PropertyGraph.from_edges(e, v)


def ids(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "id long")


def as_map(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def random_edges(seed, n=14, m=40):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.fixture(scope="module")
def ports(spark):
    v = spark.createDataFrame([(10, P.props({"port": "Oslo", "berths": 14})), (20, P.props({"port": "Riga", "berths": 6})), (30, P.props({"port": "Turku", "berths": 14, "ice": None})), (40, P.props({"port": "Visby"}))], "id long, props map<string,struct<t:tinyint,i:bigint,d:double,s:string,b:boolean>>")
    e = spark.createDataFrame([(10, 20, 0, 1.0, "ferry"), (20, 30, 1, 1.0, "ferry"), (20, 30, 2, 1.0, "ferry"), (20, 40, 3, 1.0, "freight")], "src long, dst long, eid long, weight double, kind string")
    return PropertyGraph(v, e)


def test_typed_queries(spark, ports):
    found = lambda *c, **more: sorted(r["id"] for r in ports.find_vertices(*c, **more).collect())
    assert found(P.equals("props", "port", "Riga")) == [20]
    assert found(P.equals("props", "berths", 14)) == [10, 30]
    assert found(P.equals("props", "berths", 14.0)) == []
    assert found(P.equals("props", "ice", None)) == [30] and found(P.has("props", "ice")) == [30]
    assert found(P.greater("props", "berths", 8), P.less("props", "port", "Q")) == [10]
    assert found(P.greater("props", "berths", 8.0)) == []
    labels = spark.createDataFrame([(10, 1), (20, 2), (30, 1)], "id long, label long")
    assert found(P.equals("props", "berths", 14), community=(labels, 1)) == [10, 30] and found(community=(labels, 2)) == [20]
    rows = lambda *a, **k: sorted(tuple(r) for r in ports.match(*a, **k).collect())
    assert rows([("a", P.equals("props", "port", "Oslo")), ("b", None)], [("out", F.col("kind") == "ferry")]) == [(10, 20)]
    assert rows([("a", None), ("b", None)], [("out", "freight")]) == [(20, 40)]
    assert rows([("a", None), ("b", None), ("c", None)], [("out", None), ("out", "ferry")]) == [(10, 20, 30)]
    assert rows([("a", None), ("b", None), ("c", None)], [("out", None), ("out", "ferry")], parallel=True) == [(10, 20, 30)] * 2
    assert traverse.shortest_path(ports, 10, 30) == [10, 20, 30] and traverse.shortest_path(ports, 30, 10) == []
    assert traverse.shortest_path(ports, 20, 20) == [20]
    assert [(r.src, r.dst) for r in ports.find_edges(src=10).collect()] == [(10, 20)]
    assert ports.aggregate(P.number("props", "berths")).first().asDict() == {"n": 3, "total": 34.0, "mean": 34 / 3, "least": 6.0, "most": 14.0}
    assert ports.aggregate(P.number("props", "port")).count() == 0
    assert {(r.port, r.berths, r.n) for r in ports.group_counts("port", "berths").collect()} == {("Oslo", "?", 1), ("Riga", "?", 1), ("Turku", "?", 1), ("Visby", "(无)", 1)}
    vertex, edges = ports.detail(20)
    assert vertex.count() == 1 and sorted((r.way, r.kind, r.n, r.other) for r in edges.collect()) == [("in", "ferry", 1, 10), ("out", "ferry", 2, 30), ("out", "ferry", 2, 30), ("out", "freight", 1, 40)]
    with pytest.raises(ValueError):
        ports.match([("a", None)], [("out", None)])


def test_doubles_compare_by_bits(spark):
    df = spark.createDataFrame([(k, P.props({"d": v})) for k, v in enumerate([0.0, -0.0, float("nan"), 1.5])], "id long, props map<string,struct<t:tinyint,i:bigint,d:double,s:string,b:boolean>>")
    for k, v in enumerate([0.0, -0.0, float("nan"), 1.5]):
        assert [r["id"] for r in df.where(P.equals("props", "d", v)).collect()] == [k]
    assert P.to_json(P.from_json('{"a": 1, "b": 1.5, "c": [1], "d": true, "e": null, "f": "x"}')) == '{"a": 1, "b": 1.5, "c": null, "d": true, "e": null, "f": "x"}'


def test_parallel_edges(spark):
    g = graph(spark, [(1, 2), (1, 2), (1, 2), (1, 3)], weights=[0.9, 0.8, 0.7, 0.5])
    assert [r.weight for r in g.edges_between(1, 2).collect()] == [0.9, 0.8, 0.7]
    assert g.edge(1, 2).first().weight == 0.7 and g.edge(9, 9).count() == 0
    assert as_map(g.degrees(), "out_degree") == {1: 4, 2: 0, 3: 0}
    assert g.simple().edges.count() == 2
    assert g.delete_edges(spark.createDataFrame([(1, 2)], "src long, dst long")).edges.count() == 1
    assert g.delete_edges(spark.createDataFrame([(1,)], "eid long")).edges.count() == 3
    assert g.stats().first().asDict() == {"n_vertices": 3, "n_edges": 4, "n_blocks": 3}


def test_changes(spark):
    g = graph(spark, [(1, 2), (1, 3), (2, 3), (3, 1)])
    left = g.delete_vertices(ids(spark, 1))
    assert sorted((r.src, r.dst) for r in left.edges.collect()) == [(2, 3)] and left.vertices.count() == 2
    more = g.add_edges(spark.createDataFrame([(3, 7)], "src long, dst long"))
    assert as_map(more.degrees(), "in_degree")[7] == 1
    new = g.new_vertices(spark.createDataFrame([("b",), ("a",)], "name string"), "name").vertices
    assert {r["name"]: r["id"] for r in new.where("name is not null").collect()} == {"a": 4, "b": 5}
    csr = {r["id"]: (r.place, r["first"], r.n) for r in g.to_csr().collect()}
    assert csr == {1: (0, 0, 2), 2: (1, 2, 1), 3: (2, 3, 1)}
    targets = spark.createDataFrame([(0, 2), (1, 3), (2, 3), (3, 1)], "place long, dst long")
    assert sorted((r.src, r.dst) for r in PropertyGraph.from_csr(g.to_csr(), targets).edges.collect()) == [(1, 2), (1, 3), (2, 3), (3, 1)]
    assert PropertyGraph(ids(spark, 1), g._edges).dangling().count() == 4


def test_empty_graph(spark):
    g = PropertyGraph.empty(spark)
    for df in (ranking.pagerank(g, 2), structure.connected_components(g), structure.strongly_connected_components(g), structure.cores(g), structure.k_core(g), structure.betweenness(g), structure.clustering(g), communities.label_propagation(g), communities.louvain(g)[0], g.degrees()):
        assert df.count() == 0
    assert g.density().first().asDict() == {"density": 0.0, "average_degree": 0.0}


def test_traversals(spark):
    g = graph(spark, [(7, 8), (7, 9), (8, 9), (9, 11), (11, 12), (12, 7), (8, 8)])
    seen, crossed = traverse.walk(g, ids(spark, 7), 2)
    assert as_map(seen, "dist") == {7: 0, 8: 1, 9: 1, 11: 2}
    assert sorted((r.src, r.depth, r.dst) for r in crossed.collect()) == [(7, 0, 8), (7, 0, 9), (8, 1, 8), (8, 1, 9), (9, 1, 11)]
    assert traverse.bfs(g, ids(spark, 99)).count() == 0 and as_map(traverse.bfs(g, ids(spark, 11), 0), "dist") == {11: 0}
    sub = traverse.subgraph(g, ids(spark, 11), 2)
    assert sorted(r["id"] for r in sub.vertices.collect()) == [7, 11, 12] and sorted((r.src, r.dst) for r in sub.edges.collect()) == [(11, 12), (12, 7)]
    walks = traverse.paths(g, 2)
    assert sorted(r.path for r in walks.collect()) == [[7, 8, 8], [7, 8, 9], [7, 9, 11], [8, 8, 8], [8, 8, 9], [8, 9, 11], [9, 11, 12], [11, 12, 7], [12, 7, 8], [12, 7, 9]]
    assert sorted(r.path for r in traverse.simple_paths(g, 8, 12, 3).collect()) == [[8, 7, 12], [8, 9, 7, 12], [8, 9, 11, 12]]
    assert traverse.simple_paths(g, 7, 7).count() == 0
    rows, n = traverse.limited(walks, 2, ["path"])
    assert (rows.count(), n) == (2, 10)


def test_loops_over_bucketed_arcs(spark, monkeypatch):
    """What large graphs go through: bucketed arcs, hubs apart, merged parts."""
    from tessera.operators.arcs import Arcs
    from tessera.plans.iterate import Grown

    e = random_edges(21, 10, 24) + [(3, k) for k in range(10)]
    g = graph(spark, e, 12, [1 + k % 4 for k in range(len(e))])
    run = lambda: [as_map(ranking.pagerank(g, 3), "score"), as_map(traverse.sssp(g, ids(spark, 0)), "dist"), as_map(structure.k_core(g), "core")]
    plain = run()
    monkeypatch.setattr(Arcs, "FEW", 5)
    monkeypatch.setattr(Arcs, "SPLIT", 6)
    monkeypatch.setattr(Grown, "MOST", 1)
    for a, b in zip(plain, run()):
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_weighted_paths(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (0, 2)], weights=[1, 1, 5, 4])
    assert traverse.shortest_path_weighted(g, 0, 2) == ([0, 1, 2], 2.0)
    assert traverse.shortest_path_weighted(g, 2, 0) == ([], math.inf)
    e = random_edges(3)
    w = [random.Random(i).randrange(1, 9) for i in range(len(e))]
    best = {0: 0}
    for _ in range(20):
        for (a, b), x in zip(e, w):
            if a in best and best[a] + x < best.get(b, 99):
                best[b] = best[a] + x
    assert as_map(traverse.sssp(graph(spark, e, 14, w), ids(spark, 0)), "dist") == best


def test_pagerank_values(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 4)], 5)
    want = {10: [0.339854839, 0.187857943, 0.347370096, 0.043814534, 0.081102587]}
    got = as_map(ranking.pagerank(g, 10), "score")
    assert [round(got[i], 9) for i in range(5)] == want[10]
    full = as_map(ranking.pagerank(g, 60, tol=1e-12), "score")
    assert [round(full[i], 6) for i in range(5)] == [0.339422, 0.188018, 0.347833, 0.043764, 0.080963]
    assert abs(sum(full.values()) - 1) < 1e-9
    assert sum(as_map(ranking.pagerank(g, 5, dangling="ignore"), "score").values()) < 1
    old = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0)], 5)
    near = as_map(incremental.pagerank(g, ranking.pagerank(old, 60), spark.createDataFrame([(3, 4)], "src long, dst long"), eps=1e-10), "score")
    assert max(abs(near[i] - full[i]) for i in range(5)) < 1e-4


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cores_match_brute_force(spark, seed):
    e, n = random_edges(seed, 16, 22), 16
    g = graph(spark, e, n)
    reach = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b in e:
            for v in range(n):
                if a in reach[v]:
                    reach[v].add(b)
    scc = {v: min(u for u in reach[v] if v in reach[u]) for v in range(n)}
    assert as_map(structure.strongly_connected_components(g), "label") == scc
    wcc = list(range(n))
    for _ in range(n):
        for a, b in e:
            wcc[a] = wcc[b] = min(wcc[a], wcc[b])
    assert as_map(structure.connected_components(g), "label") == dict(enumerate(wcc))
    rest, core, level = {v: sum(a == v for a, _ in e) for v in range(n)}, {}, 0
    while rest:
        level = max(level, min(rest.values()))
        gone = {v for v, d in rest.items() if d <= level}
        for v in gone:
            core[v] = level
            del rest[v]
        for a, b in e:
            if a in gone and b in rest and a != b:
                rest[b] -= 1
    assert as_map(structure.cores(g), "core") == core
    near = defaultdict(set)
    for a, b in e:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    left, kc, k = set(range(n)), {}, 0
    while left:
        low = [v for v in left if len(near[v] & left) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            kc[v] = k
        left -= set(low)
    assert as_map(structure.k_core(g), "core") == kc


@pytest.mark.parametrize("edges,want", [([(6, 2), (2, 6)], [{2, 6}]), ([(5, 1), (1, 9), (5, 9)], [{1}, {5}, {9}]), ([(1, 2), (2, 3), (3, 4), (4, 1), (4, 8), (8, 6), (6, 5), (5, 8), (5, 7)], [{1, 2, 3, 4}, {5, 6, 8}, {7}])])
def test_strong_components_fixed(spark, edges, want):
    parts = defaultdict(set)
    for v, label in as_map(structure.strongly_connected_components(graph(spark, edges)), "label").items():
        parts[label].add(v)
    assert sorted(parts.values(), key=min) == want


def test_core_fixed(spark):
    assert as_map(structure.cores(graph(spark, [(0, 1), (1, 2), (2, 0)], both=True)), "core") == {0: 2, 1: 2, 2: 2}
    assert as_map(structure.cores(graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4)], both=True)), "core") == dict.fromkeys(range(5), 1)


def test_betweenness(spark):
    line = graph(spark, [(0, 1), (1, 2), (2, 3)], 4)
    assert {k: round(v, 6) for k, v in as_map(structure.betweenness(line), "score").items()} == {0: 0.5, 1: 0.666667, 2: 0.5, 3: 0.0}
    assert {k: round(v, 6) for k, v in as_map(structure.betweenness(line, include_source=False, batch=2), "score").items()} == {0: 0.0, 1: 0.333333, 2: 0.333333, 3: 0.0}
    star = as_map(structure.betweenness(graph(spark, [(0, 1), (0, 2), (0, 3)], 4)), "score")
    assert star == {0: 0.5, 1: 0.0, 2: 0.0, 3: 0.0}
    e, n = random_edges(5, 10, 25), 10
    mult = Counter((a, b) for a, b in e if a != b)
    want = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        dist, paths, order = {s: 0}, Counter({s: 1}), []
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for (a, b), k in mult.items():
                if a == v:
                    if b not in dist:
                        dist[b] = dist[v] + 1
                        queue.append(b)
                    if dist[b] == dist[v] + 1:
                        paths[b] += paths[v] * k
        delta = Counter()
        for v in reversed(order):
            for (a, b), k in mult.items():
                if b == v and a in dist and dist[v] == dist[a] + 1:
                    delta[a] += paths[a] * k / paths[v] * (1 + delta[v])
            want[v] += delta[v]
    got = as_map(structure.betweenness(graph(spark, e, n), None, scale="none"), "score")
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_triangles_and_clustering(spark):
    e = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (1, 3)]
    g = graph(spark, e, 6)
    assert structure.triangles(g.undirected()).count() == 2
    assert {k: round(v, 6) for k, v in as_map(structure.clustering(g), "coefficient").items()} == {0: 1.0, 1: 0.666667, 2: 0.666667, 3: 0.333333, 4: 0.0, 5: 0.0}
    assert structure.directed_triangles(graph(spark, [(0, 1), (1, 2), (2, 0)])).count() == 0
    assert structure.directed_triangles(graph(spark, [(0, 1), (1, 2), (0, 2)])).count() == 1
    e, n = random_edges(9, 14, 50), 14
    und = {frozenset(x) for x in e if x[0] != x[1]}
    want = sorted(t for t in itertools.combinations(range(n), 3) if all(frozenset(p) in und for p in itertools.combinations(t, 2)))
    g = graph(spark, e, n)
    assert sorted(map(tuple, structure.triangles(g.undirected()).collect())) == want
    old, new = e[:40], e[40:]
    fresh = spark.createDataFrame(new, "src long, dst long")
    was = {frozenset(x) for x in old if x[0] != x[1]}
    before = [t for t in want if all(frozenset(p) in was for p in itertools.combinations(t, 2))]
    now = sorted(map(tuple, incremental.triangles(g, fresh).collect()))
    assert set(want) - set(before) <= set(now) <= set(want)
    o = graph(spark, old, n)
    assert sorted(map(tuple, incremental.triangles_difference(structure.triangles(o.undirected()), structure.triangles(g.undirected())).collect())) == sorted(set(want) - set(before))
    key = lambda df: sorted(map(tuple, df.select("id", "degree", "triangles").collect()))
    assert key(incremental.clustering(g, structure.clustering(o), fresh)) == key(structure.clustering(g))


def test_incremental_distances_and_components(spark):
    e, n = random_edges(11, 16, 34), 16
    w = [1 + i % 5 for i in range(len(e))]
    g = graph(spark, e, n, w)
    o = PropertyGraph(g.vertices, g._edges.where("eid < 24"))
    fresh = g.edges.where("eid >= 24").select("src", "dst")
    assert as_map(incremental.bfs(g, traverse.bfs(o, ids(spark, 0)), fresh), "dist") == as_map(traverse.bfs(g, ids(spark, 0)), "dist")
    assert as_map(incremental.sssp(g, traverse.sssp(o, ids(spark, 0)), fresh), "dist") == as_map(traverse.sssp(g, ids(spark, 0)), "dist")
    labels, merges = incremental.connected_components(structure.connected_components(o), fresh)
    assert as_map(labels, "label") == as_map(structure.connected_components(g), "label")
    assert merges == structure.connected_components(o).select("label").distinct().count() - labels.select("label").distinct().count()
    path = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 3)], 5)
    before = traverse.bfs(graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4)], 5), ids(spark, 0))
    after = incremental.bfs(path, before, spark.createDataFrame([(0, 3)], "src long, dst long"))
    assert as_map(after, "dist") == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2} and incremental.updates(before, after, "dist") == 2
    now, changed = incremental.k_core(g, structure.k_core(o))
    assert changed >= 0 and as_map(now, "core") == as_map(structure.k_core(g), "core")


def test_centralities(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 5)
    near = {0: [1, 2], 1: [0, 2], 2: [1, 0, 3], 3: [2], 4: []}
    x = dict.fromkeys(range(5), 1.0)
    for _ in range(200):
        x = {v: 0.1 * sum(x[u] for u in near[v]) + 1 for v in x}
    got = as_map(ranking.katz(g), "score")
    assert max(abs(got[v] - x[v]) for v in x) < 1e-5
    assert max(abs(s - x[v]) for v, s in as_map(incremental.katz(g, ranking.katz(g)), "score").items()) < 1e-5
    got = as_map(ranking.eigenvector(g, 200), "score")
    assert abs(sum(s * s for s in got.values()) - 1) < 1e-6 and got[4] == 0 and max(got, key=got.get) == 2
    assert [r["id"] for r in ranking.top(ranking.pagerank(g, 5), 2, by="id").collect()] == [0, 1]


def test_communities(spark):
    square = [(a, b) for k in (10, 20) for a, b in itertools.combinations(range(k, k + 4), 2)] + [(13, 21)]
    got = as_map(communities.louvain(graph(spark, square))[0], "label")
    assert got == {v: v // 10 * 10 for v in got}
    assert as_map(communities.louvain_one_level(graph(spark, square)), "label") == got
    g = graph(spark, square)
    two = spark.createDataFrame([(v, v // 10) for v in (*range(10, 14), *range(20, 24))], "id long, label long")
    assert abs(communities.modularity(g, two).first().q - (12 / 13 - 0.5)) < 1e-9
    apart = graph(spark, [(10, 11), (11, 12), (30, 31), (31, 32)])
    assert as_map(communities.greedy_merge(apart), "label") == {10: 0, 11: 0, 12: 0, 30: 1, 31: 1, 32: 1}
    assert as_map(communities.greedy_merge(apart, 1), "label") == {10: 0, 11: 0, 12: 1, 30: 2, 31: 3, 32: 4}
    assert set(as_map(communities.label_propagation(g, 20), "label")) == {*range(10, 14), *range(20, 24)}
    assert communities.greedy_move(g).count() == 8
    assert {r["id"] for r in communities.community_of(two, 22).collect()} == set(range(20, 24))
    assert {(r.label, r.n, r.least) for r in communities.members(two).collect()} == {(1, 4, 10), (2, 4, 20)}
    assert [r["id"] for r in communities.member_rows(two).where("label = 2").orderBy("place").collect()] == [20, 21, 22, 23]


def test_core_numbers_after_changes(spark):
    e = random_edges(31, 14, 60)
    g, less = graph(spark, e, 14), graph(spark, e[:45], 14)
    full, small = as_map(structure.k_core(g), "core"), as_map(structure.k_core(less), "core")
    assert as_map(incremental.k_core(less, structure.k_core(g), added=0)[0], "core") == small
    now, changed = incremental.k_core(g, structure.k_core(less), added=15)
    assert as_map(now, "core") == full and changed == sum(full[v] != small[v] for v in full)
    k = max(full.values())
    assert {r["id"]: r.change for r in incremental.core_members(structure.k_core(less), now, k).collect()} == {v: 1 for v in full if full[v] >= k > small[v]}
