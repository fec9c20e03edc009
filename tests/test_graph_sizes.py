"""What goes wrong only beyond some size, with the sizes made small."""

import random

from pyspark.sql import functions as F

from tessera.operators import structure, traverse
from tessera.operators.arcs import Arcs, relax
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Grown, cut


def graph(spark, edges, n):
    e = spark.createDataFrame([(a, b, i, float(w)) for i, (a, b, w) in enumerate(edges)], "src long, dst long, eid long, weight double")
    return PropertyGraph(spark.range(n), e)


def test_ids_that_improve_twice_have_one_row_over_bucketed_arcs(spark, monkeypatch):
    monkeypatch.setattr(Arcs, "FEW", 5)
    rng = random.Random(3)
    edges = [(i, i + 1, 1) for i in range(11)] + [(0, i, 3 * i) for i in range(2, 12)] + [(rng.randrange(12), rng.randrange(12), 40) for _ in range(20)]
    found = cut(traverse.sssp(graph(spark, edges, 12), spark.range(1)).select("id", "dist"))
    assert sorted(tuple(r) for r in found.collect()) == [(i, float(i)) for i in range(12)]


def test_expand_without_a_limit(spark):
    g = graph(spark, [(0, i, 1) for i in range(1, 700)], 700)
    assert traverse.expand(g, g.vertex(0), 2)[1].count() == 499
    assert traverse.expand(g, g.vertex(0), 2, None)[1].count() == 699


def test_betweenness_in_batches_that_grow(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(9), rng.randrange(9), 1) for _ in range(20)] + [(0, 1, 1), (0, 1, 1)]
    g = graph(spark, edges, 9)
    score = lambda **o: {r["id"]: round(r["score"], 9) for r in structure.betweenness(g, None, include_source=False, scale="none", **o).collect()}
    monkeypatch.setattr(structure, "REACHED", 20)
    assert score(batch=3) == score(batch=64)


def test_betweenness_does_not_offer_a_hub_to_all_its_predecessors(spark, monkeypatch):
    rows, group = [], structure.Arcs.send
    monkeypatch.setattr(structure.Arcs, "send", lambda self, df: (lambda out: rows.append(out.count()) or out)(group(self, df)))
    found = structure.betweenness(graph(spark, [(i, 40, 1) for i in range(40)], 41), None, include_source=False, scale="none", batch=8)
    assert found.agg(F.sum("score")).first()[0] == 0.0 and sum(rows) <= 4 * 41


def test_sampled_betweenness_sends_a_row_for_all_sources(spark, monkeypatch):
    monkeypatch.setattr(Grown, "MOST", 2)  # levels are more than the parts that are kept apart
    # a crowd, a path, a vertex that nothing reaches, parallel edges and a loop
    g = graph(spark, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (7, 2, 1), (4, 4, 1)], 9)
    score = lambda k, **o: {r["id"]: round(r["score"], 9) for r in structure.betweenness(g, k, include_source=False, scale="none", **o).collect()}
    assert score(9, batch=7) == score(None)
    rows, send = [], Arcs.send
    crowd = graph(spark, [(a, b, 1) for a in range(16) for b in range(16)], 16)
    monkeypatch.setattr(Arcs, "send", lambda self, df: (lambda out: rows.append(out.count()) or out)(send(self, df)))
    assert structure.betweenness(crowd, 16, scale="none").agg(F.sum("score")).first()[0] == 16 * 15
    assert sum(rows) <= 2 * 240


def moved(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_triangles_move_no_row_for_each_two_targets(spark):
    size, last = 40, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    pairs = cut(graph(spark, [(a, size + b, 1) for a in range(size) for b in range(size)] + [(0, 1, 1)], 2 * size).undirected())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved(spark)
        found = structure.triangles(pairs).collect()
        assert sorted(map(tuple, found)) == [(0, 1, size + b) for b in range(size)]
        assert moved(spark) - before < 8 * size * size  # of two targets there are 19 for each pair
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", last)


def test_counted_paths_are_not_grouped(spark):
    g = graph(spark, [(0, 1, 1), (0, 1, 1), (1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)], 3)
    found = traverse.counted_paths(g, 2)
    assert sorted((r["path"], r["n"]) for r in found.collect()) == [([0, 1, 2], 6), ([1, 2, 2], 3), ([2, 2, 2], 1)]
    assert traverse.paths(g, 2).count() == 10


def peeled(edges, n):
    near = {v: set() for v in range(n)}
    for a, b, _ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for u in near.pop(v):
            near[u].discard(v)
    return core


def test_k_core_over_bucketed_arcs_reads_only_what_falls(spark, monkeypatch):
    rows, send = [], Arcs.send
    monkeypatch.setattr(Arcs, "FEW", 5)
    rng = random.Random(8)
    edges = [(a, b, 1) for a in range(12) for b in range(a) if rng.random() < 0.8] + [(rng.randrange(30), rng.randrange(30), 1) for _ in range(45)]
    assert {r["id"]: r["core"] for r in structure.k_core(graph(spark, edges, 32)).collect()} == peeled(edges, 32)
    # a path beside a clique, whose ends alone fall
    path = [(i, i + 1, 1) for i in range(9)] + [(9, 10 + a, 1) for a in range(2)] + [(10 + a, 10 + b, 1) for a in range(12) for b in range(a)]
    monkeypatch.setattr(Arcs, "send", lambda self, df: (lambda out: rows.append(out.count()) or out)(send(self, df)))
    assert {r["id"]: r["core"] for r in structure.k_core(graph(spark, path, 22)).collect()} == peeled(path, 22)
    assert len(rows) > 5 and all(n <= 4 for n in rows[2:])


def test_states_over_bucketed_arcs_are_not_broadcast(spark, monkeypatch):
    plans, add = [], Grown.add
    monkeypatch.setattr(Arcs, "FEW", 5)
    monkeypatch.setattr(Grown, "add", lambda self, df, *m: plans.append(df._jdf.queryExecution().executedPlan().toString()) or add(self, df, *m))
    arcs = Arcs(graph(spark, [(i, i + 1, 1) for i in range(7)], 8).pairs().select("src", "dst"))
    start = spark.range(1).selectExpr("id", "0L AS value", "CAST(NULL AS LONG) AS parent")
    assert relax(arcs, start, lambda v: v + 1, max_rounds=2).count() == 3
    assert len(plans) == 3 and not any("BroadcastHashJoin" in p for p in plans)
