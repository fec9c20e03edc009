"""The flow queries against brute force, on a sparser graph of their own."""

import datetime
import random
from itertools import combinations

import pytest


@pytest.fixture(scope="module")
def flow(spark, tmp_path_factory):
    rng = random.Random(51)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), 3 + rng.randrange(6) + 6 * (i // 60) if rng.random() < 0.95 else 3 + rng.randrange(24), rng.choice(["view", "click"])) for i in range(240)]
    path = str(tmp_path_factory.mktemp("flow"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return path, [(a[2], b[2], a[0]) for a, b in zip(rows, rows[1:])], {r[2] for r in rows}


def distances(edges, start, weight=lambda a, b: 1):
    dist = {start: 0}
    for _ in range(40):
        for a, b, _ in edges:
            if a in dist and dist[a] + weight(a, b) < dist.get(b, 1e9):
                dist[b] = dist[a] + weight(a, b)
    return dist


def test_whole_flow_matches_brute_force(spark, flow):
    import __spark_entry__ as e

    path, edges, users = flow
    run = lambda name: e.queries()[name](spark, path).collect()
    hops = distances(edges, 3)
    assert {r.id: r.dist for r in run("t5_bfs")} == {v: d for v, d in hops.items() if d <= 6}
    assert {r.id: r.dist for r in run("d5_incremental_bfs")} == hops
    assert {r.id for r in run("t16_reachable")} == set(distances(edges, 7))
    far = distances(edges, 3, lambda a, b: 1 + (a * 7 + b * 3) % 11)
    for name in ("t10_weighted_distances", "d7_incremental_sssp"):
        assert {r.id: r.dist for r in run(name)} == far
    assert sorted((r.src, r.dst, r.eid) for r in run("t1_walk")) == sorted((a, b, i) for a, b, i in edges if hops.get(a, 9) < 2)
    reach = {v: set(distances(edges, v)) for v in users}
    assert {r.id: r.label for r in run("g9_strong_components")} == {v: min(w for w in reach[v] if v in reach[w]) for v in users}
    walks = {}
    for a, b, _ in edges:
        for c, d, _ in edges:
            if b == c:
                walks[f"{a}>{b}>{d}"] = walks.get(f"{a}>{b}>{d}", 0) + 1
    assert {r.path: r.n for r in run("t3_walks_of_length")} == walks
    near = {v: {x for a, b, _ in edges for x in (a, b) if v in (a, b)} - {v} for v in users}
    for name in ("g23_clustering", "d13_incremental_clustering"):
        got = {r.id: (r.degree, r.triangles) for r in run(name)}
        assert got == {v: (len(near[v]), sum(b in near[a] for a, b in combinations(near[v], 2))) for v in users}
    assert {(r.a, r.b): r.n for r in run("j7_common_neighbours")} == {(a, b): len(near[a] & near[b]) for a in users for b in near[a] if a < b}
    new = {frozenset((a, b)) for a, b, i in edges if i % 10 == 0}
    triangles = {t for t in combinations(sorted(users), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]}
    assert {(r.a, r.b, r.c) for r in run("d11_incremental_triangles")} == {t for t in triangles if any(frozenset(p) in new for p in combinations(t, 2))}


def test_communities_read_the_whole_flow(spark, flow):
    import __spark_entry__ as e

    path, _, users = flow
    for name in ("g15_louvain", "g16_louvain_one_level", "g18_greedy_move"):
        labels = {r.id: r.label for r in e.queries()[name](spark, path).collect()}
        assert set(labels) == users and len(set(labels.values())) < len(users)
