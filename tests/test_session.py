"""The call-by-call API and its HTTP view."""

import json
import urllib.request

from tessera.functions.session import GraphSession
from tessera.plans.service import GraphService


def test_session(spark, tmp_path):
    s = GraphSession.open(spark, str(tmp_path / "g"))
    assert (s.vertex_count(), s.edge_count()) == (0, 0)
    s.add_vertex(1, {"name": "a"})
    assert s.batch_add_edges([(1, 2, 0.9), (1, 3, 0.5)]) == 2
    s.add_edge(1, 2, 0.1, {"relation": "r"})
    assert s.out_neighbors(1) == [2, 3, 2] and s.in_neighbors(2) == [1, 1] and s.out_neighbors(9) == []
    assert s.get_edge(1, 2) == (0.1, {"relation": "r"}) and len(s.get_edges(1, 2)) == 2 and s.get_edge(5, 6) is None
    assert s.out_edges_cols(1) == ([2, 3, 2], ["", "", "r"])
    assert s.out_edges(1)[2] == (2, 0.1, {"relation": "r"}) and [x[0] for x in s.in_edges(2)] == [1, 1]
    assert s.bfs(1) == {1: 0, 2: 1, 3: 1} and s.walk(1, 1) == [1, 2, 3] and s.shortest_path(1, 3) == [1, 3]
    assert s.find_paths(1) == [[1, 2], [1, 2], [1, 3]] and s.subgraph([1], 1)[0] == [1, 2, 3]
    assert abs(sum(s.pagerank(5).values()) - 1) < 1e-9 and set(s.wave_core()) == {1, 2, 3}
    assert s.tarjan_scc() == [[1], [2], [3]] and set(s.louvain()) == {1, 2, 3} and set(s.betweenness()) == {1, 2, 3}
    assert s.remove_edge(1, 2) and not s.remove_edge(1, 2) and s.edge_count() == 1
    assert s.delete_vertex(3) == {} and s.delete_vertex(3) is None and s.edge_count() == 0
    assert s.save() == 1 and GraphSession.open(spark, str(tmp_path / "g")).get_vertex(1) == {"name": "a"}
    assert s.save_to(str(tmp_path / "h")) == 1 and repr(s) == "GraphSession(2 vertices, 0 edges)"


def test_service(spark, tmp_path):
    service = GraphService(GraphSession(spark, str(tmp_path / "g")))
    call = lambda verb, path, **body: service.handle(verb, path, json.dumps(body).encode() if body else b"")
    assert call("GET", "/health")[0] == 200 and call("GET", "/nothing")[0] == 404 and call("OPTIONS", "/x") == (200, {})
    assert call("POST", "/vertices", id=1, properties={"k": 1})[0] == 201 and call("POST", "/vertices")[0] == 400
    assert service.handle("POST", "/vertices", b"{")[0] == 400
    assert call("GET", "/vertices/1") == (200, {"id": 1, "properties": {"k": 1}}) and call("GET", "/vertices/8")[0] == 404
    for a, b in ((1, 2), (2, 3)):
        assert call("POST", "/edges", **{"from": a, "to": b, "weight": 2.0, "properties": {"x": "y"}})[0] == 201
    assert call("GET", "/neighbors/1")[1]["neighbors"] == [2] and call("GET", "/neighbors/3/in")[1]["neighbors"] == [2]
    assert call("GET", "/stats")[1] == {"vertex_count": 3, "edge_count": 2, "mode": "stored"}
    assert abs(call("POST", "/algorithms/pagerank", iterations=5)[1]["sum"] - 1) < 1e-9
    assert call("POST", "/algorithms/bfs", source=1)[1]["distances"] == {"1": 0, "2": 1, "3": 2}
    assert call("POST", "/traverse/walk", start=1, max_depth=2)[1]["edges_traversed"] == [{"from": 1, "depth": 0, "to": 2}, {"from": 2, "depth": 1, "to": 3}]
    assert call("POST", "/traverse/subgraph", seeds=[2])[1]["edges"] == [{"from": 2, "to": 3, "weight": 2.0}]
    assert call("POST", "/traverse/find_paths", path_length=2)[1] == {"path_length": 2, "total_found": 1, "returned": 1, "paths": [[1, 2, 3]]}
    assert call("DELETE", "/edges/1/2")[0] == 200 and call("DELETE", "/edges/1/2")[0] == 404 and call("DELETE", "/vertices/3")[0] == 200
    assert call("POST", "/admin/save")[1]["version"] == 1
    server = service.serve()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/stats") as r:
        assert json.load(r)["vertex_count"] == 2
    assert call("POST", "/admin/shutdown")[0] == 200 and service.stop.is_set()
    server.shutdown()
    server.server_close()
