"""Files, the store with transactions and recovery, indexes, streams and the entry module."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.operators import structure
from tessera.plans.graph import PropertyGraph
from tessera.plans.inspect import report
from tessera.plans.memo import Memo
from tessera.sources import files, store
from tessera.sources.index import DuplicateValue, IndexedGraph, IndexRegistry
from tessera.streaming import deltas


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n\n0 1\n% note\n1\t2\n2 2\n  5 0  \nx y\n")
    g = files.read_edge_list(spark, str(tmp_path / "e.txt"))
    assert g.vertices.count() == 6
    assert [(r.src, r.dst) for r in g.edges.orderBy("eid").collect()] == [(0, 1), (1, 2), (5, 0)]
    files.write_edge_list(g, str(tmp_path / "out"))
    assert files.read_edge_list(spark, str(tmp_path / "out")).edges.count() == 3


def test_json_graph(spark, tmp_path):
    doc = {"version": 1, "vertexCount": 2, "edgeCount": 2, "vertices": [{"id": 1, "properties": {"name": "a"}}, {"properties": {}}], "edges": [{"from": 1, "to": 2, "properties": {}}, {"from": 1, "to": 2, "weight": 0.5, "properties": {"k": "v"}}, {"to": 3}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = files.read_json_graph(spark, str(tmp_path / "g.json"))
    assert sorted(r.weight for r in g.edges.collect()) == [0.5, 1.0] and g.vertices.count() == 2
    lines = {r.kind: json.loads(r.line) for r in files.json_graph(PropertyGraph(g.vertices.select("id"), g.edges.select("src", "dst", "eid", "weight"))).collect()}
    assert lines["graph"] == {"version": 1, "vertexCount": 2, "edgeCount": 2} and lines["edge"]["from"] == 1


def test_json_round_trips(spark, tmp_path):
    v = spark.createDataFrame([(4, "Ålesund", 'a "b"'), (5, None, "c")], "id long, name string, note string")
    e = spark.createDataFrame([(4, 5, 0, 1.0, "x"), (4, 5, 1, 0.5, None)], "src long, dst long, eid long, weight double, kind string")
    for k, (write, read) in enumerate(((files.write_json_lines, files.read_json_lines), (files.write_json_document, files.read_json_graph))):
        write(PropertyGraph(v, e), str(tmp_path / str(k)))
        back = read(spark, str(tmp_path / str(k)))
        assert {r["id"]: r.properties for r in back.vertices.collect()} == {4: {"name": "Ålesund", "note": 'a "b"'}, 5: {"note": "c"}}
        assert [(r.src, r.dst, r.weight, r.properties) for r in back.edges.orderBy("eid").collect()] == [(4, 5, 1.0, {"kind": "x"}), (4, 5, 0.5, {})]


def test_packed_graph(spark, tmp_path):
    v = [(2, P.props({"n": None, "b": True, "s": "é"})), (1, P.props({"i": -5, "d": 0.5}))]
    e = [(2, 1, 0.25, P.props({"k": "x"})), (1, 2, 1.0, {})]
    data = files.pack_graph(v, e)
    back_v, back_e = files.unpack_graph(data)
    assert back_v == sorted(v, key=lambda x: x[0]) and back_e == sorted(e, key=lambda x: x[:2])
    assert files.pack_graph(back_v, back_e) == data
    (tmp_path / "g.bin").write_bytes(data)
    g = files.read_packed(spark, str(tmp_path / "g.bin"))
    assert {(r.src, r.dst, r.weight) for r in g.edges.collect()} == {(2, 1, 0.25), (1, 2, 1.0)}
    assert json.loads(g.vertex(1).first().props) == {"i": -5, "d": 0.5}
    with pytest.raises(ValueError):
        files.unpack_graph(b"????" + data[4:])
    with pytest.raises(ValueError):
        files.unpack_graph(data[:4] + b"\x00\x09" + data[6:])


def test_block_files(spark, tmp_path):
    v = [(7, P.props({"s": "é", "n": None})), (3, {}), (5, P.props({"b": False}))]
    e = [(7, 3, 0.5, P.props({"k": 1})), (3, 7, 1.0, {}), (7, 3, 0.25, {})] + [(7, 5, 1.0, {})] * 70
    data = files.pack_blocks(v, e)
    back_v, back_e = files.unpack_blocks(data)
    assert back_v == v and sorted(map(str, back_e)) == sorted(map(str, e))
    assert [x[2] for x in back_e if x[:2] == (7, 3)] == [0.5, 0.25]
    (tmp_path / "g.blocks").write_bytes(data)
    g = files.read_packed(spark, str(tmp_path / "g.blocks"))
    assert (g.vertices.count(), g.edges.count()) == (3, 73)
    with pytest.raises(ValueError):
        files.unpack_blocks(data[:4] + b"\x00\x09" + data[6:])
    old = bytearray(data[:4] + b"\x00\x01" + data[6:])
    heads = 24 + 4 + 8 * 3
    blocks = heads + (4 + 4 * 3) * 2 + 4
    for i, owner in enumerate((0, 0, 0, 1)):  # the first number of a block was its owner once
        old[blocks + i * 34 * 4 : blocks + i * 34 * 4 + 4] = owner.to_bytes(4, "big")
    assert sorted(map(str, files.unpack_blocks(bytes(old))[1])) == sorted(map(str, e))


def test_dot_and_snapshot(spark):
    v = spark.createDataFrame([(1, 'A"x', None), (2, None, "")], "id long, name string, sid string")
    e = spark.createDataFrame([(1, 2, 0, 1.0), (2, 1, 1, 0.5)], "src long, dst long, eid long, weight double")
    g = PropertyGraph(v, e)
    labels = spark.createDataFrame([(1, 0), (2, 11)], "id long, label long")
    lines = [r.line for r in files.dot(g, "name", communities=labels).orderBy("part", "place").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}"
    assert lines[2] == '  1 [label="A\\"x", fillcolor="#FF6B6B"];' and lines[3] == '  2 [label="2", fillcolor="#4ECDC4"];'
    assert lines[4:6] == ["  1 -> 2;", "  2 -> 1 [weight=0.5];"]
    assert files.dot(g, directed=False).where("line like '% -- %'").count() == 2
    nodes, edges = files.snapshot(g, sid="sid", label="name")
    assert {(r["id"], r.sid, r.label) for r in nodes.collect()} == {(1, "1", 'A"x'), (2, "2", "2")} and edges.count() == 2


def test_random_graph_is_reproducible(spark):
    a, b = (files.random_graph(spark, 100, 500, skew=2.0, weighted=True).edges.orderBy("eid").collect() for _ in range(2))
    assert a == b and all(r.src != r.dst and 0 <= r.src < 100 and r.weight > 0 for r in a)


def test_store_versions_and_transactions(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.snapshot().vertices.count() == 0
    with s.begin() as tx:
        tx.add_vertex(1, '{"port": "Oslo"}')
        tx.add_edge(1, 2)
        tx.commit()
    old = s.snapshot()
    assert (old.vertices.count(), old.edges.count()) == (2, 1)
    with s.begin() as tx:
        tx.add_vertex(9)
    assert s.version() == 1
    with s.begin() as tx:
        tx.add_vertex(1, '{"port": "Oslo", "berths": 14}')
        tx.add_edge(1, 2, 0.5)
        tx.delete_edge(1, 2)
        tx.add_edge(2, 1, 0.25)
        tx.delete_vertex(7)
        tx.commit()
    assert old.vertex(1).first().props == '{"port": "Oslo"}' and s.snapshot(1).edges.count() == 1
    assert "berths" in s.snapshot().vertex(1).first().props
    assert [(r.src, r.dst, r.weight) for r in s.snapshot().edges.collect()] == [(2, 1, 0.25)]
    first, second = s.begin(), s.begin()
    first.add_vertex(3)
    first.commit()
    second.add_vertex(4)
    with pytest.raises(RuntimeError):
        second.commit()
    with pytest.raises(RuntimeError):
        first.add_vertex(5)


def test_recovery_replays_committed_transactions_only(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"))
    assert s.recover() is None
    log = lambda tx, end: spark.createDataFrame([("begin", None, None, None, None, None, tx, 0, None), ("add_vertex", 1 if tx == "a" else 2, None, None, None, "{}", tx, 1, None), *([(end, None, None, None, None, None, tx, 2, None)] if end else [])], store.DELTA)
    s.write_log(log("a", "commit"))
    s.write_log(log("b", None))
    s.write_log(log("c", "rollback"))
    assert s.recover() == 1 and [r["id"] for r in s.snapshot().vertices.collect()] == [1]
    assert s.recover() is None


def test_a_lost_race_changes_nothing(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"))
    s.publish(PropertyGraph.empty(spark))
    a, b = s.begin(), s.begin()
    a.add_edge(100, 101)
    b.add_edge(200, 201)
    first = store.GraphStore._unchanged
    try:  # b finds its base unchanged, then a publishes, then b goes on
        seen = []
        store.GraphStore._unchanged = lambda self, base: seen.append(a.commit()) or first(self, base) if not seen and base is not None and seen.append(0) is None else first(self, base)
        with pytest.raises(store.Conflict):
            b.commit()
    finally:
        store.GraphStore._unchanged = first
    assert s.version() == 2 and [(r.src, r.dst) for r in s.snapshot(2).edges.collect()] == [(100, 101)]
    assert s.recover() is None and s.version() == 2  # neither left a log entry


def test_log_is_replayed_once_and_in_order(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "store"))
    for k in range(12):  # names that would sort otherwise
        tx = store.Transaction(s)
        tx.tx = str(k)
        tx.add_vertex(1, f"{k}")
        tx.add_edge(1, k + 2)
        s.write_log(tx.log())
    assert s.recover() == 1 and s.snapshot().vertex(1).first().props == "11"
    assert [r.dst for r in s.snapshot().edges.orderBy("eid").collect()] == list(range(2, 14))
    # a crash between publishing and dropping the entry
    tx = s.begin()
    tx.add_edge(50, 51)
    entry = s.write_log(tx.log())
    s.publish(store.fold(s.snapshot(), tx.log().where("op like 'add%'")), s.version(), [entry])
    assert s.recover() is None and s.snapshot().find_edges(src=50).count() == 1
    # a crash while an entry is written: it doesn't count
    half = s.write_log(tx.log())
    (tmp_path / "store" / "wal" / str(half) / "_SUCCESS").unlink()
    assert s.recover() is None
    # an abandoned pointer is passed over once it is old
    (tmp_path / "store" / "current" / "9").touch()
    with pytest.raises(store.Conflict):
        s.publish(s.snapshot(), s.version())
    import os

    os.utime(tmp_path / "store" / "current" / "9", (0, 0))
    assert s.publish(s.snapshot(), s.version()) == 10
    assert s.vacuum() >= 2 and s.snapshot().find_edges(src=50).count() == 1


def test_index_registry(spark, tmp_path):
    kinds = "id long, props map<string,struct<t:tinyint,i:bigint,d:double,s:string,b:boolean>>"
    v = spark.createDataFrame([(1, P.props({"port": "Oslo", "berths": 3})), (2, P.props({"port": "Riga", "berths": "3"})), (3, P.props({"port": "Oslo", "berths": 3.0, "x": None}))], kinds)
    own = IndexRegistry(spark, str(tmp_path / "indexes"))
    assert own.names() == [] and not own.has("port") and own.exact("port", "Oslo") is None
    own.create("by_port", "port", v)
    own.create("by_berths", "berths", v)
    with pytest.raises(ValueError):
        own.create("by_port", "port", v)
    found = lambda key, *values: sorted(r["id"] for r in own.among(key, list(values)).collect())
    assert found("port", "Oslo") == [1, 3] and found("berths", 3) == [1] and found("berths", "3", 3.0) == [2, 3] and found("port") == []
    g = IndexedGraph(PropertyGraph(v, spark.createDataFrame([], "src long, dst long, eid long, weight double")), own)
    g = g.put_vertices(spark.createDataFrame([(1, P.props({"port": "Riga"})), (4, P.props({"port": "Oslo"}))], kinds))
    g = g.delete_vertices(spark.createDataFrame([(3,)], "id long"))
    assert found("port", "Oslo") == [4] and found("port", "Riga") == [1, 2] and found("berths", 3) == []
    assert sorted(r["id"] for r in g.find("port", "Riga").collect()) == [1, 2] and g.find("x", None).count() == 0
    assert {(r["name"], r.n_values, r.n_entries) for r in own.stats().collect()} == {("by_port", 2, 3), ("by_berths", 1, 1)}
    for k in range(10):  # beyond MAX_LAYERS layers they are folded
        own.maintain(spark.createDataFrame([(9, P.props({"port": f"p{k}"}))], kinds))
    assert found("port", "p9") == [9] and found("port", "p8") == [] and len(own.definition("by_port")["folders"]) < 9
    own.rebuild(v, "port")
    assert found("port", "Oslo") == [1, 3] and own.names() == ["by_berths", "by_port"]
    own.create("one", "port", v, unique="evict")
    own.drop("by_port")
    assert found("port", "Oslo") == [3]
    own.maintain(spark.createDataFrame([(1, P.props({"port": "Oslo"}))], kinds))
    assert found("port", "Oslo") == [1]
    with pytest.raises(DuplicateValue):
        own.create("strict", "port", v, unique="error")
    with pytest.raises(KeyError):
        own.drop("by_port")


def test_results_are_kept_by_version(spark, tmp_path):
    own, runs = store.GraphStore(spark, str(tmp_path / "store")), []
    own.publish(PropertyGraph.from_edges(spark.createDataFrame([(4, 6)], "src long, dst long")))
    compute = lambda g, depth: runs.append(depth) or g.degrees()
    memo = Memo(own)
    for depth in (1, 1, 2):
        assert memo.get("degrees", compute, depth=depth).count() == 2
    assert runs == [1, 2] and memo.holds("degrees", depth=1) and not memo.holds("degrees", depth=3)
    with own.begin() as tx:
        tx.add_edge(6, 9)
        tx.commit()
    assert memo.get("degrees", compute, depth=1).count() == 3 and memo.get("degrees", compute, version=1, depth=1).count() == 2 and runs == [1, 2, 1]
    memo.forget(1)
    assert not memo.holds("degrees", 1, depth=1)
    assert report(spark, str(tmp_path / "store"))[0].startswith("vertices 3, edges 2")


def test_component_stream(spark, tmp_path):
    for k, rows in enumerate([[(1, 2), (3, 4)], [(2, 3), (None, 9)], [(7, 7)]]):
        spark.createDataFrame(rows, "src long, dst long").write.parquet(str(tmp_path / f"in/{k}"))
    stream = deltas.ComponentStream(spark, str(tmp_path / "state"))
    edges = spark.readStream.schema("src long, dst long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.start(edges, str(tmp_path / "cp"))
    q.awaitTermination()
    want = structure.connected_components(PropertyGraph.from_edges(spark.createDataFrame([(1, 2), (3, 4), (2, 3), (7, 7)], "src long, dst long")))
    assert sorted(map(tuple, stream.labels().select("id", "label").collect())) == sorted(map(tuple, want.select("id", "label").collect()))


def test_degree_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-09 00:00:00")], "src long, at string").select("src", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    rows = deltas.degree_stream(spark.readStream.schema("src long, at timestamp").parquet(str(tmp_path / "in")), "at")
    q = rows.writeStream.format("memory").queryName("degrees").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.src, r.out_degree) for r in spark.table("degrees").collect()] == [(1, 2)]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
