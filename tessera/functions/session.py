"""A call-by-call API over a stored or new graph, for scripts: plain Python values in and out.

Changes are staged and folded into the graph (one log, one pass) when something is read next.  Results that could be as
large as the graph are for small graphs; the DataFrame operators behind them take any size.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import communities, ranking, structure, traverse
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import cut
from tessera.sources import store


class GraphSession:
    def __init__(self, spark: SparkSession, path: str | None = None, recover: bool = True):
        """An empty graph, or the newest version of the store at path (empty if there is none); its log is replayed if recover."""
        self.spark, self.store, self._staged = spark, None if path is None else store.GraphStore(spark, path), []
        self._changes, self._saved, self._kept = 0, 0, {}
        if self.store is not None:
            if recover:
                self.store.recover()
            self._graph = self.store.snapshot()
        else:
            self._graph = PropertyGraph(spark.createDataFrame([], "id long, props string"), spark.createDataFrame([], "src long, dst long, eid long, weight double, props string"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphSession:
        return cls(spark, path)

    @classmethod
    def open_read_only(cls, spark: SparkSession, path: str) -> GraphSession:
        """The newest version as it is: the log is left alone, and changes can't be saved to the path."""
        own = cls(spark, path, recover=False)
        own.store = None
        return own

    @property
    def unsaved(self) -> bool:
        """Whether anything was changed since the graph was opened or saved."""
        return self._changes != self._saved

    def _stage(self, op: str, **values) -> None:
        row = {"op": op, "id": None, "src": None, "dst": None, "weight": None, "props": None, "tx": "0", "seq": len(self._staged), "at": 0} | values
        self._staged.append(tuple(row.values()))
        self._changes += 1

    @property
    def graph(self) -> PropertyGraph:
        if self._staged:
            log = self.spark.createDataFrame(self._staged, store.DELTA)
            new = store.fold(self._graph, log)
            self._graph, self._staged = PropertyGraph(cut(new.vertices), cut(new.edges)), []
        return self._graph

    # ---- elements

    def vertex_count(self) -> int:
        return self.graph.vertices.count()

    def edge_count(self) -> int:
        return self.graph.edges.count()

    def add_vertex(self, id: int, props: dict | None = None) -> int:
        self._stage("add_vertex", id=id, props=json.dumps(props or {}))
        return id

    def get_vertex(self, id: int) -> dict | None:
        row = self.graph.vertex(id).head()
        return None if row is None else json.loads(row["props"] or "{}")

    def delete_vertex(self, id: int) -> dict | None:
        """The old properties; None (and no change) if there is no such vertex."""
        old = self.get_vertex(id)
        if old is not None:
            self._stage("delete_vertex", id=id)
        return old

    def add_edge(self, from_id: int, to_id: int, weight: float = 1.0, props: dict | None = None) -> None:
        self._stage("add_edge", src=from_id, dst=to_id, weight=float(weight), props=json.dumps(props or {}))

    def batch_add_edges(self, edges: list[tuple[int, int, float]]) -> int:
        for a, b, w in edges:
            self.add_edge(a, b, w)
        return len(edges)

    def get_edges(self, from_id: int, to_id: int) -> list[tuple[float, dict]]:
        return [(r["weight"], json.loads(r["props"] or "{}")) for r in self.graph.edges_between(from_id, to_id).collect()]

    def get_edge(self, from_id: int, to_id: int) -> tuple[float, dict] | None:
        found = self.get_edges(from_id, to_id)
        return found[-1] if found else None

    def remove_edge(self, from_id: int, to_id: int) -> bool:
        """Whether there was such an edge; all parallel edges go."""
        there = bool(self.graph.find_edges(src=from_id, dst=to_id).take(1))
        if there:
            self._stage("delete_edge", src=from_id, dst=to_id)
        return there

    # ---- neighbours

    def _ends(self, id: int, out: bool) -> list:
        own = self.graph.find_edges(src=id) if out else self.graph.find_edges(dst=id)
        return own.orderBy("eid").collect()

    def out_neighbors(self, id: int) -> list[int]:
        return [r["dst"] for r in self._ends(id, True)]

    def in_neighbors(self, id: int) -> list[int]:
        return [r["src"] for r in self._ends(id, False)]

    def out_edges(self, id: int) -> list[tuple[int, float, dict]]:
        return [(r["dst"], r["weight"], json.loads(r["props"] or "{}")) for r in self._ends(id, True)]

    def in_edges(self, id: int) -> list[tuple[int, float, dict]]:
        return [(r["src"], r["weight"], json.loads(r["props"] or "{}")) for r in self._ends(id, False)]

    def out_edges_cols(self, id: int, key: str = "relation", distinct: bool = False) -> tuple[list[int], list[str]]:
        """Targets and one text property of each edge ("" where it is missing); distinct keeps each pair once, in first order."""
        own = self.graph.find_edges(src=id).select("dst", "eid", F.coalesce(F.get_json_object("props", f"$['{key}']"), F.lit("")).alias("value"))
        if distinct:
            own = own.groupBy("dst", "value").agg(F.min("eid").alias("eid"))
        rows = own.orderBy("eid").collect()
        return [r["dst"] for r in rows], [r["value"] for r in rows]

    # ---- algorithms

    def _ids(self, *ids: int) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id long")

    @staticmethod
    def _map(df: DataFrame, value: str) -> dict:
        return {r["id"]: r[value] for r in df.collect()}

    def _memo(self, name: str, compute, *options) -> DataFrame:
        """compute(), stored once for this state of the graph and these options; any change drops all such results."""
        g = self.graph
        if self._kept.get("at") != self._changes:
            self._kept = {"at": self._changes}
        if (name, options) not in self._kept:
            self._kept[name, options] = cut(compute(g))
        return self._kept[name, options]

    def pagerank(self, iterations: int = 100, damping: float = 0.85) -> dict[int, float]:
        return self._map(self._memo("pagerank", lambda g: ranking.pagerank(g, iterations, damping), iterations, damping), "score")

    def wave_core(self) -> dict[int, int]:
        return self._map(self._memo("cores", structure.cores), "core")

    def tarjan_scc(self) -> list[list[int]]:
        rows = self._memo("scc", structure.strongly_connected_components).orderBy("label", "id").collect()
        return [[r["id"] for r in own] for _, own in itertools.groupby(rows, key=lambda r: r["label"])]

    def betweenness(self, num_sources: int | None = 256) -> dict[int, float]:
        return self._map(self._memo("betweenness", lambda g: structure.betweenness(g, num_sources or 256), num_sources or 256), "score")

    def louvain(self, resolution: float = 1.0) -> dict[int, int]:
        return self._map(self._memo("louvain", lambda g: communities.louvain(g, resolution)[0], resolution), "label")

    def bfs(self, source: int, max_depth: int | None = None) -> dict[int, int]:
        return self._map(self._memo("bfs", lambda g: traverse.bfs(g, self._ids(source), max_depth), source, max_depth), "dist")

    def walk(self, start: int, max_depth: int) -> list[int]:
        return [r["id"] for r in traverse.bfs(self.graph, self._ids(start), max_depth).orderBy("dist", "id").collect()]

    def subgraph(self, seeds: list[int], max_depth: int) -> tuple[list[int], list[tuple[int, int, float]]]:
        own = traverse.subgraph(self.graph, self._ids(*seeds), max_depth)
        return sorted(r["id"] for r in own.vertices.select("id").collect()), [(r["src"], r["dst"], r["weight"]) for r in own.edges.orderBy("eid").collect()]

    def find_paths(self, path_length: int, max_results: int | None = 100) -> list[list[int]]:
        rows = traverse.paths(self.graph, path_length).orderBy("path")
        return [r["path"] for r in (rows if max_results is None else rows.limit(max_results)).collect()]

    def shortest_path(self, start: int, end: int) -> list[int]:
        return traverse.shortest_path(self.graph, start, end)

    # ---- storage

    def save(self) -> int:
        """Publish a version; its number."""
        if self.store is None:
            raise RuntimeError("this graph has no path; use save_to")
        out = self.store.publish(self.graph)
        self._saved = self._changes
        return out

    def save_to(self, path: str) -> int:
        return store.GraphStore(self.spark, path).publish(self.graph)

    def close(self) -> None:
        self._staged, self.store = [], None

    def __repr__(self) -> str:
        return f"GraphSession({self.vertex_count()} vertices, {self.edge_count()} edges)"
