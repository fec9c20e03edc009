"""An HTTP view of a graph session: JSON in and out, one route a row of a table.  python -m tessera.plans.service [path] [port]"""

from __future__ import annotations

import json
import re
import sys
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tessera.functions.session import GraphSession
from tessera.operators import ranking, traverse


class Refused(Exception):
    """A request that gets a status of its own."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


class GraphService:
    def __init__(self, session: GraphSession):
        self.session, self.lock, self.stop = session, threading.RLock(), threading.Event()
        num = r"(\d+)"
        self.routes: list[tuple[str, re.Pattern, Callable[..., tuple[int, dict]]]] = [
            (verb, re.compile(path), do)
            for verb, path, do in (
                ("GET", "/health", lambda b: (200, {"status": "ok", "name": "tessera"})),
                ("GET", "/stats", self._stats),
                ("POST", "/vertices", self._add_vertex),
                ("GET", f"/vertices/{num}", self._get_vertex),
                ("DELETE", f"/vertices/{num}", self._delete_vertex),
                ("POST", "/edges", self._add_edge),
                ("DELETE", f"/edges/{num}/{num}", self._delete_edge),
                ("GET", f"/neighbors/{num}", lambda b, v: (200, {"vertex": v, "neighbors": self.session.out_neighbors(v)})),
                ("GET", f"/neighbors/{num}/in", lambda b, v: (200, {"vertex": v, "neighbors": self.session.in_neighbors(v)})),
                ("POST", "/algorithms/pagerank", self._pagerank),
                ("POST", "/algorithms/bfs", self._bfs),
                ("POST", "/traverse/walk", self._walk),
                ("POST", "/traverse/subgraph", self._subgraph),
                ("POST", "/traverse/find_paths", self._paths),
                ("POST", "/admin/save", lambda b: (200, {"status": "saved", "version": self.session.save()})),
                ("POST", "/admin/shutdown", self._shutdown),
            )
        ]

    def handle(self, verb: str, path: str, body: bytes = b"") -> tuple[int, dict]:
        """Status and answer.  One request at a time sees the session, so each reads what those before it wrote."""
        if verb == "OPTIONS":
            return 200, {}
        for own, pattern, do in self.routes:
            m = pattern.fullmatch(path)
            if own == verb and m:
                try:
                    asked = json.loads(body) if body else {}
                    if not isinstance(asked, dict):
                        raise ValueError("an object is expected")
                    with self.lock:
                        return do(asked, *map(int, m.groups()))
                except Refused as e:
                    return e.status, {"error": str(e)}
                except (ValueError, TypeError, RuntimeError) as e:
                    return 400, {"error": str(e)}
        return 404, {"error": "not found"}

    @staticmethod
    def _need(asked: dict, key: str) -> int:
        if not isinstance(asked.get(key), int) or isinstance(asked.get(key), bool) or asked[key] < 0:
            raise Refused(400, f"missing '{key}'")
        return asked[key]

    def _stats(self, _) -> tuple[int, dict]:
        return 200, {"vertex_count": self.session.vertex_count(), "edge_count": self.session.edge_count(), "mode": "in_memory" if self.session.store is None else "stored"}

    def _add_vertex(self, asked) -> tuple[int, dict]:
        return 201, {"id": self.session.add_vertex(self._need(asked, "id"), asked.get("properties") or {}), "status": "created"}

    def _get_vertex(self, _, v: int) -> tuple[int, dict]:
        found = self.session.get_vertex(v)
        if found is None:
            raise Refused(404, f"vertex {v} not found")
        return 200, {"id": v, "properties": found}

    def _delete_vertex(self, _, v: int) -> tuple[int, dict]:
        if self.session.delete_vertex(v) is None:
            raise Refused(404, f"vertex {v} not found")
        return 200, {"id": v, "status": "deleted"}

    def _add_edge(self, asked) -> tuple[int, dict]:
        a, b = self._need(asked, "from"), self._need(asked, "to")
        self.session.add_edge(a, b, float(asked.get("weight", 1.0)), asked.get("properties") or {})
        return 201, {"from": a, "to": b, "status": "created"}

    def _delete_edge(self, _, a: int, b: int) -> tuple[int, dict]:
        if not self.session.remove_edge(a, b):
            raise Refused(404, f"edge {a}->{b} not found")
        return 200, {"from": a, "to": b, "status": "deleted"}

    def _pagerank(self, asked) -> tuple[int, dict]:
        scores = ranking.pagerank(self.session.graph, int(asked.get("iterations", 100)), float(asked.get("damping", 0.85))).persist()
        best = ranking.top(scores, 20, asked.get("by", "score")).collect()
        total = scores.agg({"score": "sum"}).first()[0]
        scores.unpersist()
        return 200, {"top20": [{"id": r["id"], "score": r["score"]} for r in best], "sum": total}

    def _bfs(self, asked) -> tuple[int, dict]:
        found = self.session.bfs(self._need(asked, "source"), asked.get("max_depth"))
        return 200, {"source": asked["source"], "reached": len(found), "distances": {str(k): v for k, v in sorted(found.items())}}

    def _walk(self, asked) -> tuple[int, dict]:
        start, depth = int(asked.get("start", 0)), int(asked.get("max_depth", 3))
        seen, crossed = traverse.walk(self.session.graph, self.session._ids(start), depth)
        edges = [{"from": r["src"], "depth": r["depth"], "to": r["dst"]} for r in crossed.orderBy("depth", "src", "eid").collect()]
        return 200, {"start": start, "max_depth": depth, "visited": [r["id"] for r in seen.orderBy("dist", "id").collect()], "edges_traversed": edges}

    def _subgraph(self, asked) -> tuple[int, dict]:
        seeds, depth = [int(x) for x in asked.get("seeds", [])], int(asked.get("max_depth", 2))
        v, e = self.session.subgraph(seeds, depth)
        return 200, {"seeds": seeds, "max_depth": depth, "vertex_count": len(v), "vertices": v, "edge_count": len(e), "edges": [{"from": a, "to": b, "weight": w} for a, b, w in e]}

    def _paths(self, asked) -> tuple[int, dict]:
        length, most = int(asked.get("path_length", 2)), int(asked.get("max_results", 100))
        rows, n = traverse.limited(traverse.paths(self.session.graph, length), most, ["path"])
        found = [r["path"] for r in rows.collect()]
        return 200, {"path_length": length, "total_found": n, "returned": len(found), "paths": found}

    def _shutdown(self, _) -> tuple[int, dict]:
        self.stop.set()
        return 200, {"status": "shutting down"}

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """A server on 127.0.0.1, already listening in the background; stops after /admin/shutdown."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = service.handle(self.command, self.path, body)
                data = json.dumps(out).encode()
                self.send_response(status)
                for k, v in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(data)))):
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(data)
                if service.stop.is_set():
                    threading.Thread(target=self.server.shutdown, daemon=True).start()

            do_GET = do_POST = do_DELETE = do_OPTIONS = _answer

            def log_message(self, *_) -> None:
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    own = GraphService(GraphSession(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else None))
    print("listening on port", own.serve(int(sys.argv[2]) if len(sys.argv) > 2 else 8080).server_port)
    own.stop.wait()
