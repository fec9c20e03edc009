"""Traversals: breadth-first levels, walks, subgraphs, paths and shortest paths, each a loop of frontier joins.

A frontier is joined with the edges and what was visited before is taken out again; only the frontier moves in each
round.  Sources are DataFrames (id), so many can start at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.arcs import Arcs, relax
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Grown, Stored, cut


def _pairs(g: PropertyGraph, directed: bool) -> Arcs:
    return Arcs(g.pairs().select("src", "dst") if directed else g.mirrored())


def bfs(g: PropertyGraph, sources: DataFrame, max_depth: int | None = None, directed: bool = True) -> DataFrame:
    """(id, dist, parent): hops from the nearest source; parent is the smallest predecessor on a shortest path.

    Unreachable vertices and sources that are no vertices are absent.  A round writes the new level only."""
    arcs = _pairs(g, directed)
    start = sources.select("id").distinct().join(g.vertices.select("id"), "id", "left_semi")
    found = relax(arcs, start.select("id", F.lit(0).cast("long").alias("value"), F.lit(None).cast("long").alias("parent")), lambda v: v + 1, max_rounds=max_depth)
    arcs.drop()
    return found.withColumnRenamed("value", "dist")


def walk(g: PropertyGraph, start: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The visited vertices (id, dist, parent) and every traversed edge (src, depth, dst, eid), also to visited vertices."""
    seen = bfs(g, start, max_depth)
    inner = seen.where(F.col("dist") < max_depth).select(F.col("id").alias("src"), F.col("dist").alias("depth"))
    return seen, g.edges.join(inner, "src").select("src", "depth", "dst", "eid")


def subgraph(g: PropertyGraph, seeds: DataFrame, max_depth: int) -> PropertyGraph:
    """Vertices within max_depth hops of the seeds, and every out-edge of those nearer than max_depth."""
    seen = bfs(g, seeds, max_depth)
    inner = seen.where(F.col("dist") < max_depth).select("id")
    return PropertyGraph(g.vertices.join(seen.select("id"), "id", "left_semi"), g.out_edges(inner))


def counted_paths(g: PropertyGraph, length: int, vertex: Column | None = None, edge: Column | None = None) -> DataFrame:
    """(path array, n): each different walk of exactly `length` edges once, and how many choices of parallel edges make it.

    The vertex condition holds for all but the last vertex, the edge condition for at least one of the parallel edges; parallel edges that are there at all
    multiply a walk.  A path of pairs is found once only, so nothing is grouped."""
    hops = g.pairs()
    if edge is not None:
        hops = hops.join(g.edges.where(edge).select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    if vertex is not None:
        hops = hops.join(g.vertices.where(vertex).select(F.col("id").alias("src")), "src", "left_semi")
    hops = hops.withColumnRenamed("n", "_n")
    rows = g.vertices if vertex is None else g.vertices.where(vertex)
    rows = rows.select(F.col("id").alias("last"), F.array("id").alias("path"), F.lit(1).cast("long").alias("n"))
    for _ in range(length):
        rows = rows.join(hops, F.col("last") == F.col("src")).select(F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"), (F.col("n") * F.col("_n")).alias("n"))
    return rows.select("path", "n")


def paths(g: PropertyGraph, length: int, vertex: Column | None = None, edge: Column | None = None) -> DataFrame:
    """(path array): all walks of counted_paths, each as often as it counts."""
    return counted_paths(g, length, vertex, edge).select("path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("path")


def limited(rows: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, int]:
    """The first n rows and how many there are."""
    return rows.orderBy(*order).limit(n), rows.count()


def simple_paths(g: PropertyGraph, start: int, end: int, max_depth: int = 5) -> DataFrame:
    """(path): undirected paths without repeats of at most max_depth edges; none if start is end."""
    arcs = _pairs(g, False)
    done = Grown()
    rows = Stored(g.vertex(start).where(F.col("id") != end).select(F.array("id").alias("path"))).df
    done.add(rows.limit(0))
    for _ in range(max_depth):
        longer = arcs.send(rows.select(F.element_at("path", -1).alias("id"), "path")).where(~F.array_contains("path", F.col("dst")))
        rows = Stored(longer.select(F.array_append("path", F.col("dst")).alias("path"))).df
        done.add(rows.where(F.element_at("path", -1) == end))
        rows = rows.where(F.element_at("path", -1) != end)
    arcs.drop()
    return done.df


def shortest_path(g: PropertyGraph, start: int, end: int, directed: bool = True) -> list[int]:
    """Vertices of a path of fewest edges (smallest predecessors); [start] if start is end, [] if there is none."""
    return _unwound(bfs(g, g.vertex(start).select("id"), directed=directed), end)


def _unwound(tree: DataFrame, end: int) -> list[int]:
    out: list[int] = []
    at: int | None = end
    while at is not None:
        row = tree.where(F.col("id") == at).select("parent").head()
        if row is None:
            return []
        out.append(at)
        at = row[0]
    return out[::-1]


def sssp(g: PropertyGraph, sources: DataFrame, weight: str = "weight", directed: bool = True, start: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, dist, parent): least weight sums, by relaxing the edges of what improved in the round before.

    Weights must not be negative.  start: a previous result (id, dist, parent) to go on from; then sources are the
    vertices whose edges are tested first.  max_rounds: paths of that many edges at most."""
    own = g.edges.select("src", "dst", F.col(weight).cast("double").alias("w"))
    if not directed:
        own = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    arcs = Arcs(own.groupBy("src", "dst").agg(F.min("w").alias("w")))
    moved = None
    if start is None:
        best = sources.select("id").distinct().join(g.vertices.select("id"), "id", "left_semi").select("id", F.lit(0.0).alias("value"), F.lit(None).cast("long").alias("parent"))
    else:
        best = cut(start.select("id", F.col("dist").cast("double").alias("value"), "parent"))
        moved = best.join(sources.select("id").distinct(), "id", "left_semi")
    found = relax(arcs, best, lambda v: v + F.col("w"), moved, max_rounds)
    arcs.drop()
    return found.withColumnRenamed("value", "dist")


def shortest_path_weighted(g: PropertyGraph, start: int, end: int, directed: bool = True) -> tuple[list[int], float]:
    """(path, total); ([], infinity) if there is none."""
    tree = sssp(g, g.vertex(start).select("id"), directed=directed)
    row = tree.where(F.col("id") == end).head()
    return (_unwound(tree, end), row["dist"]) if row else ([], float("inf"))


def expand(g: PropertyGraph, seed: DataFrame, depth: int, limit: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """For display: the `limit` nearest vertices (ties: smallest id; None: all) within depth, and the edges among them."""
    seen = bfs(g, seed, depth)
    if limit is not None:
        seen = seen.orderBy("dist", "id").limit(limit)
    return seen, g.induced(seen).edges
