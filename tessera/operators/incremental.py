"""Delta versions: a previous result, the graph with the new edges, and the new edges (src, dst) alone.

Insert-only.  Each starts from what the new edges touch and lets only what changes travel on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranking, structure, traverse
from tessera.operators.arcs import Arcs, relax
from tessera.operators.components import component_labels
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Rounds, Stored, cut


def pagerank(g: PropertyGraph, scores: DataFrame, new: DataFrame, damping: float = 0.85, eps: float = 1e-6, rounds: int = 50) -> DataFrame:
    """(id, score): only the affected vertices are pulled anew, and the out-neighbours of those that moved by more than
    eps are the next to be pulled.

    A change of the dangling mass shifts all scores alike, so the others get that shift without being pulled.  The
    result is scaled to sum 1 at the end."""
    pairs = Stored(g.pairs())
    degree = pairs.df.groupBy("src").agg(F.sum("n").alias("deg"))
    added = new.groupBy("src").agg(F.count("*").alias("added"))
    flows = Stored(pairs.df.join(degree, "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("share")))
    out = Arcs(flows.df.select("src", "dst"))
    into = Arcs(flows.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share"))
    n = max(1, g.vertices.count())
    first = g.vertices.select("id").join(scores, "id", "left").join(degree.join(added, "src", "left").withColumnRenamed("src", "id"), "id", "left")
    first = first.select("id", F.coalesce("score", F.lit(1.0 / n)).alias("score"), F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("added", F.lit(0)).alias("added"))
    sinks, total = F.sum(F.when(F.col("deg") == 0, F.col("score")).otherwise(0.0)).alias("sinks"), F.sum("score").alias("total")
    hot = F.count(F.when(F.col("moved") > eps, 1)).alias("hot")
    loop = Rounds(out.by)
    state, seen = loop.observed(first, sinks, total, F.sum(F.when(F.col("deg") == F.col("added"), F.col("score")).otherwise(0.0)).alias("old"), F.count(F.when(F.col("added") > 0, 1)).alias("hot"))
    lost_before = seen.get("old") or 0.0
    touched = out.send(out.hashed(new.select(F.col("src").alias("id")).distinct())).select(F.col("dst").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
    for _ in range(rounds):
        lost = seen.get("sinks") or 0.0
        if not seen.get("hot", 0) and abs(lost - lost_before) * damping / n <= eps:
            break
        sums = into.send(into.hashed(touched)).join(into.hashed(state.select(F.col("id").alias("dst"), "score")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        pulled = touched.join(into.hashed(sums), "id", "left").select("id", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("s", F.lit(0.0))).alias("new"))
        now = F.coalesce("new", F.col("score") + F.lit(damping * (lost - lost_before) / n))
        rows = state.join(into.hashed(pulled), "id", "left").select("id", now.alias("score"), "deg", F.abs(now - F.col("score")).alias("moved"))
        lost_before = lost
        state, seen = loop.observed(rows, sinks, total, hot)
        touched = out.send(out.hashed(state.where(F.col("moved") > eps).select("id"))).select(F.col("dst").alias("id")).distinct()
    for t in (pairs, flows, out, into):
        t.drop()
    return state.select("id", (F.col("score") / F.lit(seen.get("total") or 1.0)).alias("score"))


def sssp(g: PropertyGraph, previous: DataFrame, new: DataFrame, weight: str = "weight", directed: bool = True) -> DataFrame:
    """(id, dist, parent) after the new edges: relaxing starts at their sources and goes on from what improves."""
    ends = new.select(F.col("src").alias("id"))
    if not directed:
        ends = ends.unionByName(new.select(F.col("dst").alias("id")))
    return traverse.sssp(g, ends, weight=weight, directed=directed, start=previous)


def bfs(g: PropertyGraph, previous: DataFrame, new: DataFrame, directed: bool = True) -> DataFrame:
    """(id, dist, parent) in hops after the new edges: levels go on from the new edges' sources, as far as they shorten."""
    ends = new.select(F.col("src").alias("id"))
    if not directed:
        ends = ends.unionByName(new.select(F.col("dst").alias("id")))
    start = cut(previous.select("id", F.col("dist").cast("long").alias("value"), "parent"))
    arcs = Arcs(g.pairs().select("src", "dst") if directed else g.mirrored())
    found = relax(arcs, start, lambda v: v + 1, start.join(ends.distinct(), "id", "left_semi"))
    arcs.drop()
    return found.withColumnRenamed("value", "dist")


def updates(previous: DataFrame, now: DataFrame, value: str) -> int:
    """Rows whose value is new or differs."""
    return now.join(previous.select("id", F.col(value).alias("_was")), "id", "left").where(f"not ({value} <=> _was)").count()


def connected_components(labels: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """(labels after the new edges, merges): components of the small graph of labels; endpoints that had no label get their own."""
    ends = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
    known = cut(labels.select("id", "label").unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))))
    of = lambda end, to: known.select(F.col("id").alias(end), F.col("label").alias(to))
    small = new.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b").where("a <> b").distinct()
    merged = component_labels(small, cut)
    out = known.join(merged.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return out, merged.where("id <> label").count()


def triangles(g: PropertyGraph, new: DataFrame) -> DataFrame:
    """(a, b, c): triangles of g (new edges included) that touch a new edge; each once."""
    pairs = cut(g.undirected())
    fresh = new.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().join(pairs, ["a", "b"], "left_semi")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    third = fresh.join(both.select("a", F.col("b").alias("c")), "a").join(both.select("b", F.col("a").alias("c")), ["b", "c"])
    t = F.array_sort(F.array("a", "b", "c"))
    return third.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c")).distinct()


def triangles_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, ["a", "b", "c"], "left_anti")


def clustering(g: PropertyGraph, previous: DataFrame, new: DataFrame) -> DataFrame:
    """structure.clustering after the new edges: their endpoints and common neighbours are counted anew."""
    ends = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
    touched = cut(ends.unionByName(triangles(g, new).select(F.explode(F.array("a", "b", "c")).alias("id"))).distinct())
    now = structure.clustering(g, touched)
    return previous.join(touched, "id", "left_anti").unionByName(now)


def katz(g: PropertyGraph, scores: DataFrame, **options) -> DataFrame:
    """Katz centrality from the previous scores."""
    return ranking.katz(g, start=scores, **options)


def eigenvector(g: PropertyGraph, scores: DataFrame, **options) -> DataFrame:
    return ranking.eigenvector(g, start=scores, **options)


def k_core(g: PropertyGraph, previous: DataFrame, added: int | None = None) -> tuple[DataFrame, int]:
    """(core numbers of g, how many differ from the previous).

    added: how many edges were added since `previous`; any number may have been removed.  An edge raises a core number by one
    at most, so the fixpoint begins at the previous values plus that, and after removals alone only what falls is looked at.
    None: unknown, it begins at the degrees."""
    start = None if added is None else previous.select("id", (F.col("core") + added).alias("core"))
    if start is not None and added:
        start = start.unionByName(g.vertices.select("id").join(previous, "id", "left_anti").select("id", F.lit((1 << 31) - 1).cast("long").alias("core")))
    now = cut(structure.k_core(g, start))
    return now, updates(previous, now, "core")


def core_members(previous: DataFrame, now: DataFrame, k: int) -> DataFrame:
    """(id, change): the vertices that joined (1) or left (-1) the k-core."""
    both = now.join(previous.select("id", F.col("core").alias("was")), "id", "full")
    in_now, in_before = F.coalesce(F.col("core") >= k, F.lit(False)).cast("int"), F.coalesce(F.col("was") >= k, F.lit(False)).cast("int")
    return both.select("id", (in_now - in_before).alias("change")).where("change <> 0")
