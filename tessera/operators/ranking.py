"""Iterated scores: PageRank and its variants, Katz and eigenvector centrality.

The edges are aggregated to pairs, joined with their source's degree and stored once, bucketed by source where they are many; so
are the scores, by id.  A round then shuffles nothing but the partial sums by target.  Sums that the next round or the
convergence test needs are gathered by the job that writes the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.arcs import Arcs
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Rounds, Stored


def _arcs(g: PropertyGraph, view: str) -> DataFrame:
    """(src, dst, n) of a view: multigraph, simple (each ordered pair once) or undirected (both directions, no loops)."""
    if view == "multigraph":
        return g.pairs()
    if view == "simple":
        return g.pairs().select("src", "dst", F.lit(1).cast("long").alias("n"))
    if view == "undirected":
        return g.mirrored().select("src", "dst", F.lit(1).cast("long").alias("n"))
    raise ValueError(view)


def pagerank(g: PropertyGraph, iterations: int = 100, damping: float = 0.85, tol: float | None = None, view: str = "multigraph", dangling: str = "spread", start: DataFrame | None = None, normalise: bool = False) -> DataFrame:
    """(id, score).  new = (1 - d) / V + d * sum of score / out-degree over in-edges + d * (dangling mass) / V.

    dangling="ignore" drops the mass of vertices without out-edges.  tol: stop once no score moves more.
    start: scores (id, score) to begin with instead of 1 / V; vertices that it lacks begin with 1 / V."""
    own = Stored(_arcs(g, view))
    degree = own.df.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("deg"))
    first = g.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    if start is None:
        first = first.withColumn("score", F.lit(None).cast("double"))
    else:
        first = first.join(start.select("id", "score"), "id", "left")
    flows = Arcs(own.df.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("share")))
    rounds = Rounds(flows.by)
    known, blank = F.sum(F.when(F.col("deg") == 0, F.col("score"))).alias("sinks"), F.count(F.when((F.col("deg") == 0) & F.col("score").isNull(), 1)).alias("blank")
    state, seen = rounds.observed(first, F.count("*").alias("n"), known, blank)
    own.drop()
    n = seen.get("n", 0)
    if not n:
        return state.select("id", F.lit(0.0).alias("score"))
    lost, score = (seen["sinks"] or 0.0) + seen["blank"] / n, F.coalesce("score", F.lit(1.0 / n))
    sinks = F.sum(F.when(F.col("deg") == 0, F.col("score")).otherwise(0.0)).alias("sinks")
    total = F.sum("score").alias("total")
    if not iterations:
        state, seen = rounds.observed(state.select("id", "deg", score.alias("score")), sinks, total)
    for _ in range(iterations):
        base = (1 - damping) / n + (damping * lost / n if dangling == "spread" else 0.0)
        sums = flows.send(flows.hashed(state.where("deg > 0").select("id", score.alias("score")))).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        new = F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
        moved = state.join(flows.hashed(sums), "id", "left").select("id", "deg", new.alias("score"), F.abs(new - score).alias("moved"))
        state, seen = rounds.observed(moved, sinks, total, F.max("moved").alias("most"))
        state, score, lost = state.drop("moved"), F.col("score"), seen["sinks"] or 0.0
        if tol is not None and seen["most"] <= tol:
            break
    flows.drop()
    score = F.col("score") / F.lit(seen["total"]) if normalise else F.col("score")
    return state.select("id", score.alias("score"))


def katz(g: PropertyGraph, alpha: float = 0.1, beta: float = 1.0, iterations: int = 100, tol: float | None = 1e-6, start: DataFrame | None = None) -> DataFrame:
    """(id, score): x = alpha * sum over undirected neighbours + beta, from 1 (or from start)."""
    return _power(g, lambda s: F.lit(alpha) * s + F.lit(beta), iterations, tol, False, start, False)


def eigenvector(g: PropertyGraph, iterations: int = 100, tol: float | None = 1e-6, weighted: bool = False, start: DataFrame | None = None) -> DataFrame:
    """(id, score): sums over undirected neighbours (times the summed weights if weighted), scaled to length 1 each round."""
    return _power(g, lambda s: s, iterations, tol, True, start, weighted)


def _power(g: PropertyGraph, f, iterations: int, tol: float | None, scaled: bool, start: DataFrame | None, weighted: bool) -> DataFrame:
    if weighted:
        one = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
        arcs = one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    else:
        arcs = g.mirrored().withColumn("w", F.lit(1.0))
    arcs = Arcs(arcs)
    state = g.vertices.select("id", F.lit(1.0).alias("score"))
    if start is not None:
        state = g.vertices.select("id").join(start, "id", "left").select("id", F.coalesce("score", F.lit(1.0)).alias("score"))
    rounds = Rounds(arcs.by)
    state, norm = rounds.cut(state), 1.0
    for _ in range(iterations):
        now = F.col("score") / F.lit(norm)
        sums = arcs.send(arcs.hashed(state.select("id", now.alias("score")))).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("s"))
        rows = state.join(arcs.hashed(sums), "id", "left").select("id", f(F.coalesce("s", F.lit(0.0))).alias("score"), now.alias("was"))
        state, seen = rounds.observed(rows, F.sum(F.col("score") * F.col("score")).alias("square"), F.max(F.abs(F.col("score") - F.col("was"))).alias("most"))
        norm = (seen["square"] ** 0.5 or 1.0) if scaled and seen["square"] else 1.0
        if tol is not None:
            most = seen["most"] if not scaled else state.agg(F.max(F.abs(F.col("score") / F.lit(norm) - F.col("was")))).first()[0]
            if most is None or most <= tol:
                state = state.drop("was")
                break
        state = state.drop("was")
    arcs.drop()
    return state.select("id", (F.col("score") / F.lit(norm)).alias("score"))


def top(scores: DataFrame, k: int = 20, by: str = "score") -> DataFrame:
    """The k best by score (ties: smaller id), or the first k by id."""
    return scores.orderBy(F.desc("score"), "id").limit(k) if by == "score" else scores.orderBy("id").limit(k)
