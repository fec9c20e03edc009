"""Communities: modularity, Louvain, greedy merging, greedy moves and label propagation.

All moves of a round are made at once (so they distribute); ties go to the smaller label.  Louvain moves a vertex only in
sweeps that `draw` picks it for, which keeps neighbours from swapping for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.arcs import Arcs, draw
from tessera.operators.structure import connected_components
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Rounds, Stored, numbered


def renumbered(labels: DataFrame) -> DataFrame:
    """(id, label) with labels 0, 1, ... in the order of each community's smallest member."""
    number = numbered(labels.groupBy("label").agg(F.min("id").alias("m")), "m", "community")
    return labels.join(number.select("label", "community"), "label").select("id", F.col("community").alias("label"))


def members(labels: DataFrame) -> DataFrame:
    """(label, n, least): size and smallest member of each community."""
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def member_rows(labels: DataFrame) -> DataFrame:
    """(label, place, id): every community's members in order of their ids, a row each, so that no community is held as a list."""
    return labels.select("label", F.row_number().over(W.partitionBy("label").orderBy("id")).alias("place"), "id")


def community_of(labels: DataFrame, v: int) -> DataFrame:
    """(id) of the members of v's community."""
    return labels.join(labels.where(F.col("id") == v).select("label"), "label", "left_semi").select("id")


def modularity(g: PropertyGraph, labels: DataFrame, form: str = "standard", resolution: float = 1.0) -> DataFrame:
    """One row, q.  standard: sum over communities of (share of edges inside) - resolution * (share of edge ends)^2, on undirected counts.

    edges: sum over ordered out-neighbour pairs of ([same community] - k_i k_j / 2m) / 2m with out-degrees k and m twice
    the number of simple edges, a form that grows with every edge inside a community."""
    of = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
    if form == "edges":
        arcs = g.pairs().select("src", "dst").distinct()
        k = arcs.groupBy("src").agg(F.count("*").alias("k"))
        m = F.lit(2.0 * max(1, arcs.count()))
        rows = arcs.join(k, "src").join(k.select(F.col("src").alias("dst"), F.col("k").alias("kj")), "dst", "left").join(of("src"), "src").join(of("dst"), "dst")
        same = (F.col("l_src") == F.col("l_dst")).cast("double")
        return rows.agg(F.coalesce(F.sum((same - F.col("k") * F.coalesce("kj", F.lit(0)) / (2 * m)) / (2 * m)), F.lit(0.0)).alias("q"))
    arcs = _weights(g)
    rows = arcs.join(of("src"), "src").join(of("dst"), "dst")
    ends = rows.groupBy("l_src").agg(F.sum("w").alias("ends"), F.sum(F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = ends.agg(F.sum("ends")).first()[0] or 1.0
    return ends.agg(F.coalesce(F.sum(F.col("inside") / total - resolution * (F.col("ends") / total) ** 2), F.lit(0.0)).alias("q"))


def _weights(g: PropertyGraph, column: str | None = None) -> DataFrame:
    """(src, dst, w): symmetric weights; counts of edges in either direction, or sums of a column.  A loop counts twice."""
    own = g.edges.select("src", "dst", (F.lit(1.0) if column is None else F.col(column)).alias("w"))
    return own.unionAll(own.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def louvain(g: PropertyGraph, resolution: float = 1.0, phases: int = 10, sweeps: int = 12, weight: str | None = None) -> tuple[DataFrame, int]:
    """((id, label), phases run): local moves by gain, then contraction, until fewer than sqrt(V) vertices move.

    gain of leaving c for d: (w(v, d) - w(v, c)) / m - resolution * k_v (S_d + k_v - S_c) / 2m^2.  Labels are smallest members.
    A low resolution merges: at 0.25 two triangles joined by an edge are one community, at 1 they are two."""
    arcs = Stored(_weights(g, weight), F.sum("w").alias("w"))
    two_m, ran = arcs.seen.get("w") or 0.0, 0
    labels = Stored(g.vertices.select("id", F.col("id").alias("label"))).df
    for _ in range(phases if two_m else 0):
        ran += 1
        state, size, moved = _sweeps(arcs.df, two_m, sweeps, lambda w, inside, k, s, s_c: (w - inside) / (two_m / 2) - resolution * k * (s + k - s_c) / (two_m * two_m / 2))
        to = state.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = Stored(labels.join(to, "label", "left").select("id", F.coalesce("next", "label").alias("label"))).df
        if moved * moved < size:
            break
        of = lambda end: state.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
        old = arcs
        arcs = Stored(old.df.join(of("src"), "src").join(of("dst"), "dst").groupBy(F.col("l_src").alias("src"), F.col("l_dst").alias("dst")).agg(F.sum("w").alias("w")))
        old.drop()
    return labels, ran


def louvain_one_level(g: PropertyGraph, resolution: float = 1.0, sweeps: int = 12, weight: str | None = "weight") -> DataFrame:
    """(id, label): local moves only, by the gain k_in / 2m - S k_v / (4m^2 resolution) of the new community less that of the
    old one, from which the vertex is taken; k_in is the weight towards it, S its total.  A high resolution merges."""
    arcs = Stored(_weights(g, weight), F.sum("w").alias("w"))
    two_m = arcs.seen.get("w") or 0.0
    if not two_m:
        return g.vertices.select("id", F.col("id").alias("label"))
    found, _, _ = _sweeps(arcs.df, two_m, sweeps, lambda w, inside, k, s, s_c: (w - inside) / two_m - k * (s + k - s_c) / (two_m * two_m * resolution))
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _sweeps(arcs: DataFrame, two_m: float, sweeps: int, gain) -> tuple[DataFrame, int, int]:
    """((id, label), vertices, moves) of local moves over symmetric arcs (src, dst, w) from one community a vertex.

    gain(w, inside, k, s, s_c): of a vertex of weight k for a community of total s that w leads to, from one of total s_c that `inside`
    leads to.  In each sweep the vertices that `draw` picks move at once to their best community (ties: smaller label); it ends where no
    vertex would gain by a move.
    One job a sweep: communities' weights around a vertex and their totals meet by label, a vertex's own by its id."""
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    rounds = Rounds()
    n_moved, n_would, size = F.count(F.when(F.col("moved"), 1)).alias("n"), F.count(F.when(F.col("would"), 1)).alias("would"), F.count("*").alias("size")
    state, seen = rounds.observed(degree.select("id", "k", F.col("id").alias("label"), F.lit(False).alias("moved")), size)
    count, moves = seen.get("size", 0), 0
    own_arcs = arcs.where("src <> dst")
    for sweep in range(sweeps):
        total = state.groupBy("label").agg(F.sum("k").alias("s"))
        near = own_arcs.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        held = state.select("id", "k", F.col("label").alias("c"))
        rows = near.join(held, "id")
        inside = rows.where("label = c").select("id", F.col("w").alias("inside"))
        rows = rows.where("label <> c").join(inside, "id", "left").join(total, "label").join(total.select(F.col("label").alias("c"), F.col("s").alias("s_c")), "c")
        rows = rows.select("id", "label", gain(F.col("w"), F.coalesce("inside", F.lit(0.0)), F.col("k"), F.col("s"), F.col("s_c")).alias("gain")).where("gain > 1e-12")
        best = rows.groupBy("id").agg(F.max(F.struct("gain", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("to"))
        turn, would = draw("id", sweep) % 2 == 0, F.col("to").isNotNull()
        rows = state.join(best, "id", "left").select("id", "k", F.when(turn & would, F.col("to")).otherwise(F.col("label")).alias("label"), (turn & would).alias("moved"), would.alias("would"))
        state, seen = rounds.observed(rows, n_moved, n_would)
        moves += seen.get("n", 0)
        if not seen.get("would", 0):  # nobody gains by a move, whoever's turn it is
            break
    least = state.groupBy("label").agg(F.min("id").alias("m"))
    out = Stored(state.join(least, "label").select("id", F.col("m").alias("label"))).df
    rounds.close()
    return out, count, moves


def greedy_merge(g: PropertyGraph, max_iter: int | None = None) -> DataFrame:
    """(id, label): merging by the `edges` form of modularity, which every edge inside a community raises, ends in the
    connected components; labels count from 0 in the order of smallest members.

    max_iter: at most that many merges: the first max_iter vertices, in order of their ids, that aren't the smallest of their
    component join it, the others stay alone."""
    labels = connected_components(g)
    if max_iter is not None:
        joins = numbered(labels.where("id <> label"), "id", "n").where(F.col("n") < max_iter).select("id", "label")
        labels = labels.select("id").join(joins, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return renumbered(labels)


def greedy_move(g: PropertyGraph, max_iter: int = 10) -> DataFrame:
    """(id, label): each vertex that `draw` picks moves to the neighbouring community of the largest edge weight,
    other than its own, if that exceeds its own; at most max_iter rounds."""
    arcs = Arcs(_weights(g, "weight").where("src <> dst"))
    rounds = Rounds(arcs.by)
    state = rounds.cut(g.vertices.select("id", F.col("id").alias("label")))
    for i in range(max_iter):
        near = arcs.send(state.select("id", "label")).groupBy(F.col("dst").alias("id"), "label").agg(F.sum("w").alias("w"))  # w is symmetric
        best = near.groupBy("id").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("to"))
        pick = draw("id", i) % 2 == 0
        rows = state.join(best, "id", "left").select("id", F.when(pick, F.coalesce("to", "label")).otherwise(F.col("label")).alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved"))
        state, seen = rounds.observed(rows, F.count(F.when(F.col("moved"), 1)).alias("n"))
        state = state.drop("moved")
        if not seen.get("n", 0):
            break
    arcs.drop()
    return state.select("id", "label")


def label_propagation(g: PropertyGraph, max_iter: int = 10) -> DataFrame:
    """(id, label): all at once, the most frequent label among undirected neighbours (ties: smallest); at most max_iter rounds."""
    arcs = Arcs(g.mirrored())
    rounds = Rounds(arcs.by)
    state = rounds.cut(g.vertices.select("id", F.col("id").alias("label")))
    for _ in range(max_iter):
        seen = arcs.send(state).groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        best = seen.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("x")).select("id", (-F.col("x.l")).alias("to"))
        rows = state.join(best, "id", "left").select("id", F.coalesce("to", "label").alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved"))
        state, seen = rounds.observed(rows, F.count(F.when(F.col("moved"), 1)).alias("n"))
        state = state.drop("moved")
        if not seen.get("n", 0):
            break
    arcs.drop()
    return state.select("id", "label")
