"""Structure: components, cores, triangles, clustering and betweenness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.arcs import Arcs, draw, relax
from tessera.operators.components import component_labels
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import Grown, Rounds, Stored, cut, numbered


def connected_components(g: PropertyGraph) -> DataFrame:
    """(id, label): label is the smallest id reachable when directions don't matter."""
    labels = component_labels(g.pairs(loops=False).select(F.col("src").alias("a"), F.col("dst").alias("b")), cut)
    return g.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _spread(arcs: Arcs, start: DataFrame, jump: bool = True) -> DataFrame:
    """(id, value): the smallest value of start (id, value) that reaches each vertex along arcs."""
    return relax(arcs, start.withColumn("parent", F.lit(None).cast("long")), lambda v: v, jump=jump).select("id", "value")


def strongly_connected_components(g: PropertyGraph) -> DataFrame:
    """(id, label): label is the smallest id of the strongly connected component.

    Rounds of trimming (a vertex without in- or out-edges is a component) and colouring: the smallest id spreads
    forwards, by jumps over what is coloured already; what can reach a colour's root within the colour is the root's component.  All colours settle at once."""
    arcs = Stored(g.pairs(loops=False).select("src", "dst"), F.count("*").alias("n"))
    ends = arcs.df.select(F.col("src").alias("id")).unionByName(arcs.df.select(F.col("dst").alias("id"))).distinct()
    done = Grown()
    alone = lambda df: df.select("id", F.col("id").alias("label"))
    done.add(alone(g.vertices.select("id").distinct().join(ends, "id", "left_anti")))

    def without(gone: DataFrame) -> Stored:
        nonlocal arcs
        lost = gone.hint("shuffle_hash") if arcs.seen["n"] > Arcs.FEW else gone
        old, arcs = arcs, Stored(arcs.df.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti"), F.count("*").alias("n"))
        # an end that loses its last edge by this is a component of its own
        ends = lambda t: t.select(F.col("src").alias("id")).unionByName(t.select(F.col("dst").alias("id"))).distinct()
        done.add(alone(ends(old.df).join(gone, "id", "left_anti").join(ends(arcs.df), "id", "left_anti")))
        old.drop()

    while arcs.seen.get("n", 0):
        while arcs.seen.get("n", 0):
            into, out = arcs.df.select(F.col("dst").alias("id")).distinct(), arcs.df.select(F.col("src").alias("id")).distinct()
            single = Stored(into.join(out, "id", "left_anti").unionByName(out.join(into, "id", "left_anti")), F.count("*").alias("n"))
            if not single.seen.get("n", 0):
                break
            done.add(alone(single.df))
            without(single.df)
        if not arcs.seen.get("n", 0):
            break
        ways = Arcs(arcs.df)
        colour = Stored(_spread(ways, arcs.df.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("value")))).df
        ways.drop()
        of = lambda end: ways.hashed(colour.select(F.col("id").alias(end), F.col("value").alias(f"c_{end}")))
        back = Arcs(arcs.df.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = _spread(back, colour.where("id = value"), jump=False)
        found = done.add(reached.select("id", F.col("value").alias("label")))[0]
        back.drop()
        without(found.select("id"))
    return done.df


def cores(g: PropertyGraph) -> DataFrame:
    """(id, core) by peeling: out-degrees count down as predecessors go; loops don't count down.

    Level k removes every vertex whose rest is at most k, wave by wave; levels without a vertex are skipped.  A wave writes what it
    removes and what is left.  Now and then it is looked whether any arc is left between what is left; if not, nothing counts down any more."""
    arcs = Arcs(g.pairs(loops=False))
    done, rounds = Grown(), Rounds(arcs.by)
    low = F.min("rest").alias("low")
    state, seen = rounds.observed(g.degrees().select("id", F.col("out_degree").alias("rest")), low)
    level = wave = 0
    done.add(state.select("id", F.lit(0).cast("long").alias("core")).limit(0))
    while seen.get("low") is not None:
        level, wave = max(level, seen["low"]), wave + 1
        if wave > 1 and wave & (wave - 1) == 0 and not arcs.send(state.select("id")).join(state.select(F.col("id").alias("dst")), "dst", "left_semi").take(1):
            done.add(state.select("id", F.greatest("rest", F.lit(level).cast("long")).alias("core")))
            break
        gone = done.add(state.where(F.col("rest") <= level).select("id", F.lit(level).cast("long").alias("core")))[0]
        fewer = arcs.send(gone.select("id")).groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("k"))
        state, seen = rounds.observed(state.where(F.col("rest") > level).join(fewer, "id", "left").select("id", (F.col("rest") - F.coalesce("k", F.lit(0))).alias("rest")), low)
    arcs.drop()
    rounds.close()
    return done.df


def _h_index(near: DataFrame) -> DataFrame:
    """(id, h, now) of near (id, own, v): the h-index of the values, each cut to the vertex's own, and how many are not below it."""
    down, own = W.partitionBy("id").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("id")
    counts = near.groupBy("id", F.least("v", "own").alias("v")).agg(F.count("*").alias("n"))
    index = counts.select("id", "v", "n", F.least("v", F.sum("n").over(down)).alias("h")).withColumn("h", F.max("h").over(own))
    return index.groupBy("id").agg(F.max("h").alias("h"), F.sum(F.when(F.col("v") >= F.col("h"), F.col("n")).otherwise(0)).alias("now"))


def k_core(g: PropertyGraph, start: DataFrame | None = None) -> DataFrame:
    """(id, core): undirected core numbers, as the fixpoint of neighbours' h-indices from the degrees down.

    A vertex's h-index is taken over its neighbours' counts by value, each value cut to the vertex's own, so a hub needs a row for each
    different value only.  While many fall, or arcs are few, all are looked at.  Then each vertex keeps how many neighbours hold it up (have its
    value at least); one falls when that gets less than its value, and only the arcs of those that fall are read into the round.
    start: values (id, core) that are nowhere below the core numbers, to begin with instead of the degrees."""
    arcs = Arcs(g.mirrored())
    own = arcs.df.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
    if start is not None:
        own = own.join(start.select("id", F.col("core").alias("most")), "id", "left").select("id", F.least("core", F.coalesce("most", "core")).alias("core"))
    rounds = Rounds(arcs.by)
    state, seen = rounds.cut(g.vertices.select("id").join(own, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"))), {}
    fell, every = F.count(F.when(F.col("core") < F.col("was"), 1)).alias("n"), F.count("*").alias("all")
    while not seen or 4 * seen["n"] > seen["all"] or (seen["n"] and arcs.by is None):
        near = arcs.send(arcs.hashed(state.select("id", F.col("core").alias("v")))).join(arcs.hashed(state.select(F.col("id").alias("dst"), F.col("core").alias("own"))), "dst")
        index = arcs.hashed(_h_index(near.select(F.col("dst").alias("id"), "own", "v")))
        state, seen = rounds.observed(state.join(index, "id", "left").select("id", F.coalesce("h", "core").alias("core"), F.coalesce("now", F.lit(0)).alias("held"), F.col("core").alias("was")), fell, every)
    short = F.count(F.when(F.col("held") < F.col("core"), 1)).alias("n")

    def let_go(near: DataFrame, lower: DataFrame) -> DataFrame:
        """(id, k): neighbours (near: id, dst, v) that held a vertex up before they fell (lower: id, was, h)."""
        to = near.join(arcs.hashed(lower.select("id", "was", "h")), "id").join(arcs.hashed(lower.select(F.col("id").alias("dst"), F.col("h").alias("less"))), "dst", "left")
        value = F.coalesce("less", "v")
        return arcs.hashed(to.where((F.col("h") < value) & (value <= F.col("was"))).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k")))

    if seen["n"]:
        lower = state.where("core < was").select("id", "was", F.col("core").alias("h"))
        near = arcs.send(arcs.hashed(lower.select("id"))).join(arcs.hashed(state.select(F.col("id").alias("dst"), F.col("core").alias("v"))), "dst").select(F.col("src").alias("id"), "dst", "v")
        state, seen = rounds.observed(state.join(let_go(near, lower), "id", "left").select("id", "core", (F.col("held") - F.coalesce("k", F.lit(0))).alias("held")), short)
    while seen["n"]:
        sent = arcs.send(arcs.hashed(state.where("held < core").select("id", F.col("core").alias("own"))))
        near = Stored(sent.join(arcs.hashed(state.select(F.col("id").alias("dst"), F.col("core").alias("v"))), "dst").select(F.col("src").alias("id"), "own", "dst", "v"))
        # a vertex that no neighbour is left to hold has an index too: all its neighbours' counts are in near
        lower = Stored(near.df.select("id", F.col("own").alias("was")).distinct().join(_h_index(near.df), "id"))
        new = state.join(arcs.hashed(lower.df.select("id", "h", "now")), "id", "left").join(let_go(near.df, lower.df), "id", "left")
        state, seen = rounds.observed(new.select("id", F.coalesce("h", "core").alias("core"), (F.coalesce("now", "held") - F.coalesce("k", F.lit(0))).alias("held")), short)
        near.drop()
        lower.drop()
    arcs.drop()
    return state.select("id", "core")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, of undirected pairs (a, b).  Pairs point from the lower degree to the higher, so hubs have few.

    A vertex's targets are one sorted list, at most sqrt(2 pairs) long.  A pair sends the part of its lower end's list behind it to its
    upper end, where it meets that one's list: a row moves for each pair instead of one for each two targets, and none are sorted."""
    edges = cut(edges)
    degree = edges.select(F.col("a").alias("v")).unionAll(edges.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    of = lambda end: degree.select(F.col("v").alias(end), F.col("d").alias(f"d{end}")).hint("shuffle_hash")
    both = edges.join(of("a"), "a").join(of("b"), "b")
    low, high = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    arcs = both.select(F.when(low < high, F.col("a")).otherwise(F.col("b")).alias("u"), F.greatest(low, high).alias("x"))
    lists = cut(arcs.groupBy("u").agg(F.sort_array(F.collect_list("x"))["v"].alias("to")))
    sent = lists.select("u", "to", F.posexplode("to").alias("at", "v")).where(F.col("at") + 1 < F.size("to")).select("u", "v", F.slice("to", F.col("at") + 2, F.size("to")).alias("rest"))
    met = sent.join(lists.select(F.col("u").alias("v"), F.col("to").alias("own")).hint("shuffle_hash"), "v")
    closed = met.select("u", "v", F.explode(F.array_intersect("rest", "own")).alias("w"))
    t = F.array_sort(F.array("u", "v", "w"))
    return closed.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def edge_support(g: PropertyGraph) -> DataFrame:
    """(a, b, n): common neighbours of each neighbouring pair a < b."""
    pairs = g.undirected()
    t = triangles(pairs).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("a"), F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("x"))
    counts = t.groupBy("x.a", "x.b").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def directed_triangles(g: PropertyGraph) -> DataFrame:
    """(a, b, c) of undirected triangles with a vertex that has out-edges to both others: the triangles are found from the lower
    degrees up, then their directed sides are looked up, so no hub pairs its neighbours."""
    arcs = g.pairs(loops=False).select("src", "dst")
    sides = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    found = triangles(g.undirected())
    both = found.select("a", "b", "c", F.explode(F.array(*[sides(x, y) for x in "abc" for y in "abc" if x != y])).alias("s")).select("a", "b", "c", "s.*")
    out = both.join(arcs, ["src", "dst"], "left_semi").groupBy("a", "b", "c", "src").agg(F.count("*").alias("n"))
    return out.where("n = 2").select("a", "b", "c").distinct()


def clustering(g: PropertyGraph, only: DataFrame | None = None) -> DataFrame:
    """(id, degree, triangles, coefficient): 2t / d(d - 1), 0 below two neighbours.  only: the ids wanted (id)."""
    pairs = g.undirected()
    if only is not None:
        near = g.neighbours(only).select(F.col("neighbour").alias("id")).unionByName(only.select("id")).distinct()
        pairs = pairs.join(near.withColumnRenamed("id", "a"), "a", "left_semi").join(near.withColumnRenamed("id", "b"), "b", "left_semi")
    found = triangles(pairs).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    ids = g.vertices.select("id") if only is None else g.vertices.select("id").join(only.select("id"), "id", "left_semi")
    degree = g.mirrored().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    rows = ids.join(degree, "id", "left").join(found, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"), F.coalesce("t", F.lit(0)).alias("triangles"))
    d = F.col("degree")
    return rows.withColumn("coefficient", F.when(d < 2, 0.0).otherwise(2.0 * F.col("triangles") / (d * (d - 1.0))))


#: Sources whose path counts share a row in sampled betweenness: a bit of a long for each.
WIDE = 64


def _dependencies(arcs: Arcs, sources: DataFrame, k: int, most: int, include_source: bool) -> DataFrame:
    """(id, delta): Brandes' dependencies on k sources (id, at; at from 0, k at most WIDE), summed.

    A vertex has one row in a level, with a column for each source, so an arc carries one row for all sources and sums meet by vertex;
    the sources that have reached it are a mask of bits.  most: pairs (source, vertex) that can be reached; no round follows when all are.
    Dependencies are looked up from the upper end of an arc, for the sources that have it on the level."""
    names, bits = [f"p{j}" for j in range(k)], [F.expr(f"shiftleft(1L, {j})") for j in range(k)]
    each = lambda f: [f(F.col(c), b).alias(c) for c, b in zip(names, bits)]
    held = lambda df: df.hint("shuffle_hash")  # noqa: E731  # rows are wide but well packed: by the files' size they would be broadcast
    masked = lambda parts: reduce(DataFrame.unionByName, [x.df.select("id", "bits") for x in parts]).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    summed = lambda parts: reduce(DataFrame.unionByName, [x.df.select("id", "delta") for x in parts]).groupBy("id").agg(F.sum("delta").alias("delta"))
    counts = F.count("*").alias("n"), F.sum(F.bit_count("bits")).alias("reached")
    start = sources.select("id", *[F.when(F.col("at") == j, 1.0).otherwise(0.0).alias(c) for j, c in enumerate(names)], F.expr("shiftleft(1L, int(at))").alias("bits"))
    levels = [Stored(start, *counts)]
    known, reached = list(levels), levels[0].seen["reached"]
    while levels[-1].seen.get("n", 0) and reached < most:
        if len(known) > Grown.MOST:
            known = [Stored(masked(known))]
        step = arcs.send(held(levels[-1].df.drop("bits"))).groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in names])
        new = step.join(held(masked(known).withColumnRenamed("bits", "had")), "id", "left").withColumn("had", F.coalesce("had", F.lit(0)).cast("long"))
        new = new.select("id", *each(lambda p, b: F.when(F.col("had").bitwiseAND(b) == 0, p).otherwise(0.0)))
        mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(c) > 0, b).otherwise(F.lit(0).cast("long")) for c, b in zip(names, bits)])
        levels.append(Stored(new.withColumn("bits", mask).where("bits <> 0"), *counts))
        known.append(levels[-1])
        reached += levels[-1].seen.get("reached") or 0
    if not levels[-1].seen.get("n", 0):
        levels.pop().drop()
    done: list[Stored] = []
    below = None
    for own in reversed(levels):
        if below is None:
            rows = own.df.select("id", F.lit(0.0).alias("delta"), *[F.when(F.col(c) > 0, 1 / F.col(c)).otherwise(0.0).alias(c) for c in names])
        else:
            sent = arcs.send(held(own.df.select("id", "bits"))).withColumnRenamed("src", "to").join(held(below.df.drop("delta").withColumnRenamed("id", "dst")), "dst")
            sent = sent.select("to", "n", *each(lambda u, b: F.when(F.col("bits").bitwiseAND(b) != 0, u).otherwise(0.0)))
            up = sent.groupBy(F.col("to").alias("id")).agg(*[F.sum(F.col(c) * F.col("n")).alias(f"u{c}") for c in names])
            both = own.df.join(held(up), "id", "left").select("id", *names, *[(F.col(c) * F.coalesce(f"u{c}", F.lit(0.0))).alias(f"d{c}") for c in names])
            total = sum((F.col(f"d{c}") for c in names[1:]), F.col(f"d{names[0]}"))
            rows = both.select("id", total.alias("delta"), *[F.when(F.col(c) > 0, (1 + F.col(f"d{c}")) / F.col(c)).otherwise(0.0).alias(c) for c in names])
        below = Stored(rows)
        own.drop()
        if include_source or own is not levels[0]:
            done.append(below)
        if len(done) > Grown.MOST:
            old, done = done, [Stored(summed(done))]
            for x in old[:-1]:
                x.drop()
    return summed(done) if done else below.df.select("id", "delta")  # all 0


#: Rows (source, vertex) that a batch of betweenness is meant to hold.
REACHED = 1 << 22


def betweenness(g: PropertyGraph, sources: int | None = 256, directed: bool = True, include_source: bool = True, scale: str = "sampled", seed: int = 42, batch: int = 64) -> DataFrame:
    """(id, score) by Brandes' levels for all sources of a batch at once.

    sources: how many (all if None or at least V), those with the smallest `draw`s of (id, seed).  Counts of shortest
    paths multiply parallel edges; loops are skipped.  include_source adds a source's own dependency.
    Samples of up to 4 WIDE sources go WIDE at a time, a row for each vertex (`_dependencies`); else rows are (source, vertex) pairs.
    scale: "sampled" (V / k) / ((V - 1)(V - 2)), "half" V / k / 2, "exact" 2 / ((V - 1)(V - 2)), "none" 1.
    batch: sources of the first batch; the next ones are as many as reach about REACHED vertices, going by the batch before.
    With more than one batch dependencies are looked up from the upper end of an arc, so a hub that few sources reach doesn't
    offer them to all its predecessors; with one batch they are sent back along all arcs, at most k times the arcs."""
    arcs = Arcs(g.pairs(loops=False) if directed else g.mirrored().withColumn("n", F.lit(1).cast("long")))
    n = g.vertices.count()
    k = n if sources is None else min(sources, n)
    wide = sources is not None and k <= 4 * WIDE
    few = k <= batch
    back = arcs if wide or not directed or not few else Arcs(arcs.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    chosen = cut(numbered(g.vertices.select("id", F.struct(draw("id", seed), F.col("id")).alias("_o")).orderBy("_o").limit(k), "_o", "at").select("id", "at"))
    scores = Grown(merge=lambda df: df.groupBy("id").agg(F.sum("delta").alias("delta")))
    scores.add(g.vertices.select("id", F.lit(0.0).alias("delta")).limit(0))
    first, size = 0, batch
    if wide and k:
        ends = Stored(arcs.df.select(F.col("dst").alias("id")).distinct(), F.count("*").alias("n"))
        for first in range(0, k, min(batch, WIDE)):
            own = chosen.where((F.col("at") >= first) & (F.col("at") < first + min(batch, WIDE))).select("id", (F.col("at") - first).alias("at"))
            size = min(batch, WIDE, k - first)
            scores.add(_dependencies(arcs, own, size, size * ends.seen.get("n", 0) + own.join(ends.df, "id", "left_anti").count(), include_source))
        ends.drop()
        first = k
    while first < k:
        seen, reached = Grown(), 0
        level = seen.add(chosen.where((F.col("at") >= first) & (F.col("at") < first + size)).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"), F.lit(0).alias("level")), F.count("*").alias("n"))
        depth = 0
        while level[1].get("n", 0):
            depth, reached = depth + 1, reached + level[1]["n"]
            step = arcs.send(level[0].select("id", "s", "paths")).groupBy("s", F.col("dst").alias("id")).agg(F.sum(F.col("paths") * F.col("n")).alias("paths"))
            level = seen.add(step.join(seen.df.select("s", "id"), ["s", "id"], "left_anti").select("s", "id", "paths", F.lit(depth).alias("level")), F.count("*").alias("n"))
        every, below = Stored(seen.df.repartition("level", "s", "id")) if depth > Grown.MOST else None, None
        rows = seen.df if every is None else every.df
        for at in range(depth - 1, -1, -1):
            own = rows.where(F.col("level") == at)
            if below is None:
                own = own.select("s", "id", "paths", F.lit(0.0).alias("delta"))
            else:
                unit = below.select("id", "s", ((1 + F.col("delta")) / F.col("paths")).alias("unit"))
                if few:
                    sent = back.send(unit).withColumnRenamed("dst", "to")
                else:
                    sent = arcs.send(own.select("id", "s")).join(unit.withColumnRenamed("id", "dst"), ["s", "dst"]).withColumnRenamed("src", "to")
                up = sent.groupBy("s", F.col("to").alias("id")).agg(F.sum(F.col("unit") * F.col("n")).alias("unit"))
                own = own.join(up, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("unit", F.lit(0.0))).alias("delta"))
            below = Stored(own).df
            scores.add((below if include_source else below.where("s <> id")).groupBy("id").agg(F.sum("delta").alias("delta")))
        first, size = first + size, max(1, min(16 * size, int(size * REACHED / max(1, reached))))
    arcs.drop()
    if back is not arcs:
        back.drop()
    total = scores.df.groupBy("id").agg(F.sum("delta").alias("x"))
    pairs = float((n - 1) * (n - 2)) if n > 2 else 1.0
    factor = {"sampled": (n / k if k else 0.0) / pairs, "half": (n / k if k else 0.0) / 2, "exact": 2.0 / pairs, "none": 1.0}[scale]
    return g.vertices.select("id").join(total, "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) * F.lit(factor)).alias("score"))
