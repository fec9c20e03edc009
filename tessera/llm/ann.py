"""Approximate nearest neighbours by vantage-point trees, one for each shard.

Nearness is the largest inner product.  With M the largest norm of a group of vectors and q of length 1, a candidate x becomes (x / M,
sqrt(1 - |x / M|^2)) and a query (q, 0); then |q' - x'|^2 = 2 - 2 q.x / M, so the nearest in the plain metric are the largest
products, and the triangle inequality holds.  A group is the vectors of one length whose norms lie between the same two powers
of two, so that a few long vectors don't make all others look alike; its vectors are scaled by that power, which is exact.

Shards follow space: a top tree over a bounded sample of each group (at most about TOP_SAMPLE vectors) splits at the median distance to
a vantage point until its leaves hold about SHARD rows each, and every row of the group descends it to its leaf.  A leaf of many more rows,
as of one vector with very many ids, is dealt over several shards by id.  Each shard gets a tree of its own, down to leaves of LEAF vectors.

For a query at distance d from a vantage point no vector of a side whose distances lie from low to high is closer than max(d - high,
low - d).  The bound of a leaf, in the top tree or in a shard's, is the largest on its path.  Leaves are visited from the smallest
bound on, and one is skipped where its bound is more than `factor` times the distance of the k-th best so far.  Factor 1 restores exact
search; a smaller one prunes more.  How small it may be depends on the vectors, so unless it is given, it is measured for each
length of vectors: up to SAMPLE queries are also answered by reading every leaf, and the smallest of FACTORS counts by which the trees
find at least GOAL of those neighbours; else 1.

A search has two passes.  In the first each query goes to the nearest leaf of every group, which gives it a k-th best; in the second to all other
leaves that this can't exclude.  Queries travel to the trees: a tree is sent once for each SLICE queries that need it, and a task holds
one tree at a time.  A shard yields at most k rows a query, from which a window takes the best k.

Equal vectors are one point of a tree with all their ids (ascending, as often as the rows have them); k + 1 ids of a point are the most that
one query's answer can need.  Scores are computed from the original components, in double precision.  Where more points than are
kept lie within rounding of the last score, a query takes them all from its leaves again, so ids settle every tie.

Edge cases: rows with a null id or vector, a null, NaN or infinite component or only zeros take no part; rows that share an id are
candidates of their own, and each query leaves out its own row alone; vectors of different lengths never meet; ties go to the smaller id; a
query with fewer candidates than k gets them all; products beyond the range of doubles tie as infinite; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import common

K = 20
SHARD = 8_192
LEAF = 256
SLICE = 16_384
#: Queries that a task works on at once.
BLOCK = 1_024
TOP_SAMPLE = 8_192
#: Recall at 20 by 0.25 on 51,282 random unit vectors of 64 components: 0.9998 (at 0.2: 0.997).
FACTORS = (0.25, 0.4, 0.6, 0.8)
GOAL = 0.99
SAMPLE = 100
#: Candidates beyond k that are kept for the exact ranking, against rounding in the leaves' products.
SLACK = 12


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, n, dim, power): each different id and vector that takes part, with the rows that have it, its length and the
    power of two above its norm."""
    v = F.col("v")
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = own.where(sound).groupBy("id", "v").agg(F.count("*").alias("n"))
    own = own.withColumn("_a", F.array_max(F.transform(v, F.abs)))
    square = F.aggregate(F.transform(v, lambda x: x / F.col("_a")), F.lit(0.0), lambda a, x: a + x * x)
    # vectors of one norm but for rounding stay together
    power = (F.floor(F.log2("_a") + 0.5 * F.log2(square) + 1e-3) + 1).cast("int")
    return own.select("id", "v", "n", F.size("v").alias("dim"), power.alias("power"))


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _scaled(x: np.ndarray, power: int) -> np.ndarray:
    """x times 2**-power, in two exact steps, as one factor could be out of range."""
    half = power // 2
    return np.ldexp(np.ldexp(x, -half), half - power)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """Points of norm `top` or less as points of norm 1 with one more component."""
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))[:, None]])


def _unit(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.sqrt((q**2).sum(axis=1, keepdims=True))


def _halves(lifted: np.ndarray, enough) -> list[tuple[np.ndarray, list]]:
    """Leaves (rows, path) of a vantage-point tree; a path has (vantage row, low, high) steps.  enough: rows, depth -> whether to stop."""
    rng, leaves = np.random.default_rng(0), []

    def split(rows: np.ndarray, path: list) -> None:
        if enough(len(rows), len(path)):
            leaves.append((rows, path))
            return
        at = int(rng.choice(rows))
        d = np.sqrt(np.maximum(((lifted[rows] - lifted[at]) ** 2).sum(axis=1), 0))
        by_d = np.argsort(d, kind="stable")
        for half in (by_d[: len(rows) // 2], by_d[len(rows) // 2 :]):
            split(rows[half], [*path, (at, d[half].min(), d[half].max())])

    split(np.arange(len(lifted)), [])
    return leaves


def _steps(leaves: list[tuple[np.ndarray, list]]) -> np.ndarray:
    """The leaves' paths, padded with vantage row -1."""
    steps = np.full((len(leaves), max(len(p) for _, p in leaves), 3), -1.0)
    for i, (_, p) in enumerate(leaves):
        if p:
            steps[i, : len(p)] = p
    return steps


def _bounds(q: np.ndarray, lifted: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For each query (length 1) and leaf the least distance that the leaf's points can have, less the rounding of distances."""
    bound = np.zeros((len(q), len(steps)))
    used = np.unique(steps[:, :, 0].astype(int))
    used = used[used >= 0]
    if len(used):
        far = np.sqrt(np.maximum(1 + (lifted[used] ** 2).sum(axis=1) - 2 * q @ lifted[used, :-1].T, 0))
        for leaf in range(len(steps)):
            for at, low, high in steps[leaf]:
                if at >= 0:
                    d = far[:, np.searchsorted(used, int(at))]
                    bound[:, leaf] = np.maximum(bound[:, leaf], np.maximum(d - high, low - d) - 2e-7)
    return bound


@dataclass
class Group:
    """The top tree of a group: lifted vantage points, paths of its leaves, and for each split (vantage, threshold, children)."""

    dim: int
    power: int
    top: float
    lifted: np.ndarray
    steps: np.ndarray
    splits: list[tuple[int, float, int, int]]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each scaled vector descends to."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))] if self.splits else []
        own = _lift(x, self.top) if self.splits else x
        while todo:
            node, rows = todo.pop()
            at, threshold, near, far = self.splits[node]
            d = np.sqrt(np.maximum(((own[rows] - self.lifted[at]) ** 2).sum(axis=1), 0))
            for child, part in ((near, rows[d <= threshold]), (far, rows[d > threshold])):
                if child >= 0:
                    todo.append((child, part))
                else:
                    out[part] = -child - 1
        return out


def group(dim: int, power: int, top: float, sample: np.ndarray, leaves: int) -> Group:
    """A top tree of `leaves` leaves or so over scaled sample vectors.  Every row is on one side of every threshold, so a side's range
    is bounded by it whatever rows come."""
    lifted = _lift(sample, top)
    rng, steps, splits = np.random.default_rng(1), [], []

    def split(rows: np.ndarray, path: list, wanted: int) -> int:
        d = np.zeros(len(rows))
        if wanted > 1 and len(rows) >= 8:
            at = int(rng.choice(rows))
            d = np.sqrt(np.maximum(((lifted[rows] - lifted[at]) ** 2).sum(axis=1), 0))
        if not d.any():  # small enough, or all of them equal
            steps.append((np.zeros(0), path))
            return -len(steps)
        threshold = float(np.median(d))
        if (d <= threshold).all():
            threshold = float(d[d < threshold].max())
        me = len(splits)
        splits.append((at, threshold, 0, 0))
        near = split(rows[d <= threshold], [*path, (at, 0.0, threshold)], wanted // 2)
        far = split(rows[d > threshold], [*path, (at, threshold, 2.0)], wanted - wanted // 2)
        splits[me] = (at, threshold, near, far)
        return me

    split(np.arange(len(lifted)), [], leaves)
    return Group(dim, power, top, lifted, _steps(steps), splits)


def build(ids: np.ndarray, n: np.ndarray, x: np.ndarray, top: float, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A shard's tree over distinct points, which are scaled; ids stand as often as rows have them."""
    order = np.argsort(ids, kind="stable")
    ids, n, x = ids[order], n[order], np.ascontiguousarray(x[order])
    _, first, inverse = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(inverse.ravel(), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), n, len(first)).astype(np.int64))])
    points = x[first]
    lifted = _lift(points, top)
    leaves = _halves(lifted, lambda rows, depth: rows <= leaf)
    return {"points": points, "lift": lifted[:, -1], "rows": np.concatenate([r for r, _ in leaves]), "ends": np.cumsum([len(r) for r, _ in leaves]), "steps": _steps(leaves), "ids": np.repeat(ids[by], n[by]), "bounds": bounds, "top": np.array([top])}


def search(tree: dict[str, np.ndarray], power: int, qid: np.ndarray, original: np.ndarray, k: int, factor: float | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, ids, scores): the best k of this tree for each query, its own row left out.

    least: a product (of the query at length 1 with scaled points) that the k-th best is known to reach.  Without a factor every leaf is read."""
    points, rows, steps, top = tree["points"], tree["rows"], tree["steps"], float(tree["top"][0])
    q = _unit(original)
    n, keep = len(q), k + 1 + SLACK
    near = 8 * q.shape[1] * np.finfo(float).eps * top  # rounding of products
    lifted = np.hstack([points / top, tree["lift"][:, None]])
    bound = _bounds(q, lifted, steps)
    best = np.full((n, keep), -np.inf)
    where = np.full((n, keep), -1)
    seen = np.zeros((n, len(steps)), bool)
    starts = np.concatenate([[0], tree["ends"][:-1]])

    def visit(leaf: int, who: np.ndarray) -> None:
        own = rows[starts[leaf] : tree["ends"][leaf]]
        seen[who, leaf] = True
        s = np.hstack([best[who], q[who] @ points[own].T])
        w = np.hstack([where[who], np.broadcast_to(own, (len(who), len(own)))])
        pick = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        best[who[:, None], np.arange(pick.shape[1])] = np.take_along_axis(s, pick, 1)
        where[who[:, None], np.arange(pick.shape[1])] = np.take_along_axis(w, pick, 1)

    order = np.argsort(bound, axis=1, kind="stable")
    for turn in range(len(steps)):  # each query's next leaf by bound; queries that meet in a leaf go together
        kth = np.maximum(-np.partition(-best, k, axis=1)[:, k], least)  # one more than k: a query's own vector may be among them
        leaf = order[:, turn]
        live = np.ones(n, bool) if factor is None else bound[np.arange(n), leaf] <= reach(kth, top, factor)
        if not live.any():
            break
        for x in np.unique(leaf[live]):
            visit(int(x), np.flatnonzero(live & (leaf == x)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kth = -np.partition(-best, k, axis=1)[:, k]
    crowded = (best.min(axis=1) >= kth - near) & np.isfinite(kth)  # points left out may tie with the last one
    for i in range(n):
        found = where[i][where[i] >= 0]
        if crowded[i]:
            found = np.concatenate([rows[starts[x] : tree["ends"][x]] for x in np.flatnonzero(seen[i])])
            found = found[points[found] @ q[i] >= kth[i] - near]
        own = _scaled(original[i], power_of(original[i]))
        with np.errstate(over="ignore"):
            score = _scaled((points[found] * own).sum(axis=1), -power - power_of(original[i]))
        same = np.flatnonzero((points[found] == _scaled(original[i], power)).all(axis=1)) if len(found) else np.zeros(0, int)
        ids = [tree["ids"][tree["bounds"][p] : min(tree["bounds"][p + 1], tree["bounds"][p] + k + 1)] for p in found]
        for p in same:  # the query's own row, once
            at = np.searchsorted(whole := tree["ids"][tree["bounds"][found[p]] : tree["bounds"][found[p] + 1]], qid[i])
            if at < len(whole) and whole[at] == qid[i]:
                ids[p] = np.delete(whole[: k + 2], at) if at < k + 2 else whole[: k + 1]
        score = np.repeat(score, [len(x) for x in ids])
        flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
        pick = np.lexsort((flat, -score))[:k]
        out.append((np.full(len(pick), i), flat[pick], score[pick]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def power_of(x: np.ndarray) -> int:
    return int(np.frexp(np.abs(x).max())[1])


def reach(kth: np.ndarray, top: float, factor: float) -> np.ndarray:
    """The distance, in a group whose largest norm is top, at which a product equals the k-th best; beyond it times factor nothing is looked
    for.  Below 0 where not even that norm could reach it."""
    square = 2 - 2 * np.maximum(kth, -1e300) / top
    return np.where(np.isfinite(kth), np.where(square < -1e-9, -1.0, factor * np.sqrt(np.maximum(square, 0))), np.inf)


class Index:
    """Groups on the driver (their top trees are bounded by the sample), shards as a table (dim, power, leaf, sub, tree)."""

    def __init__(self, rows: DataFrame, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK):
        """rows: as `usable` gives them."""
        self.spark, self.block = rows.sparkSession, block
        norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * F.pow(F.lit(2.0), -F.floor(F.col("power") / 2)) * F.pow(F.lit(2.0), F.floor(F.col("power") / 2) - F.col("power"))), F.lit(0.0), lambda a, x: a + x * x))
        counted = rows.groupBy("dim", "power").agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()  # lengths times powers of two
        draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
        self.groups: list[Group] = []
        large = [r for r in counted if r["n"] > shard]
        picked: dict[tuple[int, int], list] = {}
        if large:
            take = F.lit(False)
            for r in large:
                take = take | ((F.col("dim") == r["dim"]) & (F.col("power") == r["power"]) & (draw < int((1 << 30) * min(1.0, TOP_SAMPLE / r["n"]))))
            for r in rows.where(take).select("dim", "power", "v").collect():
                picked.setdefault((r["dim"], r["power"]), []).append(r["v"])
        for r in counted:
            own = picked.get((r["dim"], r["power"]), [])
            sample = _scaled(np.array(sorted(own), float).reshape(len(own), r["dim"]), r["power"])
            # rounding of norms must not put a vector beyond the largest
            self.groups.append(group(r["dim"], r["power"], r["top"] * (1 + 1e-12), sample, -(-r["n"] // shard) if own else 1))
        tops = self.spark.sparkContext.broadcast(self.groups)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = {(g.dim, g.power): g for g in tops.value}
            for batch in batches:
                dim, power = (batch.column(i).to_numpy() for i in (3, 4))
                leaf = np.zeros(batch.num_rows, np.int32)
                for d, p in {(int(d), int(p)) for d, p in zip(dim, power)}:
                    at = np.flatnonzero((dim == d) & (power == p))
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                    leaf[at] = by[d, p].leaf(_scaled(x, p))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        dealt = common.stored(common.mapped(rows, assign, "id long, v array<double>, n long, dim int, power int, leaf int"), "ann-dealt")
        sizes = dealt.groupBy("dim", "power", "leaf").agg(F.ceil(F.count("*") / shard).cast("int").alias("subs"))
        self.subs = common.stored(sizes, "ann-leaves")
        dealt = dealt.join(F.broadcast(self.subs), ["dim", "power", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))

        def tree(table: pa.Table) -> pa.Table:
            power = table.column("power")[0].as_py()
            top = next(g.top for g in tops.value if (g.dim, g.power) == (table.column("dim")[0].as_py(), power))
            x = _scaled(table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), power)
            made = build(table.column("id").to_numpy(), table.column("n").to_numpy(), x, top, leaf)
            return pa.table({c: table.column(c)[:1] for c in ("dim", "power", "leaf", "sub")} | {"tree": pa.array([_dump(**made)], pa.binary())})

        made = dealt.select("dim", "power", "leaf", "sub", "id", "n", "v").groupBy("dim", "power", "leaf", "sub").applyInArrow(tree, "dim int, power int, leaf int, sub int, tree binary")
        self.trees = common.stored(made, "ann-trees")
        self._tops = tops

    def targets(self, queries: DataFrame, which) -> DataFrame:
        """queries with a row for each shard to visit.  which(group, unit queries, kth, bounds): flags, a row a query and a column a leaf;
        queries may have a column kth, the score of the k-th best so far."""
        tops, names = self._tops, queries.columns
        place = {c: i for i, c in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim = batch.column(place["dim"]).to_numpy()
                for g in tops.value:
                    at = np.flatnonzero(dim == g.dim)
                    if not len(at):
                        continue
                    x = batch.column(place["v"]).take(pa.array(at)).flatten().to_numpy().reshape(len(at), g.dim)
                    kth = known(batch.column(place["kth"]).take(pa.array(at)).to_numpy(zero_copy_only=False), x, g.power) if "kth" in place else np.full(len(at), -np.inf)
                    flags, least = which(g, kth, _bounds(_unit(x), g.lifted, g.steps)), pa.array(kth)
                    who, leaf = np.nonzero(flags)
                    for a in range(0, len(who), 4096):
                        own = pa.array(at[who[a : a + 4096]])
                        cols = [c.take(own) for c in batch.columns]
                        n = len(own)
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, g.power, np.int32)), pa.array(leaf[a : a + 4096].astype(np.int32)), least.take(pa.array(who[a : a + 4096]))], [*names, "power", "leaf", "least"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        found = common.mapped(queries, run, f"{kinds}, power int, leaf int, least double")
        found = found.join(F.broadcast(self.subs), ["dim", "power", "leaf"])
        return found.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")

    def visit(self, targets: DataFrame, answer, schema: str) -> DataFrame:
        """answer(tree, power, queries as a batch) over all targets, as rows of schema.  targets: as `targets` gives them, stored."""
        at = ["dim", "power", "leaf", "sub"]
        count = targets.groupBy(*at).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        names = targets.columns
        trees = self.trees.join(count, at).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        asked = targets.join(count, at).withColumn("slice", F.pmod(F.xxhash64("query", F.lit(3)), F.col("slices")).cast("int"))
        body = F.struct(*names)
        rows = trees.select(*at, "slice", F.lit(None).cast(asked.select(body.alias("b")).schema["b"].dataType).alias("asked"), "tree")
        rows = rows.unionByName(asked.select(*at, "slice", body.alias("asked"), F.lit(None).cast("binary").alias("tree")))
        parts, block = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.block
        rows = rows.repartition(parts, *at, "slice").sortWithinPartitions(*at, "slice", F.col("tree").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, power = None, 0
            for batch in batches:
                is_tree = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(is_tree).tolist()
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if a == b:
                        continue
                    if is_tree[a]:
                        tree, power = _load(batch.column(6)[a].as_py()), batch.column(1)[a].as_py()
                        a += 1
                    for c in range(a, b, block):
                        own = batch.column(5).slice(c, min(block, b - c)).flatten()
                        yield from answer(tree, power, dict(zip(names, own)))

        return common.mapped(rows, run, schema)


def known(kth: np.ndarray, x: np.ndarray, power: int) -> np.ndarray:
    """A k-th best score (NaN: none) as a product of the query at length 1 with points scaled by 2**-power."""
    size = np.abs(x).max(axis=1)
    norm = np.sqrt(((x / size[:, None]) ** 2).sum(axis=1))
    with np.errstate(over="ignore", invalid="ignore"):
        out = _scaled(kth / size, power) / norm
    return np.where(np.isnan(out) | (out == np.inf), -np.inf, out - 1e-12 * np.abs(out))


def _arrays(asked: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(asked["query"])
    return asked["id"].to_numpy(), asked["v"].flatten().to_numpy().reshape(n, -1), asked["least"].to_numpy(zero_copy_only=False)


def _home(g: Group, kth: np.ndarray, bound: np.ndarray) -> np.ndarray:
    flags = np.zeros(bound.shape, bool)
    flags[np.arange(len(bound)), bound.argmin(axis=1)] = True
    return flags


ANSWER = "query long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _visited(index: Index, targets: DataFrame, k: int, factor: dict[int, float] | None) -> DataFrame:
    """(query, vec_id, score): the best k of each shard.  factor: by length; None reads every leaf."""

    def answer(tree: dict, power: int, asked: dict) -> Iterator[pa.RecordBatch]:
        qid, q, least = _arrays(asked)
        who, ids, score = search(tree, power, qid, q, k, None if factor is None else factor.get(q.shape[1], 1.0), least)
        yield pa.RecordBatch.from_arrays([asked["query"].take(pa.array(who)), pa.array(ids), pa.array(score)], ["query", "vec_id", "score"])

    return index.visit(targets, answer, ANSWER)


def _first(index: Index, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The first pass: what the nearest leaves hold, and asked with kth, null where they hold fewer than k."""
    near = common.stored(index.targets(asked, _home), "ann-near")
    found = common.stored(_best(_visited(index, near, k, None), k), "ann-first")
    kth = found.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    return found.drop("rank"), common.stored(asked.join(kth, "query", "left").select(*asked.columns, "kth"), "ann-asked")


def factors(index: Index, asked: DataFrame, k: int) -> dict[int, float]:
    """The factor to use by length of vectors, from the recall on a sample of queries (query, id, v, dim)."""
    own = F.row_number().over(W.partitionBy("dim").orderBy("query"))
    counts = asked.groupBy("dim").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("query", F.lit(2)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.least(F.lit(1.0), 2.0 * SAMPLE / F.col("n"))
    few = asked.join(F.broadcast(counts), "dim").where(draw).drop("n")  # about twice as many, so that the window is small
    few = common.stored(few.withColumn("_n", own).where(F.col("_n") <= SAMPLE).select(*asked.columns), "ann-sample")
    _, known_ = _first(index, few, k)
    every = common.stored(index.targets(known_, lambda g, kth, bound: np.ones(bound.shape, bool)), "ann-every")
    flags = [f"f{i}" for i in range(len(FACTORS))]
    tops = index._tops

    def answer(tree: dict, power: int, asked: dict) -> Iterator[pa.RecordBatch]:
        qid, q, least = _arrays(asked)
        who, ids, score = search(tree, power, qid, q, k, None, least)
        g = next(g for g in tops.value if (g.dim, g.power) == (q.shape[1], power))
        bounds = _bounds(_unit(q), g.lifted, g.steps)
        leaf = asked["leaf"].to_numpy()
        home = bounds.argmin(axis=1) == leaf
        hit = []
        for f in FACTORS:
            open_ = home | (bounds[np.arange(len(leaf)), leaf] <= reach(least, g.top, f))
            got = {x for x in zip(*(c.tolist() for c in search(tree, power, qid, q, k, f, least)[:2])) if open_[x[0]]}
            whole = {x for x in zip(who.tolist(), ids.tolist()) if home[x[0]]}  # the first pass reads all of a home leaf
            hit.append(pa.array([x in got or x in whole for x in zip(who.tolist(), ids.tolist())], pa.bool_()))
        yield pa.RecordBatch.from_arrays([asked["query"].take(pa.array(who)), pa.array(ids), pa.array(score), pa.array(np.full(len(who), q.shape[1], np.int32)), *hit], ["query", "vec_id", "score", "dim", *flags])

    told = ", ".join(f"{f} boolean" for f in flags)
    best = _best(index.visit(every, answer, f"{ANSWER}, dim int, {told}"), k)
    recall = best.groupBy("dim").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags]).collect()
    return {r.dim: next((f for f, name in zip(FACTORS, flags) if r[name] >= GOAL), 1.0) for r in recall}


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = K, factor: float | None = None, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score), as often as rows have the query's id and vector.  rows, queries: as `usable` gives them."""
    index = Index(rows, shard, leaf, block)
    asked = common.stored(queries.select(F.monotonically_increasing_id().alias("query"), "id", "v", "dim", "n"), "ann-queries")
    by_dim = factors(index, asked.drop("n"), k) if factor is None else {g.dim: factor for g in index.groups}
    found, known_ = _first(index, asked.drop("n"), k)

    def open_(g: Group, kth: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return ~_home(g, kth, bound) & (bound <= reach(kth, g.top, by_dim.get(g.dim, 1.0))[:, None])

    rest = common.stored(index.targets(known_, open_), "ann-rest")
    found = _best(found.unionByName(_visited(index, rest, k, by_dim)), k)
    out = found.join(asked.select("query", F.col("id").alias("query_id"), "n"), "query")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = common.stored(usable(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "ann-rows")
    return nearest(rows, rows.where("id % 20 = 0"))
