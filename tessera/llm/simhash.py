"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: the text is lower-cased (A-Z), cut into words at ASCII white space, and every shingle of 4 words (repeats
included, joined by one space; the whole sequence where there are fewer) votes with its XXH64; a bit is 1 if it is set in
over half of the hashes.  A text without words has fingerprint zero, and links like any other.

Links: two fingerprints link where at most `radius` bits differ.  Both then lie within half the radius of a common
middle, so every fingerprint emits all variants within half the radius, rows shuffle on the variant, and fingerprints
that meet in a variant are at most `radius` apart.  Whoever meets in a full-width variant is linked by that alone, so
a variant's group becomes a star on its smallest member: no group is held in memory and no pairs are made in it.

A full-width ball of half radius 2 has 2,081 variants, 33 kB of shuffle for each document, an order of magnitude more
than the documents themselves.  So the ball hashing runs on two levels (`halves=True`): if at most 4 bits differ, at most 2 differ
in one 32-bit half, so each half emits its own ball of half the radius that is left to it (33 variants a half), a meeting in a
half is verified on all 64 bits, and only the members of half-variants with more than CROWD fingerprints, whose pairs
would grow with the square of the group, emit the full-width ball.  Both forms give the same components.

Edge cases: equal fingerprints collapse before anything is emitted, however many documents have them.  Null text counts
as empty.  Null ids keep their row; component_id is the smallest id that isn't null, and null if a component has none.
Repeated rows get a row each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.operators.components import component_labels

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members up to which a half-variant's group is compared pair by pair, each with the CROWD before it at most.
CROWD = 64

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    part = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        votes = np.bincount(part[:, k], minlength=256) @ _BITS
        out |= int((2 * votes > len(hashes)) @ (1 << np.arange(8))) << (8 * k)
    return out


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                own = np.array([fingerprint(t) for t in common.texts(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own)], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return common.mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), run, f"k {kind}, fp long").withColumnRenamed("k", key)


def ball(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with at most `radius` bits set."""
    masks = [0]
    level = {0}
    for _ in range(radius):
        level = {m | 1 << b for m in level for b in range(width) if not m >> b & 1}
        masks += sorted(level)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(masks: list[int]):
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def full_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect every two fingerprints of fps (distinct fp) at most `radius` bits apart, by full-width variants."""
    rows = fps.select("fp", F.explode(_masks(ball(64, radius // 2))).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    rows = rows.repartition("variant").sortWithinPartitions("variant", "fp")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = None
        for batch in batches:
            v, fp = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(v):
                continue
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            if last is not None and v[0] == last:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            heads = np.where(at >= 0, fp[np.maximum(at, 0)], 0 if head is None else head)
            last, head = v[-1], heads[-1]
            edge = heads != fp
            both = np.unique(np.stack([heads[edge], fp[edge]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return common.mapped(rows, stars, "a long, b long")


def half_links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Rows (a, b, crowded): verified edges of the half-variants of at most `crowd` members, and (fp, null, true) for
    each member of a larger one.  fps has distinct fp."""
    inner = radius // 4
    low = [m for m in ball(32, inner)]
    rows = fps.select("fp", F.explode(_masks(low)).alias("mask"))
    half = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.col("mask"))
    other = F.shiftrightunsigned("fp", 32).bitwiseXOR(F.col("mask")).bitwiseOR(F.lit(1 << 32))
    rows = rows.select("fp", F.explode(F.array(half, other)).alias("variant"))
    rows = rows.repartition("variant").sortWithinPartitions("variant", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(fp: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups; the tail group may be still growing only if it is crowded already."""
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            many = size[group] > crowd
            found = [np.zeros((0, 2), np.int64)]
            for step in range(1, int(min(crowd, size.max()))):
                same = (group[step:] == group[:-step]) & ~many[step:]
                x, y = fp[:-step][same], fp[step:][same]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
                found.append(np.stack([x[near], y[near]], axis=1))
            edges = np.unique(np.concatenate(found), axis=0)
            full = np.unique(fp[many])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(edges[:, 0], full)), pa.array(np.append(edges[:, 1], full)), pa.array(np.append(np.zeros(len(edges), bool), np.ones(len(full), bool)))], ["a", "b", "crowded"])

        v, fp, flood = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            nv, nf = (batch.column(i).to_numpy() for i in (1, 0))
            if flood is not None:  # the group at the front is known to be crowded; its members pass at once
                own = int(np.searchsorted(nv, flood, side="right"))
                if own:
                    full = np.unique(nf[:own])
                    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(full), pa.array(np.ones(len(full), bool))], ["a", "b", "crowded"])
                    nv, nf = nv[own:], nf[own:]
                if not len(nv):
                    continue
                flood = None
            v, fp = np.append(v, nv), np.append(fp, nf)
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            tail = int(np.flatnonzero(new)[-1])
            if len(v) - tail > crowd:
                flood = v[-1]
                yield from settle(fp, new)
                v, fp = v[:0], fp[:0]
            elif tail:
                yield from settle(fp[:tail], new[:tail])
                v, fp = v[tail:], fp[tail:]
        if len(v):
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            yield from settle(fp, new)

    return common.mapped(rows, meet, "a long, b long, crowded boolean")


def components(prints: DataFrame, *, key: str = "doc_id", radius: int = RADIUS, halves: bool = True, crowd: int = CROWD) -> DataFrame:
    """(fp, component_id) for every distinct fp of prints (key, fp): the smallest key of all fingerprints reachable."""
    fps = common.stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-fp")
    if halves:
        met = common.stored(half_links(fps.select("fp"), radius, crowd).distinct(), "simhash-met")
        edges = met.where("not crowded").select("a", "b").unionByName(full_links(met.where("crowded").select(F.col("a").alias("fp")).distinct(), radius))
    else:
        edges = full_links(fps.select("fp"), radius)
    labels = component_labels(edges, lambda df: common.stored(df, "simhash-cc"))
    rows = fps.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = rows.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(least, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS, halves: bool = True) -> DataFrame:
    """(key, fp, component_id) of every row of docs."""
    prints = common.stored(fingerprints(docs, key=key, text=text), "simhash-doc")
    # stored, so that the join reads plain exchanges, whose hot fingerprints are split at run time
    found = common.stored(components(prints, key=key, radius=radius, halves=halves), "simhash-components")
    return prints.join(found, "fp").select(key, "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
