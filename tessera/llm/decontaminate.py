"""Benchmark decontamination by winnowing.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII.  On either side the hashes of all
K-word grams are winnowed: of every WINDOW - K + 1 neighbouring grams the smallest (the rightmost of equals) is kept.  Whatever
span of WINDOW words two texts share, they keep the same gram in it, so every such span has a common
fingerprint.  Kept document grams are joined with kept benchmark grams, and each hit is extended: the
WINDOW-word windows around it are looked up among the benchmark's windows.  Items with fewer than WINDOW words are one
window of their own length, looked up at every place, since winnowing promises nothing for shorter spans.

The benchmark is the stated query set.  Up to BLOCK_WORDS words it is one index of bounded size, which is broadcast: fingerprints
meet and hits are extended within the pass over the documents, and no document is shuffled.  A larger benchmark stays a table that executors
fingerprint.  Its kept grams go into a bit filter of 2**WIDE_BITS bits, a document's windows around grams that pass it are joined
with the benchmark's windows by their hashes, and what matches is gathered by text, so equal documents are looked up once.  Both ways
give the same rows.

Edge cases: null texts have no words (as empty ones); items without words have no windows and never occur; items with
a null id are left out; an id that repeats counts once; repeated documents get a row each.  With an empty benchmark
nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

WINDOW = 8
K = 4
#: Bound of a benchmark that is broadcast, in words (about 60 bytes a word in the index).
BLOCK_WORDS = 1_000_000
FILTER_BITS = 20
#: Bits of a larger benchmark's filter, as a power of two, and of one part of it.
WIDE_BITS, PART_BITS = 26, 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_STEP = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64((1 << 64) - 1)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the offsets of each text's words."""
    starts, ends = common.spans(_WORD[buf], off)
    return common.span_hashes(_LOWER[buf], starts, ends), np.searchsorted(starts, off)


def grams(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-word gram that begins at each word, and whether it ends within its text."""
    count = len(h)
    out = np.zeros(count, np.uint64)
    for i in range(min(n, count)):
        out[: count - i] += h[i:] * _STEP[i]
    ends = np.repeat(off[1:], np.diff(off))
    return common.mixed(out + np.uint64(n)), np.arange(count) + n <= ends


def winnowed(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept K-grams and their hashes."""
    g, whole = grams(h, off, K)
    width = WINDOW - K + 1
    keep = np.zeros(len(g), bool)
    ends = np.repeat(off[1:], np.diff(off))
    first = np.flatnonzero(np.arange(len(g)) + WINDOW <= ends)
    least, at = g[first], first.copy()
    for i in range(1, width):
        other = g[first + i]
        lower = other <= least
        least, at = np.where(lower, other, least), np.where(lower, first + i, at)
    keep[at] = True
    place = np.flatnonzero(keep & whole)
    return place, g[place]


@dataclass
class Block:
    """A part of the benchmark: kept grams behind a bit filter, and windows by length with the items that have them."""

    ids: np.ndarray
    filter: np.ndarray
    kept: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def block(ids: list, texts: list[str]) -> Block:
    buf, off = common.utf8(pa.array(texts, pa.string()))
    h, woff = words(buf, off)
    size = np.diff(woff)
    names = np.array(sorted({str(i) for i in ids}), dtype=object)
    item = np.array([np.searchsorted(names, str(i)) for i in ids], np.int64)
    _, kept = winnowed(h, woff)
    kept = np.unique(kept)
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[(kept >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    of = np.repeat(np.arange(len(ids)), size)
    windows = {}
    for n in sorted({min(int(s), WINDOW) for s in size if s}):
        g, whole = grams(h, woff, n)
        pick = whole & ((size[of] >= WINDOW) if n == WINDOW else (size[of] == n))
        code, inverse = np.unique(g[pick], return_inverse=True)
        pair = np.unique(np.stack([inverse, item[of[pick]]], axis=1), axis=0)
        windows[n] = (code, np.searchsorted(pair[:, 0], np.arange(len(code) + 1)), pair[:, 1])
    return Block(names, flags, kept, windows)


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def around(h: np.ndarray, off: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The begins of the WINDOW-word windows, within one text, that hold the K-gram at any of the places, and their hashes."""
    begin = np.unique((place[:, None] - np.arange(WINDOW - K + 1)).ravel())
    begin = begin[(begin >= 0) & (begin + WINDOW <= len(h))]
    begin = begin[np.searchsorted(off, begin, side="right") == np.searchsorted(off, begin + WINDOW - 1, side="right")]
    g = np.zeros(len(begin), np.uint64)
    for i in range(WINDOW):
        g += h[begin + i] * _STEP[i]
    return begin, common.mixed(g + np.uint64(WINDOW))


def hits(h: np.ndarray, off: np.ndarray, b: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, window numbers) of the occurrences of b's windows."""
    for n, (code, _, _) in b.windows.items():
        if n == WINDOW:
            place, g = winnowed(h, off)
            near = b.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
            place, g = place[near], g[near]
            begin, g = around(h, off, place[_find(b.kept, g) >= 0])
            at = _find(code, g)
            yield n, begin[at >= 0], at[at >= 0]
        else:
            g, whole = grams(h, off, n)
            place = np.flatnonzero(whole)
            at = _find(code, g[place])
            yield n, place[at >= 0], at[at >= 0]


SCHEMA = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("items", T.StringType()))


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", bench_text: str = "text", min_items: int = 2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the columns of SCHEMA added (columns of those names are replaced): words, hit words, items with
    occurring windows, the digest of those items, whether they are min_items at least, and the items themselves."""
    docs = docs.drop(*[c for c, _ in SCHEMA])
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(bench_text), F.lit("")).alias("text")).where("item is not null")
    most = bench.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0  # no text has more words
    if most > block_words:
        return _joined(docs, bench, text, min_items)
    held = bench.collect()
    return _looked_up(docs, block([r["item"] for r in held], [r["text"] for r in held]), text, min_items)


def _looked_up(docs: DataFrame, own: Block, text: str, min_items: int) -> DataFrame:
    handle = docs.sparkSession.sparkContext.broadcast(own)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = handle.value
        for batch in batches:
            for part in common.chunks(batch, batch.schema.names[place]):
                h, off = words(*common.utf8(part.column(place)))
                depth = np.zeros(len(h) + 1, np.int64)
                found: dict[int, set[int]] = {}
                for size, begin, window in hits(h, off, b):
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + size, -1)
                    doc = np.searchsorted(off, begin, side="right") - 1
                    _, bound, items = b.windows[size]
                    for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
                        found.setdefault(d, set()).update(items[bound[w] : bound[w + 1]].tolist())
                hit = common.seg_sum(np.cumsum(depth[:-1]) > 0, off)
                own = [[b.ids[i] for i in sorted(found.get(d, ()))] for d in range(part.num_rows)]  # ids are sorted as strings
                joined = [",".join(x) for x in own]
                count = np.array([len(x) for x in own], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(off).astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(count), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]), pa.array(count >= min_items), pa.array(joined)],
                    [*part.schema.names, *[c for c, _ in SCHEMA]],
                )

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in SCHEMA]]))


def _joined(docs: DataFrame, bench: DataFrame, text: str, min_items: int) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The benchmark's windows (n words, hash, item), and its kept grams as n = 0."""
        for batch in batches:
            for part in common.chunks(batch):
                h, off = words(*common.utf8(part.column(1)))
                size = np.diff(off)
                of = np.repeat(np.arange(len(size)), size)
                names = part.column(0)
                _, kept = winnowed(h, off)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(kept), np.int32)), pa.array(kept.view(np.int64)), pa.nulls(len(kept), pa.string())], ["n", "hash", "item"])
                for n in sorted({min(int(s), WINDOW) for s in size if s}):
                    g, whole = grams(h, off, n)
                    pick = whole & ((size[of] >= WINDOW) if n == WINDOW else (size[of] == n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(pick.sum(), n, np.int32)), pa.array(g[pick].view(np.int64)), names.take(pa.array(of[pick])).cast(pa.string())], ["n", "hash", "item"])

    table = common.stored(common.mapped(bench, prints, "n int, hash long, item string").distinct(), "leak-windows")
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # at most WINDOW + 1
    bit = F.shiftrightunsigned("hash", 64 - WIDE_BITS)
    marks = table.where(F.col("n") < WINDOW).select(F.shiftrightunsigned(bit, PART_BITS).alias("part"), bit.bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("bit"), "n").distinct()

    def packed(part: pa.Table) -> pa.Table:
        flags = np.zeros(1 << PART_BITS, bool)
        flags[part.column("bit").to_numpy()] = True
        return pa.table({"n": part.column("n")[:1], "part": part.column("part")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    filters = {n: np.zeros((1 << WIDE_BITS) // 8, np.uint8) for n in lengths if n < WINDOW}
    for r in marks.groupBy("n", "part").applyInArrow(packed, "n int, part long, bits binary").toLocalIterator():
        size = (1 << PART_BITS) // 8
        filters[r["n"]][r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    handle = docs.sparkSession.sparkContext.broadcast(filters)
    place = docs.columns.index(text)

    def passes(n: int, g: np.ndarray) -> np.ndarray:
        at = (g >> np.uint64(64 - WIDE_BITS)).astype(np.int64)
        return (handle.value[n][at >> 3] >> (at & 7) & 1).astype(bool)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, begin, n, hash) of the windows that may be the benchmark's."""
        for batch in batches:
            for part in common.chunks(batch):
                h, off = words(*common.utf8(part.column(1)))
                for n in lengths:
                    if n == 0:
                        at, g = winnowed(h, off)
                        begin, g = around(h, off, at[passes(0, g)])
                        n = WINDOW
                    elif n < WINDOW:
                        g, whole = grams(h, off, n)
                        begin = np.flatnonzero(whole & passes(n, g))
                        g = g[begin]
                    else:
                        continue
                    doc = np.searchsorted(off, begin, side="right") - 1
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(begin - off[doc]), pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64))], ["_key", "begin", "n", "hash"])

    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    own = docs.select(key.alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = common.mapped(own, candidates, "_key string, begin long, n int, hash long").distinct().join(table.where("n > 0"), ["n", "hash"])
    found = common.stored(found.select("_key", "begin", "n", "item"), "leak-hits")
    hit = found.select("_key", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("q")).distinct().groupBy("_key").agg(F.count("*").alias("n_hit"))
    items = found.select("_key", "item").distinct().groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    rows = common.stored(hit.join(items, "_key"), "leak-found")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, batch.schema.names[place]):
                _, off = words(*common.utf8(part.column(place)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(off).astype(np.int64))], [*part.schema.names, "n_words"])

    out = common.mapped(docs, counted, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())])).withColumn("_key", key)
    listed = F.coalesce(F.array_join("_items", ","), F.lit(""))
    count = F.coalesce(F.size("_items"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    out = out.join(rows, "_key", "left").withColumns({"n_hit": F.coalesce("n_hit", zero), "n_items": F.when(F.col("_items").isNull(), zero).otherwise(count), "items_sha256": F.sha2(listed, 256), "items": listed})
    return out.withColumn("contaminated", F.col("n_items") >= min_items).select(*docs.columns, *[c for c, _ in SCHEMA])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return scan(docs.select("doc_id", "text"), bench).drop("text", "items")
