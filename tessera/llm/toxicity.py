"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z and the capitals from U+00C0 to U+00DE) and runs of white space become one space, with a space at either end.  Every n-gram of
N_GRAMS bytes falls into one of 2**BITS buckets.  Presence of a bucket in a document is its feature.  Over the labelled
rows each bucket gets the log ratio of its smoothed document shares in the two classes; the FEATURES buckets whose ratio
lies most standard errors from 0 stay, and a logistic regression is fitted on presence times ratio.  Scoring looks the product of ratio and weight up for each n-gram of the whole text and
counts each bucket once a document.

Edge cases: null and empty texts hold no n-gram and get the intercept's score; null labels are not learnt from; where
a class has no labelled row the score is the smoothed prior.  Repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.quality import training_rows

#: Bound of the labelled rows that a model is fitted on: those with the smallest hashes of their ids.
MAX_TRAIN = 6_000
N_GRAMS = (4, 6, 8)
BITS = 20
FEATURES = 10_000
MIN_DOCS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with single spaces and a space before and after each."""
    n = len(off) - 1
    low = np.full(len(buf) + 2 * n, 32, np.uint8)
    place = np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    low[place] = _LOWER[buf]
    wide = np.zeros(len(buf), bool)  # the second bytes of U+00C0 to U+00DE without U+00D7
    wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[place[wide]] += 32
    bound = off + 2 * np.arange(n + 1)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[bound[:-1]] = True
    return low[keep], np.concatenate([[0], np.cumsum(common.seg_sum(keep, bound))])


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams that lie within one text, and their buckets."""
    last = len(buf) - n + 1
    if last <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(last, np.uint64)
    for i in range(n):
        code = (code << np.uint64(8)) | buf[i : i + last].astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(last, bool)
    for b in off[1:-1]:
        inside[max(0, b - n + 1) : b] = False
    return np.flatnonzero(inside), (code[inside] >> np.uint64(64 - BITS)).astype(np.int64)


def present(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, each once.  wanted: a flag for each bucket, or None for all."""
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(buf), common.STRETCH):  # long texts in stretches, each with the bytes that its last grams need
        b = min(len(buf), a + common.STRETCH + max(N_GRAMS) - 1)
        own = np.concatenate([[a], off[np.searchsorted(off, a, side="right") : np.searchsorted(off, b, side="left")], [b]]) - a
        both = []
        for n in N_GRAMS:
            place, code = grams(buf[a:b], own, n)
            here = place < common.STRETCH
            if wanted is not None:
                here &= wanted[code]
            both.append(((np.searchsorted(off, place[here] + a, side="right") - 1) << BITS) | code[here])
        found.append(np.unique(np.concatenate(both)))
    every = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
    return every >> BITS, every & ((1 << BITS) - 1)


@dataclass
class Linear:
    """The chosen buckets (sorted), their weights (ratio times coefficient) and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    shift: float

    def score(self, buf: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        doc, code = present(*normal(buf, off), wanted)
        total = np.bincount(doc, self.weight[np.searchsorted(self.bucket, code)], len(off) - 1) if len(doc) else np.zeros(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.shift, -35, 35)))

    def wanted(self) -> np.ndarray:
        flags = np.zeros(1 << BITS, bool)
        flags[self.bucket] = True
        return flags


def _logistic(bounds: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 300, part: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; both classes weigh the same.

    Row i has the columns cols[bounds[i]:bounds[i + 1]], each with the column's scale as its value.  The rows are worked
    through in parts of about `part` entries, so besides the entries' column numbers little is held."""
    n, width = len(y), len(scale)
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + part, side="right")) - 1))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n

    def rows(per_column: np.ndarray) -> np.ndarray:
        return np.concatenate([common.seg_sum(per_column[cols[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]) for a, b in zip(cuts, cuts[1:])])

    def columns(per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a, b in zip(cuts, cuts[1:]):
            out += np.bincount(cols[bounds[a] : bounds[b]], np.repeat(per_row[a:b], np.diff(bounds[a : b + 1])), width)
        return out

    step = 1.0 / (0.25 * (weight * (rows(scale**2) + 1)).sum() / n + ridge / n)
    w, b = np.zeros(width), 0.0
    v, c, at = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows(scale * v) + c, -35, 35)))
        e = weight * (p - y) / n
        new_w = v - step * (scale * columns(e) + ridge / n * v)
        new_b = c - step * e.sum()
        nxt = (1 + np.sqrt(1 + 4 * at * at)) / 2
        v, c = new_w + (at - 1) / nxt * (new_w - w), new_b + (at - 1) / nxt * (new_b - b)
        w, b, at = new_w, new_b, nxt
    return w, b


def train(docs: DataFrame, labels: DataFrame, keep, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, features: int = FEATURES) -> Linear:
    """A model of docs' labelled rows.  keep: Column over labels, the rows that may be learnt from.

    The driver gets one row for each bucket (at most 2**BITS) and the chosen buckets of at most max_train documents.
    """
    rows = training_rows(labels, key, label, keep, max_train)
    own = common.stored(docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(rows), "_k").select("_y", "text"), "toxicity-train")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            for part in common.chunks(batch):
                y = part.column(0).to_numpy(zero_copy_only=False)
                doc, code = present(*normal(*common.utf8(part.column(1))), None)
                for k in (0, 1):
                    sums[k] += np.bincount(code[y[doc] == k], minlength=1 << BITS)
                    seen[k] += (y == k).sum()
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[0][some], seen[0])), pa.array(np.append(sums[1][some], seen[1]))], ["bucket", "n0", "n1"])

    table = common.stored(common.mapped(own, counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity-counts")
    n = [int(x or 0) for x in table.where("bucket < 0").agg(F.sum("n0"), F.sum("n1")).first()]
    log_ratio = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    rated = table.where(f"bucket >= 0 and n0 + n1 >= {MIN_DOCS}").withColumn("ratio", log_ratio).select("bucket", "ratio", (F.abs("ratio") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))).alias("sure"))
    best = rated.orderBy(F.desc("sure"), "bucket").limit(features).toArrow()
    sure = best.column("sure").to_numpy()
    if not min(n) or not len(sure):
        p = (n[1] + 1) / (sum(n) + 2)
        return Linear(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    bucket, ratio = best.column("bucket").to_numpy(), best.column("ratio").to_numpy()
    order = np.argsort(bucket)
    bucket, ratio = bucket[order], ratio[order]
    wanted = np.zeros(1 << BITS, bool)
    wanted[bucket] = True

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                doc, code = present(*normal(*common.utf8(part.column(1))), wanted)
                at = np.searchsorted(bucket, code).astype(np.int32)
                lists = np.split(at, np.searchsorted(doc, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32()))], ["y", "at"])

    sample = common.mapped(own, chosen, "y int, at array<int>").orderBy(F.xxhash64("at"), "y").limit(max_train).toArrow()  # repeated ids have more rows than labels
    lists = sample.column("at").combine_chunks()
    y = sample.column("y").to_numpy().astype(int)
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    w, b = _logistic(bounds, lists.flatten().to_numpy(), ratio, y)
    return Linear(bucket, w * ratio, float(b))


def score(docs: DataFrame, model: Linear, *, text: str = "text", to: str = "score") -> DataFrame:
    """docs with one more column, the score; all rows and columns stay.  A column of the new one's name is replaced."""
    wanted = model.wanted()
    docs = docs.drop(to)
    place = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, batch.schema.names[place]):
                s = model.score(*common.utf8(part.column(place)), wanted)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, to])

    return common.mapped(docs, scored, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.fold("doc_id", 3) != 1)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
