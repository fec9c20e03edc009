"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a short vector of statistics (lengths, character-class shares, repetition), moved by log and
logit transforms towards normal shape.  Each class gets a mean and a covariance shrunk towards its own diagonal; the
Cholesky factor of each covariance is computed once and cached in the model, so that scoring needs one product with
the inverse factor a class.  The score is a logistic calibration of the difference of the two Mahalanobis
log-densities.

Edge cases: null and empty texts are documents without words and get a score like any other; null labels take no part
in fitting; where fewer than MIN_CLASS rows of a class are labelled the model falls back to the prior.  Repeated rows
get a row each.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bound of the labelled rows that a model is fitted on: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
MIN_CLASS = 8
SHRINK = 0.1

_KIND = np.full(256, 4, np.uint8)  # 0 letter, 1 capital, 2 digit, 3 white space, 4 symbol, 5 plain stop, 6 beyond ASCII
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[44, 46]] = 5
_KIND[128:] = 6

NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "capital", "digit", "symbol", "stop", "beyond", "line_length", "new_words", "new_lines", "symbol_words", "lone_symbols", "doubled_words")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, smoothed so that an absent class has a finite value."""
    p = (part + 0.5) / (whole + 1.0)
    return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))


def _distinct(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes in each document."""
    if not len(doc):
        return np.zeros(n, np.int64)
    order = np.lexsort((code, doc))
    d, c = doc[order], code[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    return np.bincount(d[first], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: one row each, columns as in NAMES."""
    n = len(off) - 1
    kind = _KIND[buf]
    size = np.diff(off).astype(float)
    of = [common.seg_sum(kind == k, off).astype(float) for k in range(7)]
    starts, ends = common.spans(kind != 3, off)
    doc = np.searchsorted(off, starts, side="right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    code = common.span_hashes(buf, starts, ends)
    fresh = _distinct(doc, code, n).astype(float)
    twice = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    doubled = np.bincount(doc[1:], twice, n) if len(doc) else np.zeros(n)
    symbol = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind == 4)])
    in_word = symbol[ends] - symbol[starts]
    odd = np.bincount(doc, in_word >= 2, n)
    lone = np.bincount(doc, in_word == ends - starts, n)
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(buf)]
    line_doc = np.searchsorted(off, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(buf)), off[line_doc + 1]) if len(line_starts) else line_starts
    lines = np.bincount(line_doc, minlength=n).astype(float)
    new_lines = _distinct(line_doc, common.span_hashes(buf, line_starts, line_ends), n).astype(float)
    cols = [np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), _share(of[1], size), _share(of[2], size), _share(of[4], size), _share(of[5], size), _share(of[6], size), np.log1p(size / np.maximum(lines, 1)), _share(words - fresh, words), _share(lines - new_lines, lines), _share(odd, words), _share(lone, words), _share(doubled, words)]
    return np.stack(cols, axis=1)


@dataclass
class Discriminant:
    """means, inverse Cholesky factors and log-determinants of the classes 0 and 1; a calibration of their difference."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    scale: float
    shift: float

    def gap(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        part = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            part.append(-0.5 * np.einsum("ij,ij->i", z, z) - 0.5 * self.logdet[k])
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.gap(x) + self.shift, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """Shrinkage covariances, their Cholesky factors, and the calibration (Newton steps of a two-parameter logistic)."""
    d = x.shape[1] if x.ndim == 2 else len(NAMES)
    n = [int((y == k).sum()) for k in (0, 1)]
    prior = (n[1] + 1) / (sum(n) + 2)
    if min(n) < MIN_CLASS:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, float(np.log(prior / (1 - prior))))
    mean, factor, logdet = [], [], []
    for k in (0, 1):
        own = x[y == k]
        cov = np.cov(own, rowvar=False)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky(cov)
        mean.append(own.mean(axis=0))
        factor.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(np.array(mean), np.array(factor), np.array(logdet), 1.0, 0.0)
    gap = np.clip(model.gap(x), -30, 30)
    a, b = 0.5, float(np.log(prior / (1 - prior)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * gap + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * gap).sum() - 1e-2 * a, (y - p).sum()])
        h = np.array([[(w * gap * gap).sum() + 1e-2, (w * gap).sum()], [(w * gap).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    return model


def training_rows(labels: DataFrame, key: str, label: str, keep, limit: int) -> DataFrame:
    """(key, y): at most `limit` labelled rows that satisfy keep, those of the smallest hashes; conflicting labels of
    one id are taken as the larger."""
    own = labels.where(keep & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
    return own.orderBy(F.xxhash64("_k"), "_k").limit(limit)


def train(docs: DataFrame, labels: DataFrame, keep, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Discriminant:
    """A model of docs' labelled rows.  keep: Column over labels, the rows that may be learnt from.

    The labelled rows are bounded by max_train, so they can be broadcast; the driver gets one short vector for each.
    """
    rows = training_rows(labels, key, label, keep, max_train)
    joined = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(rows), "_k").select("_y", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                x = statistics(*common.utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = common.mapped(joined, vectors, "y int, x array<double>").orderBy(F.xxhash64("x"), "y").limit(max_train).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(NAMES)) if got.num_rows else np.zeros((0, len(NAMES)))
    return fit(x, got.column("y").to_numpy().astype(int))


def score(docs: DataFrame, model: Discriminant, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch):
                s = model.score(statistics(*common.utf8(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return common.mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), scored, f"k {kind}, score double").withColumnRenamed("k", key)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
