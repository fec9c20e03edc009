"""Mixing sources to target weights with soft domain membership.

A classifier learnt from a labelled table (naive Bayes over byte pairs, its evidence tempered to EVIDENCE pairs) gives every
document a posterior over the domains.  Rates then minimise the squares of the gaps between expected domain totals, sum
over documents of rate x tokens x posterior, and the targets, over rates of `least` or more, by projected
gradient steps in the metric of the documents' token counts.  A gap's square is divided by what the domain had, so its
step is its gap by that total: a pure domain is there in one step however rare it is, and no step goes too far.  A step needs only one gap for each domain, so it is one
distributed aggregation of the stored posteriors; the rates are never collected.  The projection is lazy: the steps add up
in one number for each domain, and a rate is 1 less their sum weighted by its posterior, cut to its bounds, so a round's
plan doesn't grow.  A rate becomes floor(rate) copies
and one more with the probability of the rest, drawn by a hash of the id.

The targets are shares; the total that they are shares of is the least at which no domain would have to shrink, so a
corpus is filled up rather than thinned out.  Rates have no upper bound unless `most` gives one.  Steps go on until all relative
gaps are below `tol`; gaps that stay (rounds used up, or no rates that could close them) and targets without documents
are reported by a warning and in the fitted function's `gaps`.

Edge cases: null and empty texts have no tokens and flat posteriors; unlabelled rows and null labels aren't learnt from; domains
beyond the targets' keys keep target zero only if they never occur among the labels; with no usable label every rate
is 1.  Repeated rows get the same rate.  An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.toxicity import _LOWER

#: Bound of the labelled rows that the classifier is fitted on, those with the smallest hashes of their ids.
MAX_TRAIN = 5_000
#: Bound of the number of domains that the targets don't name: the most common ones; the rest of the labels is the domain POOL.
MAX_DOMAINS = 64
POOL = "(other)"
EVIDENCE = 40.0
ROUNDS = 200
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


@dataclass
class Domains:
    """Names, log shares of byte pairs (65,536 x domains) and log priors."""

    names: list[str]
    log_pair: np.ndarray
    log_prior: np.ndarray

    def posterior(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        pair, inside = _pairs(buf, off)
        n = common.seg_sum(inside, off).astype(float)
        out = np.tile(self.log_prior, (len(off) - 1, 1))
        for k in range(len(self.names)):
            own = np.where(inside, self.log_pair[pair, k], 0.0)
            out[:, k] += common.seg_sum(own, off) / np.maximum(n, 1) * np.minimum(n, EVIDENCE)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def _pairs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte pair that begins at each place, and whether it lies within one text."""
    low = _LOWER[buf].astype(np.int32)
    pair = np.zeros(len(buf), np.int32)
    pair[:-1] = low[:-1] * 256 + low[1:]
    inside = np.ones(len(buf), bool)
    last = off[1:] - 1
    inside[last[(last >= 0) & (np.diff(off) > 0)]] = False
    return pair, inside


def train(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", domain: str = "domain", max_train: int = MAX_TRAIN, named: Iterable[str] = ()) -> Domains:
    """A classifier from labelled (key, domain); an id with several domains counts for the smallest.  Domains in `named` are never pooled."""
    rows = labelled.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(domain).alias("_d"))
    rows = rows.orderBy(F.xxhash64("_k"), "_k").limit(max_train)
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(rows), "_k").select("_d", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.chunks(batch):
                names = part.column(0).to_pylist()
                buf, off = common.utf8(part.column(1))
                pair, inside = _pairs(buf, off)
                of = np.repeat(np.arange(len(names)), np.diff(off))
                for d in sorted(set(names)):
                    mine = np.array([x == d for x in names])[of] & inside
                    sums[d] = sums.get(d, 0) + np.append(np.bincount(pair[mine], minlength=1 << 16), sum(x == d for x in names))
        for d, v in sums.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some)), pa.array(some), pa.array(v[some])], ["d", "pair", "n"])

    got = common.mapped(own, count, "d string, pair long, n long").groupBy("d", "pair").agg(F.sum("n").alias("n"))
    top = got.where(f"pair = {1 << 16}").where(~F.col("d").isin(list(named))).orderBy(F.desc("n"), "d").limit(MAX_DOMAINS)
    own = got.join(F.broadcast(top.select("d", F.lit(True).alias("own"))), "d", "left")
    pooled = F.when(F.col("own") | F.col("d").isin(list(named)), F.col("d")).otherwise(POOL)
    got = own.groupBy(pooled.alias("d"), "pair").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(set(got["d"]))
    if not names:
        return Domains(["all"], np.zeros((1 << 16, 1)), np.zeros(1))
    table, prior = np.full((1 << 16, len(names)), 0.05), np.ones(len(names))
    for k, d in enumerate(names):
        mine = got[got["d"] == d]
        pair, n = mine["pair"].to_numpy(), mine["n"].to_numpy()
        table[pair[pair < 1 << 16], k] += n[pair < 1 << 16]
        prior[k] += n[pair == 1 << 16].sum()
    return Domains(names, np.log(table / table.sum(axis=0)), np.log(prior / prior.sum()))


EXTRA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])


def posteriors(docs: DataFrame, model: Domains, *, text: str = "text", to: str = "_mix") -> DataFrame:
    """docs with a struct column `to`: n_tokens (words between white space) and posterior, in the order of model.names."""
    docs = docs.drop(to)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, batch.schema.names[place]):
                buf, off = common.utf8(part.column(place))
                starts, _ = common.spans(_LOWER[buf] != 32, off)
                n = np.diff(np.searchsorted(starts, off)).astype(np.int64)
                p = model.posterior(buf, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays([pa.array(n), flat], ["n_tokens", "posterior"])], [*part.schema.names, to])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(to, EXTRA)]))


def fit_rates(table: DataFrame, names: list[str], targets: dict[str, float], *, least: float = 0.0, most: float | None = None, rounds: int = ROUNDS, tol: float = 1e-4):
    """A function of the columns (n_tokens, posterior) that gives the rate; its `gaps`: the relative gap left for each target.  table has these two columns and is stored."""
    weight = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    weight = weight / weight.sum() if weight.sum() > 0 else np.full(len(names), 1 / len(names))
    p = [F.element_at("posterior", k + 1) for k in range(len(names))]

    def totals(rate: Column) -> np.ndarray:
        row = table.agg(*[F.sum(rate * F.col("n_tokens") * p[k]).alias(f"s{k}") for k in range(len(names))]).first()
        return np.array([x or 0.0 for x in row])

    have = totals(F.lit(1.0))
    used = (weight > 0) & (have > 0)
    left = {n: -1.0 for n, w in targets.items() if w > 0 and not any(used[k] for k in range(len(names)) if names[k] == n)}
    if not used.any():
        return _reported(lambda n, posterior: F.lit(1.0), left, tol)
    goal = np.where(used, weight * (have[used] / weight[used]).max(), 1.0)
    step = np.where(used, goal / np.where(used, have, 1.0), 0.0)
    moved = np.zeros(len(names))

    def rate(posterior: Column) -> Column:
        r = F.lit(1.0)
        for k in range(len(names)):
            r = r - F.element_at(posterior, k + 1) * F.lit(float(moved[k]))
        r = F.greatest(F.lit(least), r)
        return r if most is None else F.least(F.lit(float(most)), r)

    gap = np.where(used, have / goal - 1, 0.0)
    for _ in range(rounds if np.abs(gap).max() >= tol else 0):
        moved += step * gap
        new = np.where(used, totals(rate(F.col("posterior"))) / goal - 1, 0.0)
        small = np.abs(new).max() < tol or np.abs(new - gap).max() < tol / 100
        gap = new
        if small:
            break
    return _reported(lambda n, posterior: rate(posterior), left | {names[k]: float(gap[k]) for k in np.flatnonzero(used)}, tol)


def _reported(rate, gaps: dict[str, float], tol: float):
    open_ = {n: round(g, 6) for n, g in gaps.items() if abs(g) >= tol}
    if open_:
        warnings.warn(f"mixing: relative gaps to the targets that are left: {open_}", stacklevel=3)
    rate.gaps = gaps
    return rate


def copies(rate: Column, key: Column) -> Column:
    """Whole copies for a rate: its floor, and one more with the probability of the rest by a hash of the key."""
    draw = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, *, key: str = "doc_id", text: str = "text", domain: str = "domain", least: float = 0.0, most: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, domain_posterior (name:share of each domain), rate and copies added (such columns are replaced).

    carry: the columns of docs that are wanted, all if None.  The posteriors are worked out once: the rows are stored with them, and the
    fit reads that column alone."""
    model = train(docs, labelled, key=key, text=text, domain=domain, named=targets or TARGETS)
    docs = docs.drop("n_tokens", "domain_posterior", "rate", "copies")
    scored = posteriors(docs, model, text=text)
    scored = common.stored(scored if carry is None else scored.select(*carry, "_mix"), "mixing")
    rate = fit_rates(scored.select("_mix.n_tokens", "_mix.posterior"), model.names, targets or TARGETS, least=least, most=most)
    shares = F.concat_ws(",", *[F.concat(F.lit(f"{n}:"), F.element_at("_mix.posterior", k + 1).cast("string")) for k, n in enumerate(model.names)])
    scored = scored.withColumn("rate", rate(F.col("_mix.n_tokens"), F.col("_mix.posterior")))
    return scored.withColumns({"n_tokens": F.col("_mix.n_tokens"), "domain_posterior": shares, "copies": copies(F.col("rate"), F.col(key))}).drop("_mix")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose language is trusted: those of the labelled table."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return mix(docs, labelled_languages(docs, labels), carry=["doc_id", "source"]).select("doc_id", "source", "n_tokens", "domain_posterior", "rate", "copies")
