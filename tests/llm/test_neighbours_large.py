"""Neighbours over top trees, several powers of two, repeated ids and numbers near the range of doubles."""

import numpy as np
import pytest


def found(spark, rows, **options):
    from tessera.llm import ann

    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    out = {}
    for r in sorted(ann.nearest(own, own.where("id % 20 = 0"), **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def brute(x, q):
    score = x @ x[q]
    return [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]


@pytest.mark.parametrize("kind", ["clusters", "norms", "one long", "lattice"])
def test_factor_one_is_exact(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(9, 6)), 100, axis=0) + 0.05 * x
    if kind == "norms":
        x *= 10 ** rng.uniform(-3, 9, (900, 1))
    if kind == "one long":
        x[77] *= 1e6
    if kind == "lattice":
        x = rng.integers(-1, 2, (900, 6)).astype(float)
        x[:, 0] = 1
    got = found(spark, enumerate(x), factor=1.0, shard=60, leaf=8, block=16)
    assert set(got) == set(range(0, 900, 20))
    for q, own in got.items():
        assert [i for i, _ in own] == brute(x, q)
        assert all(s == pytest.approx(float(x[q] @ x[i]), rel=1e-12, abs=1e-300) for i, s in own)


def test_numbers_near_the_range_of_doubles(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 4))
    x[3, 0], x[4] = 1e160, x[4] * 1e-160
    got = found(spark, enumerate(x), factor=1.0, shard=30, leaf=8)
    assert set(got) == {0, 20, 40, 60, 80} and all([i for i, _ in own] == brute(x, q) for q, own in got.items())


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3))
    rows = [*enumerate(x), (20, x[5]), (20, x[20]), (7, x[7] * 2)]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    from tessera.llm import ann

    own = ann.usable(spark.createDataFrame([(int(i), v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = ann.nearest(own, own.where("id % 20 = 0"), factor=1.0, shard=16, leaf=4).collect()
    assert len(got) == 20 * (3 + 2)  # ids 0, 20 and 40, and two more rows of id 20
    want = []
    for r in np.flatnonzero(ids % 20 == 0):
        score = every @ every[r]
        want += [(int(ids[r]), k + 1, int(ids[c])) for k, c in enumerate([c for c in np.lexsort((ids, -score)) if c != r][:20])]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)


def test_recall_over_several_leaves(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(64, 32)), 64, axis=0) + 0.4 * rng.normal(size=(4096, 32))
    x *= np.exp(0.5 * rng.normal(size=(4096, 1)))
    got = found(spark, enumerate(x), shard=256, leaf=32)
    hits = sum(len({i for i, _ in own} & set(brute(x, q))) for q, own in got.items())
    assert len(got) == 205 and hits / (20 * len(got)) >= 0.95
