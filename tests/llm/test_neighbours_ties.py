"""Ties of neighbours: many different vectors with one product go to the smaller ids."""

import numpy as np
import pytest


@pytest.mark.parametrize("low, high, dim", [(0, 2, 12), (-1, 2, 6)])
def test_ties_go_to_smaller_ids(spark, low, high, dim):
    from tessera.llm import ann

    rng = np.random.default_rng(41)
    x = rng.integers(low, high, size=(1500, dim)).astype(float)
    x[:, 0] = 1
    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = ann.nearest(own, own.where("id % 50 = 0"), factor=1.0, shard=700, leaf=16).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 1500, 50))
    for q, ids in found.items():
        score = x @ x[q]
        assert ids == [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
