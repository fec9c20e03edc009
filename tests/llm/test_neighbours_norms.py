"""Recall of neighbours, by the default factor, on vectors of unequal norms."""

import numpy as np
import pytest


@pytest.mark.parametrize("sigma", [0.1, 0.3])
def test_recall_with_unequal_norms(spark, sigma):
    from tessera.llm import ann

    rng = np.random.default_rng(42)
    x = rng.normal(size=(8000, 64))
    x *= (np.exp(sigma * rng.normal(size=8000)) / np.linalg.norm(x, axis=1))[:, None]
    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = ann.nearest(own, own.where("id % 80 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits / (20 * 100) >= 0.97
