"""Numerical parts against plain versions, and long texts in stretches against one piece."""

import random

import numpy as np
import pyarrow as pa
import pytest


def long_texts():
    rng = random.Random(3)
    words = [f"W{rng.randrange(4000)}é{rng.choice(['', '!', '#'])}" for _ in range(9000)]
    return [" ".join(words), "", "x" * 70_000, "\n".join(words[:50]), None, "ab " * 30_000]


@pytest.mark.parametrize("stretch", [97, 4096])
def test_stretches_change_nothing(monkeypatch, stretch):
    from tessera.llm import common, quality, toxicity

    buf, off = common.utf8(pa.array(long_texts(), pa.string()))
    whole = (quality.statistics(buf, off), toxicity.present(*toxicity.normal(buf, off), None))
    flags = np.zeros(1 << toxicity.BITS, bool)
    flags[whole[1][1][::7]] = True
    some = toxicity.present(*toxicity.normal(buf, off), flags)
    monkeypatch.setattr(common, "STRETCH", stretch)
    assert (quality.statistics(buf, off) == whole[0]).all()
    for a, b in ((toxicity.present(*toxicity.normal(buf, off), None), whole[1]), (toxicity.present(*toxicity.normal(buf, off), flags), some)):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_present_matches_sets_of_grams():
    from tessera.llm import common, toxicity

    texts = ["Abc  defgh", "", "zz", None, "ÀB\tcdefghij " * 3]
    buf, off = common.utf8(pa.array(texts, pa.string()))
    low, bounds = toxicity.normal(buf, off)
    doc, code = toxicity.present(low, bounds, None)
    for i in range(len(texts)):
        own = bytes(low[bounds[i] : bounds[i + 1]])
        grams = {own[a : a + n] for n in toxicity.N_GRAMS for a in range(len(own) - n + 1)}
        one = np.frombuffer(own, np.uint8)
        alone = toxicity.present(one, np.array([0, len(one)]), None)[1]
        assert sorted(code[doc == i]) == sorted(alone) and len(alone) <= len(grams) and bool(len(alone)) == bool(grams)


def test_discriminant_matches_plain_densities():
    from tessera.llm import quality

    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.7).astype(int)
    x = rng.normal(size=(600, 5)) @ rng.normal(size=(5, 5)) + y[:, None] * 1.5
    model = quality.fit(x, y)
    gap = np.zeros(len(x))
    for k, sign in ((1, 1), (0, -1)):
        own = x[y == k]
        cov = np.cov(own, rowvar=False)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(5)
        d = x - own.mean(axis=0)
        gap += sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.gap(x), gap)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(model.scale * gap + model.shift, -35, 35))))


def test_logistic_matches_plain_newton_steps():
    from tessera.llm import toxicity

    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(200)]
    scale = rng.uniform(0.5, 2, 12) * rng.choice([-1, 1], 12)
    x = np.zeros((200, 12))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    y = (x @ rng.normal(size=12) + rng.normal(size=200) > 0).astype(int)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, b = toxicity._logistic(bounds, np.concatenate(rows), scale, y, ridge=2.0, rounds=4000, part=64)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    full, theta = np.hstack([x, np.ones((200, 1))]), np.zeros(13)
    ridge = np.diag([2.0] * 12 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ theta))
        theta -= np.linalg.solve(full.T @ (full * (weight * p * (1 - p))[:, None]) + ridge, full.T @ (weight * (p - y)) + ridge @ theta)
    assert np.allclose(np.append(w, b), theta, atol=1e-3)
