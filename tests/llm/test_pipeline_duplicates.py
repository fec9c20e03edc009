"""near_duplicates of the pipeline where doc_id does not tell documents apart."""

import random

import pytest


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_one_survivor_a_component_by_row(spark, monkeypatch, broadcast):
    import corpus_pipeline as c

    monkeypatch.setattr(c, "MAX_BROADCAST_IDS", broadcast)
    rng = random.Random(31)
    a, x, y, n, m, k = (" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(6))
    # null ids with different texts; id 5 with two texts whose components are {3, 5} and {5, 9}; equal rows; a null text
    rows = [(None, n), (None, m), (None, m), (None, None), (3, a), (5, a), (5, y), (9, y), (7, x), (7, x), (8, k), (None, k)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = c.near_duplicates(spark, df, "")
    assert got.columns == c.COLUMNS
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(None, n), (None, m), (None, None), (3, a), (5, y), (7, x), (8, k)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
