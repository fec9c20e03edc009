"""Rates of mixing where a domain is far below its target."""

import warnings

import pytest


def pure(spark, sizes):
    rows = [(10, [float(j == k) for j in range(len(sizes))]) for k, n in enumerate(sizes) for _ in range(n)]
    return spark.createDataFrame(rows, "n_tokens long, posterior array<double>").cache()


def totals(table, rate, k):
    from pyspark.sql import functions as F

    r = rate(F.col("n_tokens"), F.col("posterior"))
    got = table.agg(*[F.sum(r * F.col("n_tokens") * F.element_at("posterior", j + 1)) for j in range(k)]).first()
    return [x / sum(got) for x in got]


@pytest.mark.parametrize("sizes", [(97, 1, 1, 1), (1997, 1, 1, 1)])
def test_rates_beyond_sixteen_reach_the_targets(spark, sizes):
    from tessera.llm import mixing

    table, targets = pure(spark, sizes), {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rate = mixing.fit_rates(table, list(targets), targets, least=1.0)
    assert totals(table, rate, 4) == pytest.approx(list(targets.values()), rel=1e-3)
    assert max(map(abs, rate.gaps.values())) < 1e-4


def test_gaps_that_stay_are_reported(spark):
    from tessera.llm import mixing

    table = pure(spark, (97, 1, 1, 1))
    with pytest.warns(UserWarning, match="'de'.*'fr'"):
        rate = mixing.fit_rates(table, ["en", "de", "fr", "es"], {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, most=16.0)
    assert rate.gaps["de"] < -0.5
    with pytest.warns(UserWarning, match="'nl': -1"):
        mixing.fit_rates(table, ["en", "de", "fr", "es"], {"en": 0.5, "nl": 0.5})


def test_soft_posteriors_reach_the_targets(spark):
    from tessera.llm import mixing

    rows = [(10, [0.9, 0.1]) for _ in range(98)] + [(10, [0.2, 0.8]), (10, [0.05, 0.95])]
    table = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").cache()
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rate = mixing.fit_rates(table, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert totals(table, rate, 2) == pytest.approx([0.5, 0.5], rel=1e-3)
