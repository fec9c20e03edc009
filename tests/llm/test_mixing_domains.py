"""More domains than are kept apart: named ones stay, the rest is pooled."""


def test_named_domains_stay_and_the_rest_is_pooled(spark, monkeypatch):
    from tessera.llm import mixing

    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    many = {"a": 40, "b": 30, "c": 20, "d": 10, "rare": 5}
    rows = [(d, f"{d}{d}z " * 30) for d, n in many.items() for _ in range(n)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "doc_id long, domain string, text string")
    lab = df.select("doc_id", "domain")
    model = mixing.train(df.drop("domain"), lab, named=["rare"])
    assert model.names == [mixing.POOL, "a", "b", "rare"]
    got = mixing.mix(df.drop("domain"), lab, {"a": 0.5, "rare": 0.5}).join(lab, "doc_id").groupBy("domain").agg({"rate": "avg"}).collect()
    rate = {r[0]: r[1] for r in got}
    assert abs(rate["rare"] - 8) < 0.5 and abs(rate["a"] - 1) < 0.1
