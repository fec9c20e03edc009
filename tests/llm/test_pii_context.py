"""Discovery next to other tokens with digits, and of identifiers in several groups."""


def test_context_of_unknowns_is_the_text_before(spark):
    from tessera.llm import pii

    texts = [f"row 17 user{k}@host{k}.example.com end" for k in range(16)] + ["row 17 bob#at#host77 end", "17 row 17 bob#at#host78 end"]
    texts += [f"seen 4 times by u{k}@h{k}.example.org now" for k in range(8)] + ["x1 seen 4 times by eve#at#h9 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    more = {r.doc_id: [texts[r.doc_id][x.s : x.e] for x in r["more"]] for r in pii.extract(df).collect()}
    assert more[16] == ["bob#at#host77"] and more[17] == ["bob#at#host78"] and more[26] == ["eve#at#h9"]


def test_identifiers_in_groups_are_discovered(spark):
    from tessera.llm import pii

    good = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2220", "3000 0000 0000 04", "6011 0000 0000 0004", "5105 1051 0510 5100", "5555 5555 5555 4444"]
    texts = [f"pay with card: {c} now" for c in good] + ["pay with card: 4111 1111 1111 1112 now", "call 12 or 1234 5678 90 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.extract(df).collect()}
    assert sum(len(rows[k]["card"]) for k in range(8)) >= 6
    assert [(x.k, texts[8][x.s : x.e]) for x in rows[8]["more"]] == [(3, "4111 1111 1111 1112")]
    assert not rows[9]["more"]
