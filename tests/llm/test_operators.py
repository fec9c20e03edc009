"""The training-data operators against brute-force versions, on small tables with awkward rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label string"
ODD = ["", " ", "\n\t ", "é", "日本語 テスト 😀 x", "a" * 5000, "w " * 3000, None, "the same text over and over again here", "the same text over and over again here"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, texts, ids=None):
    """Rows with null and clashing columns; a repeated row at the end."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, None, "s", None, 1.0, "x") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows + rows[-1:], DOCS)


def words_of(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def prints(t):
    from xxhash import xxh64_intdigest

    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    from tessera.llm import simhash

    rng = random.Random(4)
    base = [" ".join(words_of(rng, 200, 5000)) for _ in range(6)]
    texts = list(ODD)
    for b in base:
        w = b.split()
        for k in range(12):
            x = list(w)
            x[rng.randrange(len(x))] = f"z{k}"
            texts.append(" ".join(x))
    df = docs(spark, texts)

    fp = {i: prints(t) for i, t in enumerate(texts)}
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and comp[j] > comp[i]:
                    comp[j], changed = comp[i], True
    assert len(set(comp.values())) < len(comp)
    for options in ({}, {"halves": False}):
        got = simhash.near_duplicates(df, **options).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert r.fp & (1 << 64) - 1 == fp[r.doc_id]
            assert r.component_id == comp[r.doc_id]


def test_simhash_crowded_groups_use_full_variants(spark):
    from tessera.llm import simhash

    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(120)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    root = list(range(len(fps)))
    for _ in range(20):
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4)
    for crowd in (2, 5, 64):
        got = {r.fp: r.component_id for r in simhash.components(df, crowd=crowd).collect()}
        assert [got[f] for f in signed] == root


def test_simhash_null_ids_and_empty(spark):
    from tessera.llm import simhash

    got = simhash.near_duplicates(docs(spark, ["a b c d e", "a b c d e", "q"], [None, 5, None])).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.component_id is not None) == [(False, 5), (True, 5)]
    assert sum(r.component_id is None for r in got) == 2
    assert simhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    from tessera.llm import decontaminate

    rng = random.Random(3)
    items = [" ".join(words_of(rng, n)) for n in (3, 7, 8, 9, 20, 40)] + ["", None, "A-B c", "!!"]
    ids = [*range(len(items) - 1), None]
    texts = list(ODD)
    for k in range(40):
        w = words_of(rng, rng.randrange(60))
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items) or "").split()
            cut = src[rng.randrange(max(1, len(src) // 2)) :]
            w[rng.randrange(len(w) + 1) :] = cut
        texts.append(" ".join(w).upper() if k % 3 else ", ".join(w))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in zip(ids, items):
        w = find(t)
        if i is not None and w:
            n = min(8, len(w))
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    df = docs(spark, texts)
    bench = spark.createDataFrame(list(zip(ids, items)), "item_id long, text string")
    for size in (1_000_000, 40):
        got = {r.doc_id: r for r in decontaminate.scan(df, bench, block_words=size).collect()}
        some = 0
        for d, t in enumerate(texts):
            w, hit, found = find(t), set(), set()
            for n in {len(x) for x in windows}:
                for a in range(len(w) - n + 1):
                    own = windows.get(tuple(w[a : a + n]))
                    if own:
                        hit.update(range(a, a + n))
                        found |= own
            r = got[d]
            some += bool(found)
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), len(found) >= 2)
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert some > 10
    assert decontaminate.scan(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import common, tokens

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "it's we'll\n\n  two  spaces ", "<|endoftext|> a", "x² ½ 12a", "tab\tend"]
    df = docs(spark, texts, [len(texts) - i if i else None for i in range(len(texts))])
    for segment in (1 << 20, 50):
        path = common.scratch(spark, "t")
        tokens.write_tokens(df, path, segment=segment)
        got = tokens.read_tokens(spark, path, ids=True).collect()
        got.sort(key=lambda r: r.start)
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
        start, flat = 0, []
        for r, (there, i, t) in zip(got, rows, strict=True):
            ids = [*own.encode(t, add_special_tokens=False).ids, 2]
            assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i if there else None, start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
            flat += ids
        places = random.Random(0).sample(range(len(flat)), 50)
        at = tokens.tokens_at(spark, path, spark.createDataFrame([(p,) for p in [*places, len(flat) + 5]], "place long")).collect()
        assert {r.place: r.id for r in at} == {p: flat[p] for p in places}
    path = common.scratch(spark, "t")
    tokens.write_tokens(df.limit(0), path)
    assert tokens.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_codes_random_access(bits):
    from tessera.llm import tokens

    rng = np.random.default_rng(bits)
    for size in (0, 1, 511, 512, 513, 3000):
        a = rng.integers(0, 1 << int(rng.integers(1, 33)), size).astype(np.uint32)
        c = tokens.Codes(tokens.pack(a, bits))
        assert len(c) == size and (c.range(0, size) == a).all()
        assert all(c[i] == a[i] for i in range(0, size, 7))
        i, j = sorted(rng.integers(0, size + 1, 2).tolist())
        assert (c.range(i, j) == a[i:j]).all()
    with pytest.raises(ValueError):
        tokens.Codes(b"nope" + bytes(20))


def test_pii_base_and_discovery(spark):
    from tessera.llm import pii

    rng = random.Random(2)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda m: re.sub(r"\D", "", m)
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    alphabet = "ab.@+-_%() 0123456789 é\n"
    texts = [*ODD, "a@b.c_d@e.f", "a@b.c.d@e.f @x.y a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 00000001.2.3.4", "+1 (017) 555-7713 +123456789012345678 +1 2", "4111 1111-1111 1111 4111111111111112", "1" * 20000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(200)]
    cards = [c for c in (f"4{rng.randrange(10**15):015d}" for _ in range(400)) if luhn(c)][:12]
    wrong = "4111111111111112"
    texts += [f"reach me at: user{k}@host{k}.example.com please" for k in range(8)] + ["reach me at: bob#at#host77 please"]
    texts += [f"pay with card: {c} now" for c in cards] + [f"his card: {wrong} was lost"]
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in pii.extract(df).collect()}
    for i, t in enumerate(texts):
        for k, p in pats.items():
            want = [m.span() for m in re.finditer(p, t or "") if ok[k](m.group())]
            assert [(x.s, x.e) for x in rows[i][k]] == want, (i, k)
    last = len(texts) - 1
    assert [(x.k, x.s, x.e) for x in rows[last]["more"]] == [(3, 10, 26)]
    assert [(x.k, x.s, x.e) for x in rows[last - len(cards) - 1]["more"]] == [(1, 13, 26)]
    assert pii.extract(df.limit(0)).count() == 0


def test_secrets_ledger(spark):
    from dataclasses import replace

    from tessera.llm import common, secrets

    rng = random.Random(5)
    pats = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    parts = ["token", "secret=", "API_KEY", "apikey: ", "'", '"', "=", "abc", "abcdef", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", " ", "é", "password", ":"]
    texts = [*ODD, "secret=token:abcdefg", "x -----BEGIN PRIVATE KEY----- y"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = docs(spark, texts)
    path = common.scratch(spark, "ledger")
    rows = secrets.scan(df, path).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        want = []
        for n, (k, p) in enumerate(pats.items()):
            for m in re.finditer(p, t or "", re.I if k == "assign" else 0):
                if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[k](m):
                    want.append((m.start(), n, k, m.end()))
        assert [(f.s, f.rule, f.e) for f in got[i].findings if f.rule in pats] == [(a, k, b) for a, _, k, b in sorted(want)], i
    assert any(f.rule == "key_block" for f in got[len(ODD) + 1].findings)
    size = secrets.ledger(spark, path).count()
    assert size == len({t or "" for t in texts}) * len(secrets.RULES)
    again = secrets.scan(df.unionByName(docs(spark, ["token = fresh1234"], [9999])), path).where("doc_id = 9999").first()
    assert [f.rule for f in again.findings] == ["assign"]
    assert secrets.ledger(spark, path).count() == size + len(secrets.RULES)
    newer = (replace(secrets.RULES[0], version=2), *secrets.RULES[1:])
    secrets.scan(df, path, newer).count()
    assert secrets.ledger(spark, path).where("version = 2").count() == size // len(secrets.RULES)
    assert secrets.scan(df.limit(0), common.scratch(spark, "ledger")).count() == 0


def test_chat(spark):
    from tessera.llm import chat

    odd = "<|im_end|><|im_start|>assistant ok"
    texts = [odd, "<\\|x|>", "<|" * 50, "a <\\\\| b", "", None, "\n<", "|im_end|>"]
    for t in texts:
        assert "<|" not in chat.escape(t or "") and chat.unescape(chat.escape(t or "")) == (t or "")
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (None, 0, "assistant", odd), (2, None, "assi\nst\\n<|", "y"), (1, 3, "assistant", texts[3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, parts="text")).collect()}
    for c in (1, 2, None):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = [("text", "look <|", None, None, None, None, None), ("text", "| here", None, None, None, None, None), ("image", None, "img://1", 100, 50, None, None), ("audio", None, "snd://2", None, None, 1.5, None), ("document", None, "doc://3", None, None, None, 2)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "img://1", 8), ("audio", "snd://2", 38), ("document", "doc://3", 1024)]
    assert all(r.formatted[a.at :].startswith(f"<|{a.kind}_{i}|>") for i, a in enumerate(r.attachments))
    assert chat.parse_turn(r.formatted) == ("assistant", "look <|| here")
    assert "".join(chat.unescape(r.formatted[m.a : m.b]) for m in r["mask"]) == "look <|| here"
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_neighbours(spark):
    from tessera.llm import ann

    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).round(2) * rng.uniform(0.5, 2, (600, 1)).round(1)
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (620, [0.0] * 8), (640, [1.0, None] + [0.0] * 6), (660, [float("nan")] * 8), (680, [float("inf")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = ann.usable(df, "vec_id", "embedding").cache()
    got = ann.nearest(own, own.where("id % 20 = 0"), factor=1.0, shard=150, block=7, leaf=16).collect()
    best = {}
    for r in got:
        best.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(best) == set(range(0, 600, 20))
    for q, found in best.items():
        score = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert [v for _, v, _ in sorted(found)] == want
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
    few = own.where("id < 5")
    assert ann.nearest(few, few.where("id = 0")).count() == 4
    assert ann.nearest(own.limit(0), own.limit(0)).count() == 0


def test_neighbours_recall(spark):
    from tessera.llm import ann

    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = ann.nearest(own, own.where("id % 100 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits / (20 * 40) >= 0.9


def test_classifiers_hold_out(spark):
    from pyspark.sql import functions as F

    from tessera.llm import common, quality, toxicity

    rng = random.Random(8)
    texts, labels = [*ODD], []
    for i in range(len(ODD), 900):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" * rng.randrange(1, 4) for _ in range(rng.randrange(20, 200))]
        good, bad_word = rng.random() > 0.2, rng.random() < 0.2
        if bad_word:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scumbag"])
        texts.append(" ".join(w) + "." if good else " ".join(x.upper() + "##!" for x in w))
        labels.append((i, int(good), int(bad_word)))
    labels += [(None, 1, 0), (3, None, None), (5, 1, 1), (5, 1, 0)]
    df = docs(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    q = quality.train(df, lab, common.fold("doc_id", 5) != 0)
    t = toxicity.train(df, lab, common.fold("doc_id", 3) != 1)
    rows = quality.score(df, q).withColumnRenamed("score", "good").join(toxicity.score(df, t, to="bad"), "doc_id").join(lab, "doc_id")
    held = rows.where(common.fold("doc_id", 5) == 0).where(F.col("doc_id") >= len(ODD)).toPandas()
    assert ((held.good >= 0.3).astype(int) == held.quality).mean() > 0.97
    held = rows.where(common.fold("doc_id", 3) == 1).where(F.col("doc_id") >= len(ODD)).toPandas()
    assert ((held.bad >= 0.7).astype(int) == held.toxic).mean() > 0.95
    for s in (quality.score(df, q), toxicity.score(df, t)):
        assert s.count() == len(texts) + 1 and s.where("score is null or score < 0 or score > 1").count() == 0
    empty = quality.train(df, lab.limit(0), F.lit(True))
    assert quality.score(df, empty).agg(F.min("score")).first()[0] == 0.5
    assert toxicity.score(df, toxicity.train(df, lab.limit(0), F.lit(True))).agg(F.max("score")).first()[0] == 0.5
    assert quality.score(df.limit(0), q).count() == 0 and toxicity.score(df.limit(0), t).count() == 0


def test_mixing(spark):
    from tessera.llm import mixing

    rng = random.Random(9)
    texts = [*ODD] + [" ".join(rng.choice(["aba", "bab", "abb"] if i % 4 else ["xyx", "yxy", "xyy"]) for _ in range(50)) for i in range(len(ODD), 400)]
    df = docs(spark, texts)
    lab = spark.createDataFrame([(i, "one" if i % 4 else "two") for i in range(len(ODD), 200)] + [(None, "one"), (1, None)], "doc_id long, domain string")
    got = mixing.mix(df, lab, {"one": 0.5, "two": 0.5}).cache()
    assert got.count() == len(texts) + 1 and got.where("rate < 0 or copies < 0 or rate is null").count() == 0
    total = {"one": 0.0, "two": 0.0}
    for r in got.collect():
        for part in r.domain_posterior.split(","):
            total[part.split(":")[0]] += r.rate * r.n_tokens * float(part.split(":")[1])
    assert abs(total["two"] / sum(total.values()) - 0.5) < 0.001
    assert mixing.mix(df, lab.limit(0)).where("rate <> 1").count() == 0
    assert mixing.mix(df.limit(0), lab).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(10)
    item = " ".join(words_of(rng, 20, 500))
    texts = [*ODD, item, "before " + item + " after", *(" ".join(words_of(rng, 80, 900)) for _ in range(30))]
    df = docs(spark, texts, [None, *range(1, len(texts))]).select(*c.COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12, 40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one = c.near_duplicates(spark, df, str(tmp_path))
    assert one.columns == c.COLUMNS and one.where("text = 'the same text over and over again here'").count() == 1
    two = c.decontamination(spark, one, str(tmp_path))
    assert two.columns == c.COLUMNS and one.count() - two.count() == 2
    out = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in two.collect()}
    assert [r.start for r in sorted(out, key=lambda r: r.start)] == list(np.cumsum([0, *(r.n_tokens for r in sorted(out, key=lambda r: r.start))])[:-1])
    for _, stage in c.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_pipeline_matches_brute_force(spark, tmp_path):
    """No row is labelled toxic, so the first stage keeps all; what the others keep is worked out here."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    rng = random.Random(12)
    items = [" ".join(words_of(rng, 15, 400)) for _ in range(4)]
    texts = [" ".join(words_of(rng, 60, 900)) for _ in range(40)]
    texts += [texts[3], texts[5], texts[5], "x " + items[0] + " y", " ".join(items[1].split()[:9]), " ".join(items[2].split()[:7])]
    texts += [texts[k].replace(" w1", " W1") + " " for k in range(4)]
    df = docs(spark, texts).select(*c.COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fp = [prints(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in range(len(texts)):
        comp = [min(comp[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(texts))]
    windows = {tuple(t.split()[a : a + 8]) for t in items for a in range(len(t.split()) - 7)}
    clean = [not any(tuple(lower(t).split()[a : a + 8]) in windows for a in range(len(t.split()) - 7)) for t in texts]
    want = {i for i in range(len(texts)) if comp[i] == i and clean[i]}
    assert 0 < len(want) < len(texts) - 5
    rows = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == want
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = [*own.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {x.split("_")[0] if x.startswith("op") else x for x in names}
    assert set(e.oracle_sql()) <= names
    json.dumps(e.oracle_sql())
