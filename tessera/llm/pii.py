"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds: four kinds of entities found by pattern and checked (email, ip, card with Luhn, phone), leftmost and
non-overlapping for each kind; a match that fails its check is dropped and not retried.

Bootstrapping: every seed, every other token with a digit or @ and every run of two or more groups of digits, of MIN_LENGTH
characters or more, is a mention of an instance (its lower-cased text) in two lexical patterns: the two tokens before it in the
text, whatever they are, and the token before it with its shape (each digit 0, each run of letters a).  A token that begins a
run leaves the first pattern to the run.  The graph of patterns and instances is scored in rounds, by kind: a pattern's confidence is
the share of its mentions, one unknown mention added, that known instances account for; an instance that is no seed
scores the mean confidence of the patterns that it occurs in.  Patterns of CONFIDENCE or more that at
least MIN_SEEDS different seeds support then discover the tokens that occur in them.  Seeds always stay; a discovered span never overlaps
one, gives way to a discovered run around it, and takes the kind of the most confident pattern.

Everything up to the mentions is one projection without a shuffle.  The graph is aggregated before it is shuffled, so a
common pattern or a text with thousands of copies is one row a task.

Everything within a text is linear in its matches, but for sorting.  A token longer than CONTEXT characters is nobody's context.

Positions count code points.  Null texts count as empty; repeated rows get a row each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common

KINDS = ("email", "ip", "card", "phone")
MIN_LENGTH = 6
MIN_SEEDS = 3
CONFIDENCE = 0.8
ROUNDS = 3
#: How far back a mention's context is looked for: characters, and matches of the same pattern.
CONTEXT = 160
BACK = 4
#: Numbers that a fold over an array collects before it starts a new block.
BLOCK = 256

# Possessive loops match as greedy ones do where nothing follows that they could give back to, and neither recurse nor
# backtrack on long runs; a run is tried at its start only, or where the match before it has ended.
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_GROUP = r"[+(]*+[0-9][0-9().-]*+(?!\S)"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "other": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
    "run": rf"(?<!\S){_GROUP}(?: {_GROUP})++",
}

SPAN = "array<struct<s:bigint,e:bigint,before:string,txt:string>>"


_names = itertools.count()


def _name() -> str:
    """A name that no other lambda has."""
    return f"v{next(_names)}"


def _luhn(digits: str) -> str:
    """Whether the digits' Luhn sum, from the right, every second one doubled, is divisible by 10."""
    own = "a.total + cast(if(a.place % 2 = 1, translate(x, '0123456789', '0246813579'), x) as int)"
    return f"aggregate(split(reverse({digits}), ''), named_struct('total', 0, 'place', 0), (a, x) -> named_struct('total', {own}, 'place', a.place + 1), a -> a.total % 10 = 0)"


def _valid(kind: str, m: str) -> str:
    """The condition on a match m, all as SQL."""
    if kind == "ip":
        return rf"rlike({m}, r'^{_BYTE}(?:\.{_BYTE}){{3}}$')"
    if kind == "card":
        digits = f"regexp_replace({m}, '[ -]', '')"
        return f"case when length({digits}) between 13 and 19 then {_luhn(digits)} else false end"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15"
    return "true" if kind == "email" else f"length({m}) >= {MIN_LENGTH}"


# The expressions within a text are SQL: as nested lambdas they are parsed at once, where thousands of calls would build them.


def let(value: str, body: Callable[[str], str]) -> str:
    """body(name of value), with the value worked out once however often body uses it, within lambdas too."""
    name = _name()
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def before_each(values: str, zero: str, fold: Callable[[str, str], str]) -> str:
    """For each of an array's numbers the fold of zero and all numbers before it.

    An array that grows in a fold is copied at every step, so the fold runs in blocks: the blocks' own folds first, then from one
    block's start to the next, then within each block.  The copies stay near n x BLOCK / 2 + (n / BLOCK)^2 / 2 numbers."""

    def exclusive(own: str, start: str) -> str:
        c, x = _name(), _name()
        return f"aggregate({own}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), ({c}, {x}) -> named_struct('at', {fold(f'{c}.at', x)}, 'out', concat({c}.out, array({c}.at))), {c} -> {c}.out)"

    def whole(own: str) -> str:
        b, y, o, z, t = (_name() for _ in range(5))
        blocks = f"transform(sequence(0, greatest(0, cast(ceil(size({own}) / {BLOCK}) as int) - 1)), {b} -> slice({own}, {b} * {BLOCK} + 1, {BLOCK}))"
        sums = lambda k: f"transform({k}, {y} -> aggregate({y}, {zero}, ({z}, {t}) -> {fold(z, t)}))"
        return let(blocks, lambda k: f"flatten(zip_with({k}, {exclusive(sums(k), zero)}, ({y}, {o}) -> {exclusive(y, o)}))")

    return let(values, whole)


def matches(text: str, pattern: str, kind: str) -> str:
    """All matches that are valid, with start and end in code points and the text before, earlier matches included: its last
    CONTEXT characters, as far back as BACK matches, without a token that is cut by either bound."""
    parts = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, m) -> named_struct('gap', cast(length(g) as bigint), 'before', right(g, {CONTEXT}), 'm', m))"

    def spans(own: str) -> str:
        at = before_each(f"transform({own}, x -> x.gap + coalesce(length(x.m), 0))", "0L", lambda a, b: f"{a} + {b}")
        piece = f"transform({own}, x -> named_struct('text', right(concat(x.before, coalesce(right(x.m, {CONTEXT}), '')), {CONTEXT}), 'n', x.gap + coalesce(length(x.m), 0)))"

        def span(at: str, piece: str) -> str:
            seen = ", ".join(f"coalesce(get({piece}, i - {k}).text, '')" for k in range(BACK, 0, -1))
            reach = " + ".join(f"coalesce(get({piece}, i - {k}).n, 0L)" for k in range(1, BACK + 1))
            one = f"named_struct('s', get({at}, i) + x.gap, 'e', get({at}, i) + x.gap + coalesce(length(x.m), 0), 'seen', right(concat({seen}, x.before), {CONTEXT}), 'reach', least({CONTEXT}L, {reach} + x.gap), 'txt', x.m)"
            kept = f"filter(transform({own}, (x, i) -> {one}), y -> y.txt is not null and {_valid(kind, 'y.txt')})"
            before = r"if(y.reach < y.s, regexp_replace(y.seen, r'^\S+', ''), y.seen)"
            return f"cast(transform({kept}, y -> named_struct('s', y.s, 'e', y.e, 'before', {before}, 'txt', y.txt)) as {SPAN})"

        return let(at, lambda at: let(piece, lambda piece: span(at, piece)))

    return let(parts, spans)


def _marked(name: str, who: int, context: bool = True) -> str:
    more = "x.before, 'txt', x.txt" if context else "'', 'txt', ''"
    return f"transform({name}, x -> named_struct('s', x.s, 'who', {who}, 'e', x.e, 'before', {more}))"


def free(tokens: str, base: str) -> str:
    """The tokens that no span of base overlaps: both in one order of starts, base first; before a token the furthest end so far
    counts, behind it the next start."""
    far = f"{1 << 62}L"

    def checked(every: str) -> str:
        ends = before_each(f"transform({every}, x -> if(x.who = 0, x.e, -1L))", "-1L", lambda a, b: f"greatest({a}, {b})")
        starts = before_each(f"reverse(transform({every}, x -> if(x.who = 0, x.s, {far})))", far, lambda a, b: f"least({a}, {b})")
        sides = f"zip_with(zip_with({every}, {ends}, (x, e) -> named_struct('x', x, 'before', e)), reverse({starts}), (y, s) -> named_struct('x', y.x, 'before', y.before, 'next', s))"
        kept = f"filter({sides}, y -> y.x.who = 1 and y.before <= y.x.s and y.next >= y.x.e)"
        return f"transform({kept}, y -> named_struct('s', y.x.s, 'e', y.x.e, 'before', y.x.before, 'txt', y.x.txt))"

    both = let(f"array_sort(concat({_marked(base, 0, False)}, {_marked(tokens, 1)}))", checked)
    return f"cast(if(size({tokens}) = 0 or size({base}) = 0, {tokens}, {both}) as {SPAN})"


def spans_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def seeds(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest of the text, email, ip, card, phone: arrays of spans, other, run: tokens with digits and runs of groups that no seed overlaps)."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    digit = "_t rlike '[0-9]'"
    needs = {"email": "contains(_t, '@')", "ip": f"{digit} and contains(_t, '.')", "card": digit, "phone": f"{digit} and contains(_t, '+')", "other": "_t rlike '[0-9@]'", "run": "_t rlike '[0-9)(.-] [+(]*[0-9]'"}
    found = [F.expr(f"if({need}, {matches('_t', PATTERNS[k], k)}, cast(array() as {SPAN}))").alias(k) for k, need in needs.items()]
    rows = rows.select(key, F.md5("_t").alias("digest"), *found).withColumn("_base", F.concat(*KINDS))
    return rows.select(key, "digest", *KINDS, *[F.expr(free(k, "_base")).alias(k) for k in ("other", "run")])


def mentions(found: DataFrame) -> DataFrame:
    """(digest, kind or null, before, shape, instance, s, e), a row for each pattern of a mention; shape * is any shape."""
    mention = lambda kind, heads: f"named_struct('kind', cast({kind} as string), 's', x.s, 'e', x.e, 'before', x.before, 'txt', x.txt, 'heads', {heads})"

    def told(own: str) -> str:
        """Tokens, told whether a run begins with them: in order of starts, runs first, such a run stands just before its token."""
        heads = f"coalesce(get({own}, i - 1).s = x.s and get({own}, i - 1).who = 0, false)"
        return f"transform(filter(transform({own}, (x, i) -> named_struct('who', x.who, 'm', {mention('null', heads)})), r -> r.who = 1), r -> r.m)"

    tagged = [f"transform({k}, x -> {mention(repr(k), 'false')})" for k in KINDS]
    tagged += [let(f"array_sort(concat({_marked('run', 0)}, {_marked('other', 1)}))", told), f"transform(run, x -> {mention('null', 'false')})"]
    rows = found.where(" or ".join(f"size({k}) > 0" for k in (*KINDS, "other", "run"))).select("digest", F.expr(f"explode(concat({', '.join(tagged)}))").alias("x")).select("digest", "x.*")
    shape = F.regexp_replace(F.regexp_replace(F.lower("txt"), "[0-9]", "0"), r"\p{L}+", "a")
    before = lambda pattern: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract("before", pattern, 1)), "[0-9]", "0"), r"\s+", " ")
    two, one = before(r"(?<!\S)(\S++\s++\S++)\s*$"), before(r"(?<!\S)(\S++)\s*$")
    own = F.explode(F.array(F.struct(F.when(~F.col("heads"), two).alias("before"), F.lit("*").alias("shape")), F.struct(one.alias("before"), shape.alias("shape"))))
    rows = rows.select("digest", "kind", own.alias("p"), F.lower("txt").alias("instance"), "s", "e")
    return rows.where("p.before <> ''").select("digest", "kind", "p.before", "p.shape", "instance", "s", "e")


def patterns(found: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(before, shape, kind, confidence) of the patterns that may discover instances, the best kind of each.  found: mentions."""
    graph = common.stored(found.groupBy("before", "shape", "instance", "kind").agg(F.countDistinct("digest").cast("double").alias("w")), "pii-graph")
    seeded = graph.where("kind is not null")
    total = graph.groupBy("before", "shape").agg(F.sum("w").alias("total"))
    support = seeded.groupBy("before", "shape", "kind").agg(F.countDistinct("instance").alias("support")).where(F.col("support") >= min_seeds)
    known = seeded.select("before", "shape", "kind", "w", F.lit(1.0).alias("score"))
    score = None
    unknown = graph.where("kind is null").select("before", "shape", "instance", "w")
    for _ in range(rounds):
        rows = known if score is None else known.unionByName(unknown.join(score, "instance").select("before", "shape", "kind", "w", "score"))
        own = rows.groupBy("before", "shape", "kind").agg(F.sum(F.col("w") * F.col("score")).alias("mass"))
        scored = own.join(support, ["before", "shape", "kind"]).join(total, ["before", "shape"])
        scored = common.stored(scored.select("before", "shape", "kind", (F.col("mass") / (F.col("total") + 1)).alias("confidence")), "pii-patterns")
        mean = unknown.join(scored, ["before", "shape"]).groupBy("instance", "kind").agg(F.sum(F.col("w") * F.col("confidence")).alias("mass"))
        weight = unknown.groupBy("instance").agg(F.sum("w").alias("all"))
        score = mean.join(weight, "instance").select("instance", "kind", (F.col("mass") / F.col("all")).alias("score"))
    rank = F.struct(F.col("confidence"), -F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.col("kind").alias("kind"))
    best = scored.where(F.col("confidence") >= confidence).groupBy("before", "shape").agg(F.max(rank).alias("best"))
    return best.select("before", "shape", F.col("best.kind").alias("kind"), F.col("best.confidence").alias("confidence"))


def outer(spans: str) -> str:
    """Spans (k, s, e) without those that lie within a longer one: by start, the longer first, each whose end is beyond all before it.
    In order of kind, start and end."""

    def kept(own: str) -> str:
        ends = before_each(f"transform({own}, x -> -x.back)", "-1L", lambda a, b: f"greatest({a}, {b})")
        last = f"filter(zip_with({own}, {ends}, (x, e) -> named_struct('x', x, 'before', e)), y -> y.before < -y.x.back)"
        return f"array_sort(transform({last}, y -> named_struct('k', y.x.k, 's', y.x.s, 'e', -y.x.back)))"

    return let(f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'back', -x.e, 'k', x.k)))", kept)


def extract(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, the four arrays of seeds, more: array of (kind number, s, e) discovered) of every row."""
    found = common.stored(seeds(docs, key=key, text=text), "pii-seeds")
    every = mentions(found)
    chosen = patterns(every, rounds=rounds)
    more = every.where("kind is null").drop("kind").join(chosen, ["before", "shape"])
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.max(F.struct("confidence", (-number).alias("k"))).alias("best")
    more = more.groupBy("digest", "s", "e").agg(best).select("digest", F.struct((-F.col("best.k")).alias("k"), "s", "e").alias("x"))
    more = more.groupBy("digest").agg(F.array_sort(F.collect_list("x")).alias("more"))
    more = more.withColumn("more", F.expr(outer("more")))
    more = common.stored(more, "pii-more")  # so that the join below reads plain exchanges, whose hot texts are split at run time
    empty = F.array().cast(T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])))
    return found.join(more, "digest", "left").select(key, *KINDS, F.coalesce("more", empty).alias("more"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    rows = extract(common.table(spark, sf_dir, "documents"))
    base = F.array_join(F.concat(*[spans_text(k, F.col(k)) for k in KINDS]), ",")

    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(n).cast("long").alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    plain = [numbered(n, k) for n, k in enumerate(KINDS, 1)]
    names = F.array(*map(F.lit, KINDS))
    every = F.transform(F.array_sort(F.concat(*plain, F.col("more"))), lambda x: F.concat_ws(":", F.element_at(names, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string")))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
