"""Graph files: edge lists, JSON graphs, the compact binary form, DOT, snapshots for display; and generators."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import cut, numbered


def read_edge_list(spark: SparkSession, path: str) -> PropertyGraph:
    """Lines of two ids; blank lines and those that begin with # or % are skipped, self loops dropped; vertices 0 to the largest id.

    eid ascends in the order of (src, dst) pairs' files and lines."""
    parts = F.split(F.trim("value"), r"\s+")
    own = spark.read.text(path).where(~F.trim("value").rlike("^(#|%|$)")).select(parts[0].try_cast("bigint").alias("src"), parts[1].try_cast("bigint").alias("dst"))
    own = cut(own.where("src is not null and dst is not null").withColumn("eid", F.monotonically_increasing_id()))
    top = own.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return PropertyGraph(spark.range(0 if top is None else top + 1), own.where("src <> dst").withColumn("weight", F.lit(1.0)))


def write_edge_list(g: PropertyGraph, path: str, sep: str = " ") -> None:
    """Lines of two ids in any number of files; a first line tells the counts, as a comment."""
    head = g.stats().select(F.concat(F.lit("# vertices "), "n_vertices", F.lit(" edges "), "n_edges").alias("value"))
    head.unionByName(g.edges.select(F.concat_ws(sep, "src", "dst").alias("value"))).write.text(path)


_JSON = "version int, vertexCount long, edgeCount long, vertices array<struct<id:bigint,properties:map<string,string>>>, edges array<struct<from:bigint,to:bigint,weight:double,properties:map<string,string>>>"


def read_json_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """{version, vertexCount, edgeCount, vertices: [{id, properties}], edges: [{from, to, weight, properties}]}.

    Rows without ids are skipped; a missing weight counts as 1.  Properties arrive as the column `properties` (text by key)."""
    doc = spark.read.schema(_JSON).json(path, multiLine=True)
    v = doc.select(F.explode("vertices").alias("v")).select("v.*").where("id is not null").dropDuplicates(["id"])
    e = doc.select(F.posexplode("edges").alias("eid", "e")).select(F.col("eid").cast("long").alias("eid"), "e.*").where("`from` is not null and `to` is not null")
    return PropertyGraph.from_edges(e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "eid", "weight", "properties"), v)


def _rest(df: DataFrame, *out: str) -> Column:
    own = [c for c in df.columns if c not in out]
    return F.struct(*own) if own else F.lit(None).cast("struct<none:string>")


def json_graph(g: PropertyGraph) -> DataFrame:
    """JSON lines (kind, line): one for each vertex and edge, and one header; a graph of any size is written in parallel."""
    v = g.vertices.select(F.lit("vertex").alias("kind"), F.to_json(F.struct("id", _rest(g.vertices, "id").alias("properties"))).alias("line"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("eid", F.col("src").alias("from"), F.col("dst").alias("to"), "weight", _rest(g.edges, "src", "dst", "weight", "eid").alias("properties"))).alias("line"))
    head = g.stats().select(F.lit("graph").alias("kind"), F.to_json(F.struct(F.lit(1).alias("version"), F.col("n_vertices").alias("vertexCount"), F.col("n_edges").alias("edgeCount"))).alias("line"))
    return head.unionByName(v).unionByName(e)


def write_json_lines(g: PropertyGraph, path: str) -> None:
    json_graph(g).select("line").write.text(path)


def read_json_lines(spark: SparkSession, path: str) -> PropertyGraph:
    """What write_json_lines wrote.  A line with an id is a vertex, one with from and to an edge, others are skipped; a missing weight
    counts as 1.  Properties arrive as the column `properties` (text by key)."""
    rows = spark.read.schema("id long, eid long, `from` long, `to` long, weight double, properties map<string,string>").json(path)
    v = rows.where("id is not null and `from` is null").select("id", "properties").dropDuplicates(["id"])
    e = rows.where("`from` is not null and `to` is not null").select(F.col("from").alias("src"), F.col("to").alias("dst"), "eid", "weight", "properties")
    return PropertyGraph.from_edges(e, v)


def json_document(g: PropertyGraph) -> DataFrame:
    """(part, place, line): one JSON document in lines, as read_json_graph reads it; in order of part and place they make the text."""
    def listed(df: DataFrame, place: str, part: int, own: Column) -> DataFrame:
        first = df.agg(F.min(place).alias("_first"))  # one row
        comma = F.when(F.col(place) == F.col("_first"), "").otherwise(",")
        return df.crossJoin(first).select(F.lit(part).alias("part"), F.col(place).alias("place"), F.concat(comma, F.to_json(own)).alias("line"))

    v = listed(g.vertices, "id", 1, F.struct("id", _rest(g.vertices, "id").alias("properties")))
    e = listed(g.edges, "eid", 3, F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", _rest(g.edges, "src", "dst", "weight", "eid").alias("properties")))
    head = g.stats().select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit('{"version":1,"vertexCount":'), "n_vertices", F.lit(',"edgeCount":'), "n_edges", F.lit(',"vertices":[')).alias("line"))
    ends = g.spark.createDataFrame([(2, 0, '],"edges":['), (4, 0, "]}")], "part int, place long, line string")
    return head.unionByName(v).unionByName(e).unionByName(ends)


def write_json_document(g: PropertyGraph, path: str) -> None:
    """One file, as the format is one document."""
    json_document(g).orderBy("part", "place").select("line").coalesce(1).write.text(path)


# fixed values of the compact binary form, all big-endian
MAGIC = b"AXOL"
VERSION = 1
HEADER = ">4sHQQ16x"


def _pack_value(cell: dict) -> bytes:
    tag = cell["t"]
    if tag == P.STRING:
        own = cell["s"].encode()
        return struct.pack(">BI", tag, len(own)) + own
    if tag == P.INT:
        return struct.pack(">Bq", tag, cell["i"])
    if tag == P.DOUBLE:
        return struct.pack(">Bd", tag, cell["d"])
    return struct.pack(">BB", tag, cell["b"]) if tag == P.BOOL else struct.pack(">B", tag)


def pack_graph(vertices: list[tuple[int, dict]], edges: list[tuple[int, int, float, dict]]) -> bytes:
    """The binary form of a small graph: vertices by id, edges by ends, properties by key."""

    def own(values: dict) -> bytes:
        out = [struct.pack(">I", len(values))]
        for k in sorted(values):
            key = k.encode()
            out += [struct.pack(">I", len(key)), key, _pack_value(values[k])]
        return b"".join(out)

    parts = [struct.pack(HEADER, MAGIC, VERSION, len(vertices), len(edges))]
    parts += [struct.pack(">Q", i) + own(p) for i, p in sorted(vertices, key=lambda x: x[0])]
    parts += [struct.pack(">QQd", a, b, w) + own(p) for a, b, w, p in sorted(edges, key=lambda x: x[:2])]
    return b"".join(parts)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def text(self) -> str:
        n = self.take(">I")[0]
        self.at += n
        return bytes(self.data[self.at - n : self.at]).decode()

    def value(self) -> dict:
        out, tag = P.cell(None), self.take(">B")[0]
        out["t"] = tag
        if tag == P.STRING:
            out["s"] = self.text()
        elif tag == P.INT:
            out["i"] = self.take(">q")[0]
        elif tag == P.DOUBLE:
            out["d"] = self.take(">d")[0]
        elif tag == P.BOOL:
            out["b"] = bool(self.take(">B")[0])
        elif tag != P.NULL:
            raise ValueError(f"unknown property tag {tag}")
        return out

    def props(self) -> dict:
        return {self.text(): self.value() for _ in range(self.take(">I")[0])}


def unpack_graph(data: bytes) -> tuple[list, list]:
    r = _Reader(data)
    magic, version, v, e = r.take(HEADER)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a graph file of a known version")
    return [(r.take(">Q")[0], r.props()) for _ in range(v)], [(*r.take(">QQd"), r.props()) for _ in range(e)]


# fixed values of the block form, all big-endian
BLOCK_MAGIC = b"AXEB"
BLOCK_VERSION = 2
BLOCK_HEADER = ">4sHHIQ4x"
BLOCK_EDGES = 32
NO_BLOCK = (1 << 32) - 1


def pack_blocks(vertices: list[tuple[int, dict]], edges: list[tuple[int, int, float, dict]]) -> bytes:
    """The block form of a small graph: ids, then forwards and backwards a chain of 32-edge blocks for each vertex (next
    block, count, places of the neighbours), vertex properties, and every edge's weight (single precision) and properties."""
    order = {v: k for k, (v, _) in enumerate(vertices)}

    def chains(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
        own: list[list[int]] = [[] for _ in vertices]
        for a, b in pairs:
            own[order[a]].append(order[b])
        heads, counts, blocks = [], [], []
        for row in own:
            parts = [row[i : i + BLOCK_EDGES] for i in range(0, len(row), BLOCK_EDGES)]
            first = len(blocks) // (BLOCK_EDGES + 2)
            heads.append(first if parts else NO_BLOCK)
            counts.append(len(parts))
            for i, part in enumerate(parts):
                blocks += [first + i + 1 if i + 1 < len(parts) else NO_BLOCK, len(part), *part, *[0] * (BLOCK_EDGES - len(part))]
        return heads, counts, blocks

    def row(form: str, values: list[int]) -> bytes:
        return struct.pack(f">I{len(values)}{form}", len(values), *values)

    def own(values: dict) -> bytes:
        keys = [(k.encode(), v) for k, v in values.items()]
        return struct.pack(">H", len(keys)) + b"".join(struct.pack(">H", len(k)) + k + _pack_value(v) for k, v in keys)

    parts = [struct.pack(BLOCK_HEADER, BLOCK_MAGIC, BLOCK_VERSION, BLOCK_EDGES, len(vertices), len(edges)), row("Q", list(order))]
    for pairs in ([(a, b) for a, b, _, _ in edges], [(b, a) for a, b, _, _ in edges]):
        parts += [row("I", x) for x in chains(pairs)]
    parts += [struct.pack(">I", len(vertices)), *(own(p) for _, p in vertices)]
    parts += [struct.pack(">I", len(edges)), *(struct.pack(">QQf", a, b, w) + own(p) for a, b, w, p in edges)]
    return b"".join(parts)


def unpack_blocks(data: bytes) -> tuple[list, list]:
    """Version 2 follows each vertex's chain; in version 1 a block's first number is its owner.  An edge takes the next weight
    and properties that its pair has, weight 1 if there are none left."""
    r = _Reader(data)
    magic, version, size, v, _ = r.take(BLOCK_HEADER)
    if magic != BLOCK_MAGIC or version not in (1, BLOCK_VERSION) or size != BLOCK_EDGES:
        raise ValueError("not a block file of a known version")
    ids, heads, _, blocks, _, _, _ = (r.take(f">{r.take('>I')[0]}{form}") for form in "QIIIIII")
    step = size + 2
    pairs: list[tuple[int, int]] = []
    if version == 1:
        pairs = [(blocks[i], x) for i in range(0, len(blocks), step) for x in blocks[i + 2 : i + 2 + blocks[i + 1]]]
    else:
        for k, at in enumerate(heads):
            for _ in range(len(blocks) // step + 1):  # a broken chain can't go round for ever
                if at == NO_BLOCK or at * step >= len(blocks):
                    break
                pairs += [(k, x) for x in blocks[at * step + 2 : at * step + 2 + blocks[at * step + 1]]]
                at = blocks[at * step]

    def own() -> dict:
        out = {}
        for _ in range(r.take(">H")[0]):
            n = r.take(">H")[0]
            r.at += n
            key = bytes(data[r.at - n : r.at]).decode()
            out[key] = r.value()
        return out

    props = [own() for _ in range(r.take(">I")[0])]
    more: dict[tuple[int, int], list] = {}
    for _ in range(r.take(">I")[0]):
        a, b, w = r.take(">QQf")
        more.setdefault((a, b), []).append((w, own()))
    edges = []
    for a, b in ((ids[a], ids[b]) for a, b in pairs):
        w, p = more[a, b].pop(0) if more.get((a, b)) else (1.0, {})
        edges.append((a, b, w, p))
    return [(i, props[k] if k < len(props) else {}) for k, i in enumerate(ids[:v]) if i != (1 << 64) - 1], edges


def read_packed(spark: SparkSession, path: str) -> PropertyGraph:
    """Files of the compact or the block form, told by their first bytes, each parsed by one task; several files make one
    graph (a later duplicate pair is parallel)."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                v, e = (unpack_blocks if bytes(data[:4]) == BLOCK_MAGIC else unpack_graph)(bytes(data))
                rows = [("v", i, None, None, P.to_json(p)) for i, p in v] + [("e", a, b, w, P.to_json(p)) for a, b, w, p in e]
                yield pd.DataFrame(rows, columns=["kind", "a", "b", "w", "props"])

    rows = cut(spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "kind string, a long, b double, w double, props string"))
    e = rows.where("kind = 'e'").select(F.col("a").alias("src"), F.col("b").cast("long").alias("dst"), F.monotonically_increasing_id().alias("eid"), F.col("w").alias("weight"), "props")
    return PropertyGraph.from_edges(e, rows.where("kind = 'v'").select(F.col("a").alias("id"), "props"))


# fixed values: the fill colours of communities
COLOURS = ("#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F", "#BB8FCE", "#85C1E9")


def dot(g: PropertyGraph, label: str | None = None, directed: bool = True, communities: DataFrame | None = None) -> DataFrame:
    """(part, place, line): the DOT text's lines; sort by part and place and write them in order.

    communities: (id, label) with labels from 0; they colour the vertices."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(label).cast("string") if label else F.lit(None).cast("string"), F.col("id").cast("string")), '"', '\\\\"'), F.lit('"'))
    rows = g.vertices
    attrs = F.concat(F.lit("label="), quoted)
    if communities is not None:
        rows = rows.join(communities.withColumnRenamed("label", "_c"), "id", "left")
        colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("_c") % len(COLOURS) + 1).cast("int"))
        attrs = F.when(F.col("_c").isNull(), attrs).otherwise(F.concat(attrs, F.lit(', fillcolor="'), colour, F.lit('"')))
    v = rows.select(F.lit(1).alias("part"), F.col("id").alias("place"), F.concat(F.lit("  "), F.col("id"), F.lit(" ["), attrs, F.lit("];")).alias("line"))
    tail = F.when(F.col("weight") != 1.0, F.concat(F.lit(" [weight="), F.col("weight"), F.lit("]"))).otherwise("")
    e = g.edges.select(F.lit(2).alias("part"), F.col("eid").alias("place"), F.concat(F.lit("  "), F.col("src"), F.lit(" -> " if directed else " -- "), F.col("dst"), tail, F.lit(";")).alias("line"))
    ends = g.spark.createDataFrame([(0, 0, "digraph G {" if directed else "graph G {"), (0, 1, "  node [shape=circle, style=filled];"), (3, 0, "}")], "part int, place long, line string")
    return ends.unionByName(v).unionByName(e)


def write_dot(lines: DataFrame, path: str) -> None:
    lines.orderBy("part", "place").select("line").write.text(path)


def snapshot(g: PropertyGraph, sid: str | None = None, label: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """For display: nodes (id, sid, label, props) and edges (src, dst, kind, weight, props); sid falls back to the id, label to sid.  props: all
    columns but those that the edges name themselves, as JSON; missing ones are left out."""
    text = lambda c: F.lit(None).cast("string") if c is None else F.nullif(F.col(c).cast("string"), F.lit(""))
    s = F.coalesce(text(sid), F.col("id").cast("string"))
    props = lambda df, *out: F.coalesce(F.to_json(_rest(df, *out)), F.lit("{}")).alias("props")
    nodes = g.vertices.select("id", s.alias("sid"), F.coalesce(text(label), s).alias("label"), props(g.vertices, "id"))
    return nodes, g.edges.select("src", "dst", F.coalesce(text(kind), F.lit("")).alias("kind"), "weight", props(g.edges, "src", "dst", "eid", "weight"))


# fixed values: multipliers and modulus of well-known linear congruential generators
_A, _B, _C, _M = 48_271, 69_621, 16_807, 2_147_483_647


def uniform(key: str, seed: int, turn: int) -> Column:
    """A number from 0 to below 1 that looks random, from whole-number arithmetic that any engine repeats."""
    x = F.pmod((F.pmod(F.col(key), F.lit(_M)) + 1) * _A + F.lit(turn * _B + seed), F.lit(_M))
    for _ in range(3):
        x = F.pmod(F.pmod(x * _C, F.lit(_M)) * _A + F.lit(turn), F.lit(_M))
    return x / F.lit(float(_M))


def _drawn(spark: SparkSession, n: int, m: int, seed: int, skew: float, undirected: bool) -> DataFrame:
    draw = lambda k: F.floor(F.pow(uniform("id", seed, k), F.lit(float(skew))) * n).cast("long")
    e = spark.range(m).select(draw(1).alias("a"), draw(2).alias("b"), "id").where("a <> b")
    if undirected:
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "id")
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("id").alias("eid"))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 42, skew: float = 1.0, weighted: bool = False, undirected: bool = False) -> PropertyGraph:
    """About m distinct edges without loops among n vertices; skew > 1 draws low ids more often (a power law); undirected: each
    pair once, from the lower id."""
    weight = F.floor(uniform("eid", seed, 3) * 1000) / 100.0 + 0.01 if weighted else F.lit(1.0)
    return PropertyGraph(spark.range(n), _drawn(spark, n, m, seed, skew, undirected).withColumn("weight", weight))


def random_edges(g: PropertyGraph, m: int, seed: int = 42, weighted: bool = False) -> PropertyGraph:
    """g with about m more edges between its vertices, none of them a loop or parallel to another; their eids follow the largest."""
    ids = numbered(g.vertices.select("id"), "id", "_n")
    new = _drawn(g.spark, ids.count(), m, seed, 1.0, False)
    of = lambda end: ids.select(F.col("_n").alias(end), F.col("id").alias(f"_{end}"))
    new = new.join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "eid")
    new = new.join(g._edges.select("src", "dst"), ["src", "dst"], "left_anti")
    weight = F.floor(uniform("eid", seed, 3) * 1000) / 100.0 + 0.01 if weighted else F.lit(1.0)
    top = g._edges.agg(F.coalesce(F.max("eid"), F.lit(-1))).first()[0]
    return g.add_edges(new.select("src", "dst", weight.alias("weight"), (F.lit(top + 1) + F.col("eid")).alias("eid")))


def random_vertices(g: PropertyGraph, n: int) -> PropertyGraph:
    """g with n more vertices, numbered after the largest."""
    top = g.vertices.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    return PropertyGraph(g.vertices.unionByName(g.spark.range(top + 1, top + 1 + n), allowMissingColumns=True), g._edges)
