"""The registered graph queries and their DuckDB equivalents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.functions.session import GraphSession
from tessera.operators import communities, incremental, ranking, structure, traverse
from tessera.plans import tables as T
from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import cut, shared_dir
from tessera.plans.memo import Memo
from tessera.sources import files, store
from tessera.sources.index import IndexedGraph, IndexRegistry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def query(name: str, sql: str | None = None, *graphs: str, extra: str = "", recursive: bool = False):
    """Register a query.  graphs: the SQL graphs that the oracle's WITH clause needs; extra: further CTEs."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ctes = ", ".join([T.SQL[g] for g in graphs] + ([extra] if extra else []))
            ORACLES[name] = (f"WITH {'RECURSIVE ' * recursive}{ctes} " if ctes else "") + sql
        return f

    return add


def flow_query(name: str, sql: str | None = None, *graphs: str, **options):
    """Register a function of the flow graph."""

    def add(f: Callable[[PropertyGraph], DataFrame]) -> Callable[[PropertyGraph], DataFrame]:
        query(name, sql, *graphs, **options)(lambda s, d: f(T.flow(s, d)))
        return f

    return add


def ids(spark: SparkSession, *values: int) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id long")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- scans, single elements, changes

query("s20_vertex_scan", "SELECT id, name, kind FROM geo_v", "geo")(lambda s, d: T.geo(s, d).vertices.select("id", "name", "kind"))
query("s21_edge_scan", "SELECT src, dst, eid, weight FROM trade_e", "trade")(lambda s, d: T.trade(s, d).edges.select("src", "dst", "eid", "weight"))
query("c4_vertex_by_id", "SELECT id, name, kind FROM trade_v WHERE id = 7", "trade")(lambda s, d: T.trade(s, d).vertex(7).select("id", "name", "kind"))
query("c5_last_edge", "SELECT src, dst, max(eid) AS eid, arg_max(weight, eid) AS weight FROM trade_e GROUP BY src, dst", "trade")(lambda s, d: T.trade(s, d).simple().edges.select("src", "dst", "eid", "weight"))
query("c6_parallel_edges", f"SELECT src, dst, eid, weight FROM supply_e WHERE src = 3 AND dst = (SELECT min(dst) FROM supply_e WHERE src = 3)", "supply")(lambda s, d: (lambda g: g.edges_between(3, g.edges.where("src = 3").agg(F.min("dst")).first()[0]))(T.supply(s, d)).select("src", "dst", "eid", "weight"))


@query("c1_put_vertices", "SELECT id, CASE WHEN kind = 'nation' THEN 'new' ELSE name END AS name FROM geo_v UNION ALL SELECT -1, 'new'", "geo")
def c1(s, d):
    g = T.geo(s, d)
    rows = g.vertices.where("kind = 'nation'").select("id").unionByName(ids(s, -1)).withColumn("name", F.lit("new"))
    return g.put_vertices(rows).vertices.select("id", "name")


@query("c2_new_vertices", "SELECT max(id) AS top, count(*) AS n FROM (SELECT id FROM geo_v UNION ALL SELECT (SELECT max(id) FROM geo_v) + row_number() OVER (ORDER BY name) FROM geo_v WHERE kind = 'nation')", "geo")
def c2(s, d):
    g = T.geo(s, d)
    return g.new_vertices(g.vertices.where("kind = 'nation'").drop("id"), "name").vertices.agg(F.max("id").alias("top"), F.count("*").alias("n"))


@query("c3_add_edges", "SELECT (SELECT count(*) FROM geo_v) + 1 AS n_vertices, (SELECT count(*) FROM geo_e) + (SELECT count(*) FROM region) AS n_edges", "geo")
def c3(s, d):
    g = T.geo(s, d)
    return g.add_edges(g.vertices.where("kind = 'region'").select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"))).stats().select("n_vertices", "n_edges")


query("c7_delete_edges", f"SELECT count(*) AS n FROM trade_e WHERE dst <> {T.OTHER} + 1", "trade")(lambda s, d: (lambda g: g.delete_edges(g.edges.where(F.col("dst") == T.OTHER + 1).select("eid")).edges.agg(F.count("*").alias("n")))(T.trade(s, d)))
query("c8_delete_vertices", "SELECT count(*) AS n_edges, (SELECT count(*) FROM trade_v WHERE balance >= 0) AS n_vertices FROM trade_e WHERE src IN (SELECT id FROM trade_v WHERE balance >= 0) AND dst IN (SELECT id FROM trade_v WHERE balance >= 0)", "trade")(lambda s, d: (lambda g: g.delete_vertices(g.vertices.where("balance < 0").select("id")).stats().select("n_vertices", "n_edges"))(T.trade(s, d)))


@query("c9_update_vertices", "SELECT id, CASE WHEN kind = 'region' THEN 'updated' ELSE name END AS name FROM geo_v", "geo")
def c9(s, d):
    g = T.geo(s, d)
    return g.update_vertices(g.vertices.where("kind = 'region'").select("id", F.lit("updated").alias("name")).unionByName(ids(s, -5).withColumn("name", F.lit("x")))).vertices.select("id", "name")


@query("c10_update_edges", "SELECT src, dst, 9.0 AS weight FROM supply_e WHERE src = 1 GROUP BY src, dst UNION ALL SELECT src, dst, weight FROM supply_e WHERE src <> 1", "supply")
def c10(s, d):
    g = T.supply(s, d)
    return g.update_edges(g.edges.where("src = 1").select("src", "dst").distinct().withColumn("weight", F.lit(9.0))).edges.select("src", "dst", "weight")


query("c12_stats", "SELECT (SELECT count(*) FROM supply_v) AS n_vertices, (SELECT count(*) FROM supply_e) AS n_edges, CAST((SELECT sum(ceil(n / 32.0)) FROM (SELECT count(*) AS n FROM supply_e GROUP BY src UNION ALL SELECT count(*) FROM supply_e GROUP BY dst)) AS BIGINT) AS n_blocks", "supply")(lambda s, d: T.supply(s, d).stats())
query("c13_has_edges", f"SELECT n.src, n.dst FROM (SELECT s_suppkey AS src, p_partkey + {T.OTHER} AS dst FROM supplier JOIN part ON p_partkey % 100 = s_suppkey) n WHERE EXISTS (SELECT 1 FROM supply_e e WHERE e.src = n.src AND e.dst = n.dst)", "supply")(
    lambda s, d: T.supply(s, d).has_edges(T.table(s, d, "supplier").join(T.table(s, d, "part"), F.expr("p_partkey % 100 = s_suppkey")).select(F.col("s_suppkey").alias("src"), (F.col("p_partkey") + T.OTHER).alias("dst")))
)

# ---- indexes, filters, projections



def _indexes(s: SparkSession) -> IndexRegistry:
    return IndexRegistry(s, f"{shared_dir(s)}/indexes-{uuid.uuid4().hex}")


@query("i1_index_exact", "SELECT id FROM trade_v WHERE kind = 'supplier'", "trade")
def i1(s, d):
    own = _indexes(s)
    own.create("by_kind", "kind", T.trade(s, d).vertices)
    return own.exact("kind", "supplier")


@query("i2_index_registry", "SELECT unnest(['a', 'c']) AS name, unnest(['nation', 'kind']) AS key")
def i2(s, d):
    own, v = _indexes(s), T.geo(s, d).vertices
    for name, key in (("a", "nation"), ("b", "name"), ("c", "kind")):
        own.create(name, key, v)
    own.drop("b")
    return s.createDataFrame([(n, own.definition(n)["key"]) for n in own.names() if own.has(own.definition(n)["key"]) and not own.has("name")], "name string, key string")


@query("i4_index_among", "SELECT id FROM trade_v WHERE nation IN (3, 7)", "trade")
def i4(s, d):
    own = _indexes(s)
    own.create("by_nation", "nation", T.trade(s, d).vertices)
    return own.among("nation", [3, 7, "5", 9.0])  # neither the text "5" nor the Double 9 is anybody's nation


@query("i5_index_maintained", "SELECT id, nation FROM (SELECT id, CASE WHEN nation = 3 THEN 99 ELSE nation END AS nation FROM trade_v WHERE balance >= 0) WHERE nation IN (99, 7, 3)", "trade")
def i5(s, d):
    own = _indexes(s)
    g = T.trade(s, d)
    own.create("by_nation", "nation", g.vertices)
    g = IndexedGraph(g, own).put_vertices(g.vertices.where("nation = 3").withColumn("nation", F.lit(99).cast(dict(g.vertices.dtypes)["nation"])))
    g = g.delete_vertices(g.graph.vertices.where("balance < 0").select("id"))
    out = g.find("nation", 99).select("id", F.lit(99).cast("long").alias("nation"))
    return out.unionByName(g.find("nation", 7).select("id", F.lit(7).cast("long").alias("nation"))).unionByName(g.find("nation", 3).select("id", F.lit(3).cast("long").alias("nation")))


@query("i6_index_rebuilt", "SELECT id FROM trade_v WHERE nation = 4", "trade")
def i6(s, d):
    own, g = _indexes(s), T.trade(s, d)
    own.create("by_nation", "nation", g.vertices.where("balance < 0"))
    own.rebuild(g.vertices, "nation")
    return own.exact("nation", 4)


@query("i7_index_stats", "SELECT 'nation' AS key, count(DISTINCT nation) AS n_values, count(nation) AS n_entries FROM trade_v UNION ALL SELECT 'kind', count(DISTINCT kind), count(kind) FROM trade_v", "trade")
def i7(s, d):
    own = _indexes(s)
    for key in ("nation", "kind"):
        own.create(key, key, T.trade(s, d).vertices)
    return own.stats().drop("name")


@query("i8_index_evict", "SELECT nation, CASE WHEN nation = 5 THEN (SELECT min(id) FROM trade_v) ELSE max(id) END AS id FROM trade_v WHERE id <> (SELECT min(id) FROM trade_v) OR nation = 5 GROUP BY nation", "trade")
def i8(s, d):
    own, v = _indexes(s), T.trade(s, d).vertices
    own.create("one", "nation", v, unique="evict")
    first = v.agg(F.min("id")).first()[0]
    own.maintain(v.where(F.col("id") == first).withColumn("nation", F.lit(5).cast(dict(v.dtypes)["nation"])))  # the last writer owns the value
    return own.entries("one").select(F.col("value").cast("long").alias("nation"), "id")


query("i9_distinct_values", "SELECT DISTINCT nation FROM trade_v", "trade")(lambda s, d: T.trade(s, d).vertices.select("nation").distinct())
query("q1_with_id", "SELECT id, name FROM trade_v WHERE id = 12 AND kind = 'customer'", "trade")(lambda s, d: T.trade(s, d).find_vertices(F.col("id") == 12, F.col("kind") == "customer").select("id", "name"))


def _cells(s, d) -> PropertyGraph:
    g = T.trade(s, d)
    return PropertyGraph(g.vertices.select("id", P.packed(kind=F.col("kind"), nation=F.col("nation"), balance=F.col("balance"), name=F.col("name")).alias("props")), g.edges)


query("q2_typed_equality", "SELECT id FROM trade_v WHERE nation = 4", "trade")(lambda s, d: _cells(s, d).find_vertices(P.equals("props", "nation", 4), ~P.equals("props", "nation", 4.0), P.has("props", "kind")).select("id"))
query("q5_with_properties", "SELECT id, balance, name FROM trade_v WHERE kind = 'supplier'", "trade")(lambda s, d: _cells(s, d).find_vertices(P.equals("props", "kind", "supplier")).select("id", P.number("props", "balance").alias("balance"), P.string("props", "name").alias("name")))
query("q6_edges_from", "SELECT src, dst, eid FROM trade_e WHERE src = 10", "trade")(lambda s, d: T.trade(s, d).find_edges(src=10).select("src", "dst", "eid"))
query("q7_edge_property", f"SELECT src, dst, weight, flag FROM trade_e WHERE flag = 'R' AND dst = {T.OTHER} + 3", "trade")(lambda s, d: T.trade(s, d).find_edges(F.col("flag") == "R", dst=T.OTHER + 3).select("src", "dst", "weight", "flag"))
query("q8_conditions", "SELECT id FROM trade_v WHERE balance > 5000 AND nation < 10 AND kind = 'customer'", "trade")(lambda s, d: _cells(s, d).find_vertices(P.greater("props", "balance", 5000.0), P.less("props", "nation", 10), P.equals("props", "kind", "customer")).select("id"))
query("q8_in_community", "SELECT id FROM trade_v WHERE id % 5 = 2 AND balance > 0", "trade")(lambda s, d: (lambda g: g.find_vertices(F.col("balance") > 0, community=(g.vertices.select("id", (F.col("id") % 5).alias("label")), 2)).select("id"))(T.trade(s, d)))
query("q11_neighbours_where", "SELECT DISTINCT v.id, v.name FROM trade_e e JOIN trade_v v ON v.id = e.dst WHERE e.src = 5 AND v.nation < 12", "trade")(lambda s, d: (lambda g: g.find_neighbours(g.vertex(5), F.col("nation") < 12).select(F.col("neighbour").alias("id"), F.col("n_name").alias("name")))(T.trade(s, d)))
query("q14_display_filter", "SELECT id, name FROM geo_v WHERE coalesce(kind, 'concept') = 'nation' AND contains(lower(name), 'n') ORDER BY name LIMIT 500", "geo")(lambda s, d: T.geo(s, d).vertices.where((F.coalesce("kind", F.lit("concept")) == "nation") & F.lower("name").contains("n")).orderBy("name").limit(500).select("id", "name"))
query("q15_facets", "SELECT coalesce(kind, 'concept') AS kind, count(*) AS n FROM geo_v GROUP BY 1", "geo")(lambda s, d: T.geo(s, d).vertices.groupBy(F.coalesce("kind", F.lit("concept")).alias("kind")).agg(F.count("*").alias("n")))
query("q16_out_edge_columns", "SELECT DISTINCT dst, coalesce(flag, '') AS value FROM trade_e WHERE src = 3", "trade")(lambda s, d: (lambda g: g.out_edges(g.vertex(3)).select("dst", F.coalesce("flag", F.lit("")).alias("value")).distinct())(T.trade(s, d)))

# ---- neighbours and degrees

query("n1_out_neighbours", "SELECT src AS id, dst AS neighbour, eid FROM trade_e", "trade")(lambda s, d: T.trade(s, d).out_neighbours())
query("n2_in_edges", f"SELECT dst, src, eid, weight FROM supply_e WHERE dst = {T.OTHER} + 9", "supply")(lambda s, d: (lambda g: g.in_edges(g.vertex(T.OTHER + 9)).select("dst", "src", "eid", "weight"))(T.supply(s, d)))
query("n3_all_neighbours", "SELECT DISTINCT id, neighbour FROM (SELECT src AS id, dst AS neighbour FROM flow_e UNION ALL SELECT dst, src FROM flow_e)", "flow")(lambda s, d: (lambda g: g.neighbours(g.vertices))(T.flow(s, d)))
query("n5_degrees", "SELECT v.id, (SELECT count(*) FROM trade_e WHERE src = v.id) AS out_degree, (SELECT count(*) FROM trade_e WHERE dst = v.id) AS in_degree FROM trade_v v", "trade")(lambda s, d: T.trade(s, d).degrees())
query("n7_highest_out_degree", "SELECT src AS id, count(*) AS out_degree FROM trade_e GROUP BY src ORDER BY 2 DESC, 1 LIMIT 1", "trade")(lambda s, d: T.trade(s, d).degrees().orderBy(F.desc("out_degree"), "id").limit(1).select("id", "out_degree"))
query("n8_density", "SELECT round(2.0 * e / (v * (v - 1.0)), 9) AS density, round(2.0 * e / v, 9) AS average_degree FROM (SELECT (SELECT count(*) FROM trade_v) AS v, (SELECT count(*) FROM trade_e) AS e)", "trade")(lambda s, d: _rounded(T.trade(s, d).density(), 9, "density", "average_degree"))
DETAIL = "SELECT '{0}' AS way, e.kind, count(*) OVER (PARTITION BY e.kind) AS n, {1} AS other, eid, next_kind FROM flow_e e WHERE {2} = 8"
query("n9_vertex_detail", DETAIL.format("out", "dst", "src") + " UNION ALL " + DETAIL.format("in", "src", "dst"), "flow")(lambda s, d: T.flow(s, d).detail(8)[1].select("way", "kind", "n", "other", "eid", "next_kind"))
query("n9_vertex_detail_vertex", "SELECT * FROM trade_v WHERE id = 8", "trade")(lambda s, d: T.trade(s, d).detail(8)[0])
query("n10_to_csr", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS first, n FROM (SELECT v.id, (SELECT count(*) FROM supply_e WHERE src = v.id) AS n FROM supply_v v)", "supply")(lambda s, d: T.supply(s, d).to_csr().select("id", F.col("place").cast("long").alias("place"), F.col("first").cast("long").alias("first"), "n"))
query("j4_dangling_edges", "SELECT count(*) AS n FROM trade_e WHERE src IN (SELECT id FROM trade_v WHERE nation = 3) OR dst IN (SELECT id FROM trade_v WHERE nation = 3)", "trade")(lambda s, d: (lambda g: PropertyGraph(g.vertices.where("nation <> 3"), g.edges).dangling().agg(F.count("*").alias("n")))(T.trade(s, d)))
flow_query("j7_common_neighbours", "SELECT u.a, u.b, count(y.dst) AS n FROM u JOIN m x ON x.src = u.a LEFT JOIN m y ON y.src = u.b AND y.dst = x.dst GROUP BY u.a, u.b", "flow", extra="u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM flow_e WHERE src <> dst), m AS MATERIALIZED (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u)")(lambda g: structure.edge_support(g))

# ---- traversals


def _levels(edges: str, start: str, depth: int, where: str = "") -> str:
    """CTEs lev0 .. lev<depth> of (id, dist): breadth-first levels over a table of (src, dst)."""
    parts = [f"lev0 AS MATERIALIZED (SELECT {start} AS id, 0 AS dist)"]
    for i in range(1, depth + 1):
        parts.append(f"lev{i} AS MATERIALIZED (SELECT id, dist FROM lev{i - 1} UNION ALL SELECT DISTINCT e.dst, {i} FROM {edges} e JOIN lev{i - 1} l ON l.id = e.src AND l.dist = {i - 1} WHERE e.dst NOT IN (SELECT id FROM lev{i - 1}))")
    return ", ".join(parts)


flow_query("t1_walk", "SELECT e.src, CAST(l.dist AS BIGINT) AS depth, e.dst, e.eid FROM flow_e e JOIN lev2 l ON l.id = e.src WHERE l.dist < 2", "flow", extra=_levels("flow_e", "3", 2))(lambda g: traverse.walk(g, g.vertex(3), 2)[1])


@flow_query("t2_subgraph", "SELECT (SELECT count(*) FROM lev2) AS n_vertices, count(*) AS n_edges FROM flow_e e JOIN lev2 l ON l.id = e.src WHERE l.dist < 2", "flow", extra=_levels("flow_e", "5", 2))
def t2(g):
    return traverse.subgraph(g, g.vertex(5), 2).stats().select("n_vertices", "n_edges")


flow_query("t3_walks_of_length", "SELECT a.src || '>' || a.dst || '>' || b.dst AS path, count(*) AS n FROM flow_e a JOIN flow_e b ON b.src = a.dst GROUP BY 1", "flow")(
    lambda g: traverse.counted_paths(g, 2).select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "n")
)
flow_query("t5_bfs", "SELECT id, CAST(dist AS BIGINT) AS dist FROM lev6", "flow", extra=_levels("flow_e", "3", 6))(lambda g: traverse.bfs(g, g.vertex(3), 6).select("id", "dist"))
query("t6_bfs_within", "SELECT id, CAST(dist AS BIGINT) AS dist FROM lev1", "flow", extra=_levels("flow_e", "3", 1))(lambda s, d: (lambda g: traverse.bfs(g, g.vertex(3), 1).select("id", "dist"))(T.flow(s, d)))


@query("t7_shortest_path", f"SELECT CAST(v AS BIGINT) AS id, p AS place FROM (SELECT unnest([{T.CUSTOMER} + 1, c_nationkey + {T.NATION}, n_regionkey]) AS v, unnest([0, 1, 2]) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)")
def t7(s, d):
    g = T.geo(s, d)
    up = T.table(s, d, "customer").where("c_custkey = 1").join(T.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()
    path = traverse.shortest_path(g, T.CUSTOMER + 1, int(up["n_regionkey"]))
    return s.createDataFrame(list(zip(path, range(len(path)))), "id long, place int")


def _bellman(rounds: int) -> str:
    parts = ["hop AS MATERIALIZED (SELECT src, dst, min(1 + (src * 7 + dst * 3) % 11) AS w FROM flow_e GROUP BY src, dst)", "d0 AS MATERIALIZED (SELECT 3 AS id, 0.0 AS dist)"]
    for i in range(1, rounds + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM d{i - 1} UNION ALL SELECT h.dst, d.dist + h.w FROM d{i - 1} d JOIN hop h ON h.src = d.id) GROUP BY id)")
    return ", ".join(parts)


@flow_query("t10_weighted_distances", "SELECT id, CAST(dist AS DOUBLE) AS dist FROM d24", "flow", extra=_bellman(24))
def t10(g):
    g = PropertyGraph(g.vertices, g.edges.withColumn("weight", (1 + (F.col("src") * 7 + F.col("dst") * 3) % 11).cast("double")))
    return traverse.sssp(g, g.vertex(3)).select("id", "dist")


query("t11_pattern", "SELECT DISTINCT a.id AS a, b.src AS b, c.id AS c FROM geo_v a JOIN geo_e e ON e.dst = a.id JOIN geo_e b ON b.src = e.src JOIN geo_v c ON c.id = b.dst JOIN geo_v m ON m.id = e.src WHERE a.kind = 'nation' AND m.kind = 'supplier' AND c.kind = 'nation'", "geo")(
    lambda s, d: T.geo(s, d).match([("a", F.col("kind") == "nation"), ("b", F.col("kind") == "supplier"), ("c", F.col("kind") == "nation")], [("in", None), ("out", None)])
)
query("t11_pattern_first", "SELECT e.dst AS a, min(e.src) AS b FROM geo_e e JOIN geo_v v ON v.id = e.src WHERE v.kind = 'supplier' GROUP BY e.dst", "geo")(lambda s, d: T.geo(s, d).match([("a", F.col("kind") == "nation"), ("b", F.col("kind") == "supplier")], [("in", None)], first_only=True))


@flow_query("t12_simple_paths", "SELECT n, count(*) AS paths FROM (SELECT 1 AS n FROM u WHERE src = 3 AND dst = 9 UNION ALL SELECT 2 FROM u a JOIN u b ON b.src = a.dst WHERE a.src = 3 AND b.dst = 9 AND a.dst <> 9 UNION ALL SELECT 3 FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.src = b.dst WHERE a.src = 3 AND c.dst = 9 AND a.dst NOT IN (3, 9) AND b.dst NOT IN (3, 9) AND b.dst <> a.dst) GROUP BY n", "flow", extra="u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM flow_e UNION ALL SELECT dst, src FROM flow_e) WHERE src <> dst)")
def t12(g):
    return traverse.simple_paths(g, 3, 9, 3).groupBy((F.size("path") - 1).alias("n")).agg(F.count("*").alias("paths"))


query("t4_first_paths", "SELECT array_to_string([a.src, a.dst, b.dst], '>') AS path, (SELECT count(*) FROM flow_e a JOIN flow_e b ON b.src = a.dst) AS n FROM flow_e a JOIN flow_e b ON b.src = a.dst ORDER BY a.src, a.dst, b.dst LIMIT 50", "flow")(lambda s, d: (lambda x: x[0].select(F.concat_ws(">", F.transform("path", lambda v: v.cast("string"))).alias("path"), F.lit(x[1]).alias("n")))(traverse.limited(traverse.paths(T.flow(s, d), 2), 50, ["path"])))
query("j6_paths_over_kinds", "SELECT a.src || '>' || a.dst || '>' || b.dst AS path, a.n * b.n AS n FROM k a JOIN k b ON b.src = a.dst", "flow", extra="k AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM flow_e GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'error') > 0)")(lambda s, d: traverse.counted_paths(T.flow(s, d), 2, edge=F.col("kind") == "error").select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"), "n"))


@flow_query("t8_weighted_path", "SELECT CAST((SELECT dist FROM d24 WHERE id = 60) AS DOUBLE) AS total, CAST((SELECT dist FROM d24 WHERE id = 60) AS DOUBLE) AS along", "flow", extra=_bellman(24))
def t8(g):
    g = PropertyGraph(g.vertices, g.edges.withColumn("weight", (1 + (F.col("src") * 7 + F.col("dst") * 3) % 11).cast("double")))
    path, total = traverse.shortest_path_weighted(g, 3, 60)
    hops = g.spark.createDataFrame(list(zip(path, path[1:])), "src long, dst long")
    return hops.select(F.lit(total).alias("total"), (1 + (F.col("src") * 7 + F.col("dst") * 3) % 11).cast("double").alias("w")).groupBy("total").agg(F.sum("w").alias("along"))


query("t13_induced", "SELECT src, dst, eid FROM trade_e WHERE src IN (SELECT id FROM trade_v WHERE balance > 0) AND dst IN (SELECT id FROM trade_v WHERE balance > 0)", "trade")(lambda s, d: (lambda g: g.induced(g.vertices.where("balance > 0")).edges.select("src", "dst", "eid"))(T.trade(s, d)))
flow_query("t14_expand", "SELECT count(*) AS n FROM flow_e WHERE src IN (SELECT id FROM lev2) AND dst IN (SELECT id FROM lev2)", "flow", extra=_levels("flow_e", "3", 2))(lambda g: traverse.expand(g, g.vertex(3), 2, None)[1].agg(F.count("*").alias("n")))
flow_query("t16_reachable", "SELECT id FROM lev24", "flow", extra=_levels("flow_e", "7", 24))(lambda g: traverse.bfs(g, g.vertex(7)).select("id"))

# ---- aggregation and sets

query("a1_aggregate", "SELECT count(balance) AS n, round(sum(balance), 2) AS total, round(avg(balance), 6) AS mean, min(balance) AS least, max(balance) AS most FROM trade_v", "trade")(lambda s, d: (lambda df: _rounded(_rounded(df, 2, "total"), 6, "mean"))(_cells(s, d).aggregate(P.number("props", "balance"))))
query("a2_group_counts", "SELECT kind, CASE WHEN nation IS NULL THEN '(无)' ELSE '?' END AS nation, CASE WHEN kind = 'supplier' THEN '(无)' ELSE name END AS name, count(*) AS n FROM trade_v GROUP BY 1, 2, 3", "trade")(lambda s, d: (lambda g: PropertyGraph(g.vertices.select("id", F.when(F.col("kind") == "supplier", P.packed(kind=F.col("kind"), nation=F.col("nation"))).otherwise(P.packed(kind=F.col("kind"), nation=F.col("nation"), name=F.col("name"))).alias("props")), g.edges).group_counts("kind", "nation", "name"))(T.trade(s, d)))
query("o5_difference", "SELECT DISTINCT src, dst FROM flow_e WHERE kind = 'click' EXCEPT SELECT src, dst FROM flow_e WHERE kind = 'view'", "flow")(lambda s, d: (lambda e: e.where("kind = 'click'").select("src", "dst").distinct().exceptAll(e.where("kind = 'view'").select("src", "dst").distinct()))(T.flow(s, d).edges))
query("o6_intersection", "SELECT src, dst FROM flow_e WHERE kind = 'click' INTERSECT SELECT src, dst FROM flow_e WHERE kind = 'view'", "flow")(lambda s, d: (lambda e: e.where("kind = 'click'").select("src", "dst").intersect(e.where("kind = 'view'").select("src", "dst")))(T.flow(s, d).edges))

# ---- scores


def _rank_sql(v: str, arcs: str, rounds: int, dangling: bool = True) -> str:
    """CTEs r0 .. r<rounds> of (id, score); arcs: (src, dst, n)."""
    parts = [f"arcs AS MATERIALIZED ({arcs})", "deg AS MATERIALIZED (SELECT src, CAST(sum(n) AS DOUBLE) AS deg FROM arcs GROUP BY src)", f"cnt AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM {v})", f"r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM cnt) AS score FROM {v})"]
    lost = "(SELECT coalesce(sum(score), 0) FROM r{0} WHERE id NOT IN (SELECT src FROM deg))" if dangling else "0.0"
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT n FROM cnt) + 0.85 * {lost.format(i - 1)} / (SELECT n FROM cnt) + 0.85 * coalesce(x.s, 0) AS score FROM {v} v LEFT JOIN (SELECT a.dst, sum(r.score * a.n / deg.deg) AS s FROM arcs a JOIN deg ON deg.src = a.src JOIN r{i - 1} r ON r.id = a.src GROUP BY a.dst) x ON x.dst = v.id)")
    return ", ".join(parts)


MULTI = "SELECT src, dst, count(*) AS n FROM {0} GROUP BY src, dst"
MIRROR = "SELECT DISTINCT src, dst, 1 AS n FROM (SELECT src, dst FROM {0} UNION ALL SELECT dst, src FROM {0}) WHERE src <> dst"

query("g1_pagerank", "SELECT id, round(score, 9) AS score FROM r10", "trade", extra=_rank_sql("trade_v", MULTI.format("trade_e"), 10))(lambda s, d: _rounded(ranking.pagerank(T.trade(s, d), 10), 9, "score"))
query("g2_pagerank_undirected", "SELECT id, round(score, 9) AS score FROM r8", "geo", extra=_rank_sql("geo_v", MIRROR.format("geo_e"), 8))(lambda s, d: _rounded(ranking.pagerank(T.geo(s, d), 8, view="undirected", tol=0.0), 9, "score"))
query("g3_pagerank_simple", "SELECT id, round(score, 9) AS score FROM r8", "flow", extra=_rank_sql("flow_v", "SELECT DISTINCT src, dst, 1 AS n FROM flow_e", 8))(lambda s, d: _rounded(ranking.pagerank(T.flow(s, d), 8, view="simple"), 9, "score"))


def _settled(rounds: int, tol: float) -> str:
    """The scores of the first of r1 .. r<rounds> that no score moved more than tol to."""
    gaps = " UNION ALL ".join(f"SELECT {i} AS k, max(abs(a.score - b.score)) AS gap FROM r{i} a JOIN r{i - 1} b ON b.id = a.id" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS k, id, score FROM r{i}" for i in range(1, rounds + 1))
    return f"SELECT id, round(score, 9) AS score FROM ({every}) WHERE k = (SELECT min(k) FROM ({gaps}) WHERE gap <= {tol})"


query("g2_pagerank_until", _settled(16, 1e-5), "flow", extra=_rank_sql("flow_v", MIRROR.format("flow_e"), 16))(lambda s, d: _rounded(ranking.pagerank(T.flow(s, d), 16, view="undirected", tol=1e-5), 9, "score"))
query("g5_pagerank_normalised", "SELECT id, round(score / (SELECT sum(score) FROM r4), 9) AS score FROM r4", "geo", extra=_rank_sql("geo_v", MULTI.format("geo_e"), 4, dangling=False))(lambda s, d: _rounded(ranking.pagerank(T.geo(s, d), 4, dangling="ignore", normalise=True), 9, "score"))
query("g6_pagerank_no_dangling", "SELECT id, round(score, 9) AS score FROM r5", "geo", extra=_rank_sql("geo_v", MULTI.format("geo_e"), 5, dangling=False))(lambda s, d: _rounded(ranking.pagerank(T.geo(s, d), 5, dangling="ignore"), 9, "score"))
query("a5_pagerank_sum", "SELECT 1.0::DOUBLE AS total")(lambda s, d: ranking.pagerank(T.trade(s, d), 3).agg(F.round(F.sum("score"), 9).alias("total")))
query("o1_top_pagerank", "SELECT id, round(score, 9) AS score FROM r10 ORDER BY r10.score DESC, id LIMIT 20", "trade", extra=_rank_sql("trade_v", MULTI.format("trade_e"), 10))(lambda s, d: _rounded(ranking.top(ranking.pagerank(T.trade(s, d), 10), 20), 9, "score"))


def _katz_sql(rounds: int) -> str:
    parts = ["arcs AS MATERIALIZED (" + MIRROR.format("geo_e") + ")", "k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS score FROM geo_v)"]
    for i in range(1, rounds + 1):
        parts.append(f"k{i} AS MATERIALIZED (SELECT v.id, 0.1 * coalesce(x.s, 0) + 1 AS score FROM geo_v v LEFT JOIN (SELECT a.dst, sum(k.score) AS s FROM arcs a JOIN k{i - 1} k ON k.id = a.src GROUP BY a.dst) x ON x.dst = v.id)")
    return ", ".join(parts)


def _eigen_sql(rounds: int) -> str:
    parts = ["arcs AS MATERIALIZED (" + MIRROR.format("flow_e") + ")", "k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS score FROM flow_v)"]
    for i in range(1, rounds + 1):
        parts.append(f"x{i} AS MATERIALIZED (SELECT v.id, coalesce(x.s, 0) AS score FROM flow_v v LEFT JOIN (SELECT a.dst, sum(k.score) AS s FROM arcs a JOIN k{i - 1} k ON k.id = a.src GROUP BY a.dst) x ON x.dst = v.id), k{i} AS MATERIALIZED (SELECT id, score / (SELECT sqrt(sum(score * score)) FROM x{i}) AS score FROM x{i})")
    return ", ".join(parts)


query("g24_katz", "SELECT id, round(score, 6) AS score FROM k5", "geo", extra=_katz_sql(5))(lambda s, d: _rounded(ranking.katz(T.geo(s, d), iterations=5, tol=None), 6, "score"))
query("g25_eigenvector", "SELECT id, round(score, 9) AS score FROM k6", "flow", extra=_eigen_sql(6))(lambda s, d: _rounded(ranking.eigenvector(T.flow(s, d), iterations=6, tol=None), 9, "score"))

# ---- structure

query("g7_weak_components", "SELECT c_custkey + 1000000000 AS id, CAST(n_regionkey AS BIGINT) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey + 2000000000, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey + 1000, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_regionkey FROM region")(lambda s, d: structure.connected_components(T.geo(s, d)))
query("a3_component_count", "SELECT count(*) AS n FROM region")(lambda s, d: structure.connected_components(T.geo(s, d)).agg(F.count_distinct("label").alias("n")))
query("a4_component_members", "SELECT CAST(n_regionkey AS BIGINT) AS label, count(*) + 1 + any_value(k.n) AS n, CAST(n_regionkey AS BIGINT) AS least FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey JOIN (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) k ON k.r = n_regionkey GROUP BY n_regionkey")(lambda s, d: communities.members(structure.connected_components(T.geo(s, d))))
query("a4_component_member_rows", "SELECT CAST(c_nationkey AS BIGINT) AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, CAST(c_custkey AS BIGINT) AS id FROM customer")(lambda s, d: communities.member_rows(T.table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("label"))))
query("t15_component_of", "SELECT c_custkey + 1000000000 AS id FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 0 UNION ALL SELECT s_suppkey + 2000000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 0 UNION ALL SELECT n_nationkey + 1000 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 0")(lambda s, d: communities.community_of(structure.connected_components(T.geo(s, d)), 0))
flow_query("g9_strong_components", "SELECT v.id, least(v.id, coalesce(min(c.b), v.id)) AS label FROM flow_v v LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) c ON c.a = v.id GROUP BY v.id", "flow", extra="reach AS (SELECT src AS a, dst AS b FROM flow_e UNION SELECT r.a, e.dst FROM reach r JOIN flow_e e ON e.src = r.b)", recursive=True)(lambda g: structure.strongly_connected_components(g))
query("g10_cores", "SELECT v.id, (SELECT count(*) FROM trade_e WHERE src = v.id) AS core FROM trade_v v", "trade")(lambda s, d: structure.cores(T.trade(s, d)))  # no customer is anybody's target


def _core_sql(v: str, e: str, rounds: int) -> str:
    """CTEs c0 .. c<rounds> of (id, core): h-indices of the neighbours' values from the degrees down."""
    parts = [f"nb AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}) WHERE src <> dst)", f"c0 AS MATERIALIZED (SELECT v.id, coalesce(n, 0) AS core FROM {v} v LEFT JOIN (SELECT src, count(*) AS n FROM nb GROUP BY src) x ON x.src = v.id)"]
    for i in range(1, rounds + 1):
        counts = f"SELECT nb.dst AS id, least(a.core, b.core) AS val, count(*) AS n FROM nb JOIN c{i - 1} a ON a.id = nb.src JOIN c{i - 1} b ON b.id = nb.dst GROUP BY 1, 2"
        parts.append(f"c{i} AS MATERIALIZED (SELECT c.id, least(c.core, coalesce(h.h, 0)) AS core FROM c{i - 1} c LEFT JOIN (SELECT id, max(least(val, s)) AS h FROM (SELECT id, val, sum(n) OVER (PARTITION BY id ORDER BY val DESC) AS s FROM ({counts})) GROUP BY id) h ON h.id = c.id)")
    return ", ".join(parts)


#: Rounds after which the values stand still at the small scale factors (the Spark loop runs until they do).
CORE_ROUNDS = 40
query("g11_k_core", f"SELECT id, CAST(core AS BIGINT) AS core FROM c{CORE_ROUNDS}", "flow", extra=_core_sql("flow_v", "flow_e", CORE_ROUNDS))(lambda s, d: structure.k_core(T.flow(s, d)))
query("g11_k_core_copurchase", f"SELECT id, CAST(core AS BIGINT) AS core FROM c{CORE_ROUNDS}", "copurchase", extra=_core_sql("copurchase_v", "copurchase_e", CORE_ROUNDS))(lambda s, d: structure.k_core(T.copurchase(s, d)))


def _draw_sql(key: str, turn: int) -> str:
    low, high = f"({key} % 1000003)", f"(({key} // 1000003) % 1000003)"
    return f"((({low} * 7919 + {high} * 104729) * 31 + ({low} // 257) * 9973 + {turn * 40_503}) % 65537)"


def _brandes_sql(v: str, arcs: str, k: int, depth: int) -> str:
    """CTEs of Brandes' levels from the k vertices of the smallest draws; dep has (id, x), a row for each source and vertex."""
    parts = [f"arcs AS MATERIALIZED ({arcs})", f"l0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS paths FROM {v} ORDER BY {_draw_sql('id', 42)}, id LIMIT {k})", "seen0 AS (SELECT s, id FROM l0)"]
    for i in range(1, depth + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT x.s, x.id, x.paths FROM (SELECT l.s, a.dst AS id, sum(l.paths * a.n) AS paths FROM l{i - 1} l JOIN arcs a ON a.src = l.id GROUP BY 1, 2) x ANTI JOIN seen{i - 1} y ON y.s = x.s AND y.id = x.id)")
        parts.append(f"seen{i} AS MATERIALIZED (SELECT * FROM seen{i - 1} UNION ALL SELECT s, id FROM l{i})")
    parts.append(f"b{depth} AS MATERIALIZED (SELECT s, id, paths, 0.0::DOUBLE AS delta FROM l{depth})")
    for i in range(depth - 1, -1, -1):
        parts.append(f"b{i} AS MATERIALIZED (SELECT l.s, l.id, l.paths, l.paths * coalesce(u.u, 0) AS delta FROM l{i} l LEFT JOIN (SELECT b.s, a.src AS id, sum((1 + b.delta) / b.paths * a.n) AS u FROM b{i + 1} b JOIN arcs a ON a.dst = b.id GROUP BY 1, 2) u ON u.s = l.s AND u.id = l.id)")
    parts.append("dep AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, id, delta AS x FROM b{i}" for i in range(depth + 1)) + ")")
    return ", ".join(parts)


COUNTED = "SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM flow_e WHERE src <> dst GROUP BY src, dst"
BOTH = "SELECT DISTINCT src, dst, 1.0::DOUBLE AS n FROM (SELECT src, dst FROM flow_e UNION ALL SELECT dst, src FROM flow_e) WHERE src <> dst"
BETWEEN = "SELECT v.id, round(coalesce(x.x, 0) * {0}, 9) AS score FROM flow_v v LEFT JOIN (SELECT id, sum(x) AS x FROM dep {1} GROUP BY id) x ON x.id = v.id, (SELECT CAST(count(*) AS DOUBLE) AS n FROM flow_v) c"
query("g12_betweenness", BETWEEN.format("(c.n / least(64, c.n)) / ((c.n - 1) * (c.n - 2))", ""), "flow", extra=_brandes_sql("flow_v", COUNTED, 64, 6))(lambda s, d: _rounded(structure.betweenness(T.flow(s, d), 64), 9, "score"))
query("g13_betweenness_sample", BETWEEN.format("(c.n / least(13, c.n)) / 2", "WHERE s <> id"), "flow", extra=_brandes_sql("flow_v", BOTH, 13, 6))(lambda s, d: _rounded(structure.betweenness(T.flow(s, d), 13, directed=False, include_source=False, scale="half"), 9, "score"))
TREE = "SELECT v.id, round(CASE WHEN v.kind = 'nation' THEN (SELECT count(*) FROM geo_e e WHERE e.dst = v.id) ELSE 0.0 END * 2.0 / ((c.n - 1.0) * (c.n - 2.0)), 12) AS score FROM geo_v v, (SELECT count(*) AS n FROM geo_v) c"
query("g14_betweenness_exact", TREE, "geo")(lambda s, d: _rounded(structure.betweenness(T.geo(s, d), None, include_source=False, scale="exact", batch=4_096), 12, "score"))
UND = "u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {0} WHERE src <> dst)"
TRI = "t AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b)"
query("g21_triangles", "SELECT count(*) AS n, CAST(sum(a + b + c) AS BIGINT) AS ends FROM t", "copurchase", extra=UND.format("copurchase_e") + ", " + TRI)(lambda s, d: structure.triangles(T.copurchase(s, d).undirected()).agg(F.count("*").alias("n"), F.sum(F.col("a") + F.col("b") + F.col("c")).alias("ends")))
flow_query("g22_directed_triangles", "SELECT a, b, c FROM t WHERE ((a, b) IN (FROM p) AND (a, c) IN (FROM p)) OR ((b, a) IN (FROM p) AND (b, c) IN (FROM p)) OR ((c, a) IN (FROM p) AND (c, b) IN (FROM p))", "flow", extra=UND.format("flow_e") + ", " + TRI + ", p AS MATERIALIZED (SELECT DISTINCT src, dst FROM flow_e)")(lambda g: structure.directed_triangles(g))
CLUSTER = "SELECT v.id, coalesce(d.d, 0) AS degree, coalesce(k.t, 0) AS triangles, round(CASE WHEN coalesce(d.d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(k.t, 0) / (d.d * (d.d - 1.0)) END, 9) AS coefficient FROM {0} v LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id) d ON d.id = v.id LEFT JOIN (SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id) k ON k.id = v.id"
flow_query("g23_clustering", CLUSTER.format("flow_v"), "flow", extra=UND.format("flow_e") + ", " + TRI)(lambda g: _rounded(structure.clustering(g), 9, "coefficient"))

# ---- communities



def _sweep_sql(name: str, arcs: str, sweeps: int, gain: str) -> str:
    """CTEs <name>s0 .. of (id, k, label) by local moves over symmetric arcs (src, dst, w), and <name> (id, label) with smallest members as labels."""
    n = name
    parts = [f"{n}s0 AS MATERIALIZED (SELECT src AS id, sum(w) AS k, src AS label FROM {arcs} GROUP BY src)", f"{n}m AS MATERIALIZED (SELECT sum(w) AS two_m FROM {arcs})"]
    for i in range(sweeps):
        parts += [
            f"{n}t{i} AS MATERIALIZED (SELECT label, sum(k) AS s FROM {n}s{i} GROUP BY label)",
            f"{n}n{i} AS MATERIALIZED (SELECT a.src AS id, s.label, sum(a.w) AS w FROM {arcs} a JOIN {n}s{i} s ON s.id = a.dst WHERE a.src <> a.dst GROUP BY 1, 2)",
            f"{n}g{i} AS MATERIALIZED (SELECT id, label, {gain} AS gain FROM (SELECT x.id, x.label, x.w, h.k, coalesce(i.w, 0.0) AS inside, t.s, c.s AS s_c FROM {n}n{i} x JOIN {n}s{i} h ON h.id = x.id AND {_draw_sql('h.id', i)} % 2 = 0 AND x.label <> h.label LEFT JOIN {n}n{i} i ON i.id = x.id AND i.label = h.label JOIN {n}t{i} t ON t.label = x.label JOIN {n}t{i} c ON c.label = h.label), {n}m)",
            f"{n}s{i + 1} AS MATERIALIZED (SELECT s.id, s.k, coalesce(b.label, s.label) AS label FROM {n}s{i} s LEFT JOIN (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, label) AS r FROM {n}g{i} WHERE gain > 1e-12) WHERE r = 1) b ON b.id = s.id)",
        ]
    parts.append(f"{n} AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY label) AS label FROM {n}s{sweeps})")
    return ", ".join(parts)


WEIGHTS = "w0 AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src, dst FROM flow_e UNION ALL SELECT dst, src FROM flow_e) GROUP BY 1, 2)"
LOUVAIN = "(w - inside) / (two_m / 2) - 1.0 * k * (s + k - s_c) / (two_m * two_m / 2)"
ONE_LEVEL = "(w - inside) / two_m - k * (s + k - s_c) / (two_m * two_m * 1.0)"
flow_query("g15_louvain", "SELECT f.id, coalesce(p2.label, f.label) AS label FROM p1 f LEFT JOIN p2 ON p2.id = f.label", "flow", extra=f"{WEIGHTS}, {_sweep_sql('p1', 'w0', 3, LOUVAIN)}, w1 AS MATERIALIZED (SELECT a.label AS src, b.label AS dst, sum(w) AS w FROM w0 JOIN p1 a ON a.id = w0.src JOIN p1 b ON b.id = w0.dst GROUP BY 1, 2), {_sweep_sql('p2', 'w1', 3, LOUVAIN)}")(lambda g: communities.louvain(g, 1.0, phases=2, sweeps=3)[0])
flow_query("g16_louvain_one_level", "SELECT id, label FROM p1", "flow", extra=f"{WEIGHTS}, {_sweep_sql('p1', 'w0', 4, ONE_LEVEL)}")(lambda g: communities.louvain_one_level(g, sweeps=4))
query("g17_greedy_merge", "SELECT c_custkey + 1000000000 AS id, CAST(n_regionkey AS BIGINT) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey + 2000000000, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey + 1000, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_regionkey FROM region")(lambda s, d: communities.greedy_merge(T.geo(s, d)))
query("g17_greedy_merge_some", "SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS label FROM (SELECT id, CASE WHEN r <= 7 THEN region ELSE id END AS least FROM (SELECT CAST(n_nationkey + 1000 AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation UNION ALL SELECT r_regionkey, r_regionkey, 1000 FROM region UNION ALL SELECT id, 0, 1000 FROM geo_v WHERE id >= 1000000))", "geo")(lambda s, d: communities.greedy_merge(T.geo(s, d), 7))
flow_query("g18_greedy_move", "SELECT id, label FROM m4", "flow", extra=WEIGHTS + ", m0 AS MATERIALIZED (SELECT id, id AS label FROM flow_v), " + ", ".join(f"m{i + 1} AS MATERIALIZED (SELECT v.id, CASE WHEN {_draw_sql('v.id', i)} % 2 = 0 THEN coalesce(b.label, v.label) ELSE v.label END AS label FROM m{i} v LEFT JOIN (SELECT id, label FROM (SELECT w0.dst AS id, m.label, row_number() OVER (PARTITION BY w0.dst ORDER BY sum(w) DESC, m.label) AS r FROM w0 JOIN m{i} m ON m.id = w0.src WHERE w0.src <> w0.dst GROUP BY 1, 2) WHERE r = 1) b ON b.id = v.id)" for i in range(4)))(lambda g: communities.greedy_move(g, 4))
query("g19_modularity", "SELECT round(sum(inside / total - (ends / total) * (ends / total)), 9) AS q FROM (SELECT ls, sum(w) AS ends, sum(CASE WHEN ls = ld THEN w ELSE 0 END) AS inside FROM (SELECT src % 5 AS ls, dst % 5 AS ld, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src, dst FROM flow_e UNION ALL SELECT dst, src FROM flow_e) GROUP BY 1, 2) GROUP BY ls), (SELECT CAST(2 * count(*) AS DOUBLE) AS total FROM flow_e)", "flow")(lambda s, d: (lambda g: _rounded(communities.modularity(g, g.vertices.select("id", (F.col("id") % 5).alias("label"))), 9, "q"))(T.flow(s, d)))
query("g19_modularity_edges", "SELECT round(sum((CASE WHEN a.src % 5 = a.dst % 5 THEN 1.0 ELSE 0.0 END - ks.k * coalesce(kd.k, 0) / (2 * m.m)) / (2 * m.m)), 9) AS q FROM a JOIN k ks ON ks.src = a.src LEFT JOIN k kd ON kd.src = a.dst, (SELECT 2.0 * count(*) AS m FROM a) m", "flow", extra="a AS (SELECT DISTINCT src, dst FROM flow_e), k AS (SELECT src, count(*) AS k FROM a GROUP BY src)")(lambda s, d: (lambda g: _rounded(communities.modularity(g, g.vertices.select("id", (F.col("id") % 5).alias("label")), form="edges"), 9, "q"))(T.flow(s, d)))


def _labels_sql(rounds: int) -> str:
    parts = ["arcs AS MATERIALIZED (SELECT src, dst FROM (" + MIRROR.format("flow_e") + "))", "p0 AS MATERIALIZED (SELECT id, id AS label FROM flow_v)"]
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS MATERIALIZED (SELECT v.id, coalesce(x.label, v.label) AS label FROM p{i - 1} v LEFT JOIN (SELECT id, label FROM (SELECT a.dst AS id, p.label, row_number() OVER (PARTITION BY a.dst ORDER BY count(*) DESC, p.label) AS k FROM arcs a JOIN p{i - 1} p ON p.id = a.src GROUP BY a.dst, p.label) WHERE k = 1) x ON x.id = v.id)")
    return ", ".join(parts)


flow_query("g20_label_propagation", "SELECT id, label FROM p4", "flow", extra=_labels_sql(4))(lambda g: communities.label_propagation(g, 4))

# ---- delta versions: the new edges are those whose eid is divisible by 10 (by 1000 in the larger graphs)


def _split(g: PropertyGraph, by: int) -> tuple[PropertyGraph, DataFrame]:
    return PropertyGraph(g.vertices, g._edges.where(f"eid % {by} <> 0")), g.edges.where(f"eid % {by} = 0").select("src", "dst")


@flow_query("d1_incremental_pagerank", "SELECT id, round(score / (SELECT sum(score) FROM r30), 6) AS score FROM r30", "flow", extra=_rank_sql("flow_v", MULTI.format("flow_e"), 30))
def d1(g):
    old, new = _split(g, 10)
    return _rounded(incremental.pagerank(g, ranking.pagerank(old, 10), new, eps=1e-12, rounds=14), 6, "score")


@query("d4_results_by_version", "SELECT unnest([1, 2, 2]) AS version, unnest([(SELECT count(*) FROM region), (SELECT count(*) FROM region) - 1, (SELECT count(*) FROM region) - 1]) AS components, unnest([1, 2, 2]) AS runs")
def d4(s, d):
    own, runs, out = store.GraphStore(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}"), [], []

    def components(g):
        runs.append(1)
        return structure.connected_components(g)

    memo = Memo(own)
    own.publish(T.geo(s, d))
    out.append((own.version(), memo.get("components", components).select("label").distinct().count(), len(runs)))
    with own.begin() as tx:
        tx.add_edge(0, 1)  # joins two regions
        tx.commit()
    for _ in range(2):
        out.append((own.version(), memo.get("components", components).select("label").distinct().count(), len(runs)))
    return s.createDataFrame(out, "version int, components long, runs int")


@flow_query("d9_updates", "SELECT count(*) AS n FROM lev8 a LEFT JOIN old8 b ON b.id = a.id WHERE b.dist IS DISTINCT FROM a.dist", "flow", extra=_levels("flow_e", "3", 8) + ", o AS MATERIALIZED (SELECT * FROM flow_e WHERE eid % 2 <> 0), " + _levels("o", "3", 8).replace("lev", "old"))
def d9(g):
    old, new = _split(g, 2)
    before = cut(traverse.bfs(old, old.vertex(3)))
    return g.spark.createDataFrame([(incremental.updates(before, incremental.bfs(g, before, new), "dist"),)], "n long")


@query("d10_merges", "SELECT (SELECT count(*) FROM geo_e WHERE eid % 10 = 0) AS merges", "geo")
def d10_merges(s, d):
    old, new = _split(T.geo(s, d), 10)  # in a forest every edge joins two components
    return s.createDataFrame([(incremental.connected_components(structure.connected_components(old), new)[1],)], "merges long")


@flow_query("d5_incremental_bfs", "SELECT id, CAST(dist AS BIGINT) AS dist FROM lev24", "flow", extra=_levels("flow_e", "3", 24))
def d5(g):
    old, new = _split(g, 10)
    return incremental.bfs(g, traverse.bfs(old, old.vertex(3)), new).select("id", "dist")


@flow_query("d7_incremental_sssp", "SELECT id, CAST(dist AS DOUBLE) AS dist FROM d24", "flow", extra=_bellman(24))
def d7(g):
    g = PropertyGraph(g.vertices, g.edges.withColumn("weight", (1 + (F.col("src") * 7 + F.col("dst") * 3) % 11).cast("double")))
    old, new = _split(g, 10)
    return incremental.sssp(g, traverse.sssp(old, old.vertex(3)), new).select("id", "dist")


@query("d10_incremental_components", "SELECT CAST(n_regionkey AS BIGINT) AS label, count(*) + 1 + any_value(k.n) AS n FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey JOIN (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) k ON k.r = n_regionkey GROUP BY n_regionkey")
def d10(s, d):
    g = T.geo(s, d)
    old, new = _split(g, 10)
    return incremental.connected_components(structure.connected_components(old), new)[0].groupBy("label").agg(F.count("*").alias("n"))


NEW_TRI = "SELECT a, b, c FROM t WHERE EXISTS (SELECT 1 FROM flow_e n WHERE n.eid % 10 = 0 AND ((least(n.src, n.dst) = a AND greatest(n.src, n.dst) IN (b, c)) OR (least(n.src, n.dst) = b AND greatest(n.src, n.dst) = c)))"
flow_query("d11_incremental_triangles", NEW_TRI, "flow", extra=UND.format("flow_e") + ", " + TRI)(lambda g: incremental.triangles(g, _split(g, 10)[1]))
OLD = "old_e AS (SELECT * FROM flow_e WHERE eid % 10 <> 0), ou AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM old_e WHERE src <> dst)"
flow_query("d12_triangle_difference", "SELECT a, b, c FROM t EXCEPT SELECT x.a, x.b, y.b FROM ou x JOIN ou y ON x.b = y.a JOIN ou z ON z.a = x.a AND z.b = y.b", "flow", extra=UND.format("flow_e") + ", " + TRI + ", " + OLD)(lambda g: incremental.triangles_difference(structure.triangles(_split(g, 10)[0].undirected()), structure.triangles(g.undirected())))


@flow_query("d13_incremental_clustering", CLUSTER.format("flow_v"), "flow", extra=UND.format("flow_e") + ", " + TRI)
def d13(g):
    old, new = _split(g, 10)
    return _rounded(incremental.clustering(g, structure.clustering(old), new), 9, "coefficient")


@query("d14_incremental_katz", "SELECT id, round(score, 6) AS score FROM k24", "flow", extra="a0 AS MATERIALIZED (" + MIRROR.format("flow_e") + "), k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS score FROM flow_v), " + ", ".join(f"k{i} AS MATERIALIZED (SELECT v.id, 0.002 * coalesce(x.s, 0) + 1 AS score FROM flow_v v LEFT JOIN (SELECT a.dst, sum(k.score) AS s FROM a0 a JOIN k{i - 1} k ON k.id = a.src GROUP BY a.dst) x ON x.dst = v.id)" for i in range(1, 25)))
def d14(s, d):
    g = T.flow(s, d)
    old, _ = _split(g, 10)
    return _rounded(incremental.katz(g, ranking.katz(old, alpha=0.002, iterations=6, tol=None), alpha=0.002, iterations=20, tol=1e-10), 6, "score")


@query("d15_incremental_eigenvector", "SELECT id, round(score, 6) AS score FROM k30", "flow", extra=_eigen_sql(30))
def d15(s, d):
    g = T.flow(s, d)
    old, _ = _split(g, 10)
    return _rounded(incremental.eigenvector(g, ranking.eigenvector(old, iterations=6, tol=None), iterations=30, tol=1e-10), 6, "score")


@query("d16_k_core_members", f"SELECT a.id, CASE WHEN a.core >= 60 THEN 0 ELSE 1 END - CASE WHEN b.core >= 60 THEN 0 ELSE 1 END AS change FROM c{CORE_ROUNDS} a JOIN n{CORE_ROUNDS} b ON b.id = a.id WHERE (a.core >= 60) <> (b.core >= 60)", "flow", extra=_core_sql("flow_v", "flow_e", CORE_ROUNDS) + ", e2 AS MATERIALIZED (SELECT * FROM flow_e WHERE eid % 3 <> 0), " + re.sub(r"\bc(\d+)\b", r"n\1", _core_sql("flow_v", "e2", CORE_ROUNDS)).replace("nb", "nb2"))
def d16(s, d):
    g = T.flow(s, d)
    left, _ = _split(g, 3)
    before = structure.k_core(g)
    return incremental.core_members(before, incremental.k_core(left, before, added=0)[0], 60)


@query("d17_core_changes", "SELECT CAST(count(*) AS BIGINT) AS changed FROM (SELECT id FROM (SELECT src AS id FROM geo_e UNION SELECT dst FROM geo_e) EXCEPT SELECT id FROM (SELECT src AS id FROM geo_e WHERE eid % 10 <> 0 UNION SELECT dst FROM geo_e WHERE eid % 10 <> 0))", "geo")
def d17(s, d):
    g = T.geo(s, d)
    old, _ = _split(g, 10)
    _, n = incremental.k_core(g, structure.k_core(old))
    return s.createDataFrame([(n,)], "changed long")


# ---- sources, sinks, the store


@query("s1_edge_list", "SELECT (SELECT max(greatest(src, dst)) + 1 FROM flow_e) AS n_vertices, count(*) AS n_edges FROM flow_e WHERE src <> dst", "flow")
def s1(s, d):
    path = f"{shared_dir(s)}/edge-list-{id(d)}-{len(d)}"
    g = T.flow(s, d)
    g.edges.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(path)
    return files.read_edge_list(s, path).stats().select("n_vertices", "n_edges")


query("s15_dot", "SELECT 0 AS part, 0 AS place, 'digraph G {' AS line UNION ALL SELECT 0, 1, '  node [shape=circle, style=filled];' UNION ALL SELECT 3, 0, '}' UNION ALL SELECT 1, v.id, '  ' || v.id || ' [label=\"' || replace(v.name, '\"', '\\\"') || '\", fillcolor=\"' || ['#FF6B6B', '#4ECDC4', '#45B7D1', '#96CEB4', '#FFEAA7'][r.region + 1] || '\"];' FROM geo_v v JOIN (SELECT r_regionkey AS id, r_regionkey AS region FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey FROM nation UNION ALL SELECT e.src, n_regionkey FROM geo_e e JOIN nation ON e.dst = n_nationkey + 1000) r ON r.id = v.id UNION ALL SELECT 2, eid, '  ' || src || ' -> ' || dst || ';' FROM geo_e", "geo")(lambda s, d: files.dot(T.geo(s, d), "name", communities=communities.renumbered(structure.connected_components(T.geo(s, d)))))
query("s17_snapshot", "SELECT id, name AS sid, name AS label, '{\"name\":\"' || name || '\",\"kind\":\"' || kind || '\"}' AS props FROM geo_v", "geo")(lambda s, d: files.snapshot(T.geo(s, d), sid="name")[0])
query("s17_snapshot_edges", "SELECT src, dst, flag AS kind, weight, '{\"flag\":\"' || flag || '\"}' AS props FROM trade_e", "trade")(lambda s, d: files.snapshot(T.trade(s, d), kind="flag")[1])


def _round_trip(s, d, write, read) -> DataFrame:
    path = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    write(T.geo(s, d), path)
    g = read(s, path)
    v = g.vertices.select(F.lit("vertex").alias("what"), F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.concat_ws("|", F.col("properties")["name"], F.col("properties")["kind"]).alias("told"))
    return v.unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("string").alias("told")))


TRIP = "SELECT 'vertex' AS what, id AS a, CAST(-1 AS BIGINT) AS b, name || '|' || kind AS told FROM geo_v UNION ALL SELECT 'edge', src, dst, '1.0' FROM geo_e"
query("s11_json_lines", TRIP, "geo")(lambda s, d: _round_trip(s, d, files.write_json_lines, files.read_json_lines))
query("s11_json_document", TRIP, "geo")(lambda s, d: _round_trip(s, d, files.write_json_document, files.read_json_graph))


def _draw_of(key: str, seed: int, turn: int) -> str:
    x = f"((({key} % 2147483647 + 1) * 48271 + {turn * 69_621 + seed}) % 2147483647)"
    for _ in range(3):
        x = f"(((({x} * 16807) % 2147483647) * 48271 + {turn}) % 2147483647)"
    return f"({x} / 2147483647.0::DOUBLE)"


RANDOM = f"SELECT a AS src, b AS dst, min(id) AS eid FROM (SELECT id, CAST(floor({_draw_of('id', 42, 1)} ** {{0}} * 1000) AS BIGINT) AS a, CAST(floor({_draw_of('id', 42, 2)} ** {{0}} * 1000) AS BIGINT) AS b FROM range(5000) r(id)) WHERE a <> b GROUP BY 1, 2"
query("s22_random_graph", RANDOM.format("2.0"))(lambda s, d: files.random_graph(s, 1_000, 5_000, skew=2.0).edges.select("src", "dst", "eid"))
query("s22_random_undirected", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(eid) AS eid FROM (" + RANDOM.format("1.0") + ") GROUP BY 1, 2")(lambda s, d: files.random_graph(s, 1_000, 5_000, undirected=True).edges.select("src", "dst", "eid"))
query("s24_random_edges", f"SELECT src, dst FROM flow_e UNION ALL (SELECT a.id, b.id FROM (SELECT DISTINCT a, b FROM (SELECT CAST(floor({_draw_of('id', 7, 1)} ** 1.0 * n) AS BIGINT) AS a, CAST(floor({_draw_of('id', 7, 2)} ** 1.0 * n) AS BIGINT) AS b FROM range(3000) r(id), (SELECT count(*) AS n FROM flow_v)) WHERE a <> b) x JOIN p a ON a.r = x.a JOIN p b ON b.r = x.b EXCEPT SELECT src, dst FROM flow_e)", "flow", extra="p AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM flow_v)")(lambda s, d: files.random_edges(T.flow(s, d), 3_000, seed=7).edges.select("src", "dst"))


@query("s19_log_fold", "SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM flow_e WHERE src % 3 <> 0 AND dst % 3 <> 0 UNION ALL SELECT id, id + 1 FROM flow_v WHERE id % 3 = 1) GROUP BY src, dst", "flow")
def s19(s, d):
    g = T.flow(s, d)
    own = cut(g.vertices.select("id"))
    row = lambda tx, op, seq, id, src, dst: own.where(f"id % 3 = {0 if op == 'delete_vertex' else 1}").select(F.lit(op).alias("op"), id.cast("long").alias("id"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("props"), F.lit(tx).alias("tx"), (F.lit(seq) + F.col("id")).cast("long").alias("seq"), F.lit(0).cast("long").alias("at"))
    none = F.lit(None)
    log = row("a", "delete_vertex", 0, F.col("id"), none, none).unionByName(row("b", "add_edge", 0, none, F.col("id"), F.col("id") + 1)).unionByName(row("c", "add_edge", 0, none, F.col("id"), F.col("id")))
    ends = s.createDataFrame([("commit", None, None, None, None, None, "a", 10**9, 0), ("commit", None, None, None, None, None, "b", 10**9, 0), ("rollback", None, None, None, None, None, "c", 10**9, 0)], store.DELTA)
    return store.fold(g, store.replayable(log.unionByName(ends))).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("u9_versions", "SELECT (SELECT count(*) FROM geo_e) AS before, (SELECT count(*) FROM geo_e) + 1 AS after", "geo")
def u9(s, d):
    own = store.GraphStore(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")
    own.publish(T.geo(s, d))
    old = own.snapshot()
    with own.begin() as tx:
        tx.add_edge(0, 1)
        tx.commit()
    return old.edges.agg(F.count("*").alias("before")).crossJoin(own.snapshot().edges.agg(F.count("*").alias("after")))


@query("u7_racing_writers", "SELECT (SELECT count(*) FROM geo_e) + 1 AS edges, 2 AS version, 1 AS refused, 0 AS left_in_log", "geo")
def u7(s, d):
    """Two transactions begin at one version; the second to commit is refused and leaves no trace."""
    own = store.GraphStore(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")
    own.publish(T.geo(s, d))
    first, second = own.begin(), own.begin()
    first.add_edge(0, 1)
    second.add_edge(0, 2)
    second.add_vertex(-7)
    first.commit()
    refused = 0
    try:
        second.commit()
    except store.Conflict:
        refused = 1
    left = own.log().count()
    return own.snapshot().edges.agg(F.count("*").alias("edges")).withColumns({"version": F.lit(own.version()), "refused": F.lit(refused), "left_in_log": F.lit(left).cast("int")})


@query("s18_commit_order", "SELECT CAST(1 AS BIGINT) AS id, '11' AS props, 12 AS edges, 1 AS version")
def s18(s, d):
    """Twelve transactions logged but not published; they are replayed in the order of their commits, once."""
    own = store.GraphStore(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")
    for k in range(12):
        tx = store.Transaction(own)
        tx.add_vertex(1, str(k))
        tx.add_edge(1, k + 2)
        own.write_log(tx.log())
    own.recover()
    own.recover()
    g = own.snapshot()
    return g.vertex(1).crossJoin(g.edges.agg(F.count("*").alias("edges"))).withColumn("version", F.lit(own.version()))


@query("s10_without_recovery", "SELECT CAST(0 AS BIGINT) AS before, CAST(1 AS BIGINT) AS after")
def s10(s, d):
    """A log is left alone by a session that doesn't recover."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    own = store.GraphStore(s, path)
    tx = store.Transaction(own)
    tx.add_vertex(5)
    own.write_log(tx.log())
    return s.createDataFrame([(GraphSession.open_read_only(s, path).vertex_count(), GraphSession.open(s, path).vertex_count())], "before long, after long")
