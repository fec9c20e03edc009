"""PropertyGraph: vertices and edges as DataFrames, and everything that is one pass over them.

vertices: id and any property columns (typed columns are the fast path: they are pruned and pushed down), optionally
props, a map of typed cells.  edges: src, dst, eid (append order, the true key), weight, and any property columns.  The
graph is a directed multigraph; `simple`, `undirected` and `mirrored` are its views.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.plans.iterate import cut, numbered

#: fixed values: the buckets of vertices that lack a property, and of those whose value is no text
MISSING, NO_TEXT = "(无)", "?"


class PropertyGraph:
    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self._vertices, self._edges = vertices, edges

    # ---- building and views

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> PropertyGraph:
        """Missing eid and weight get defaults; endpoints that vertices lack are added without properties."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        if "eid" not in edges.columns:
            edges = edges.withColumn("eid", F.monotonically_increasing_id())
        edges = edges.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        if vertices is None:
            return cls(ends, edges)
        new = ends.join(vertices.select("id"), "id", "left_anti")
        return cls(vertices.unionByName(new, allowMissingColumns=True), edges)

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, eid long, weight double"))

    @property
    def spark(self) -> SparkSession:
        return self._vertices.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self._vertices

    @property
    def edges(self) -> DataFrame:
        """All edges, parallel ones too; a missing weight counts as 1."""
        return self._edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    def pairs(self, loops: bool = True) -> DataFrame:
        """(src, dst, n): parallel edges counted.  Aggregated before it is shuffled, so it shrinks what joins see."""
        own = self._edges if loops else self._edges.where("src <> dst")
        return own.groupBy("src", "dst").agg(F.count("*").alias("n"))

    def simple(self) -> PropertyGraph:
        """Of parallel edges the last stays."""
        rest = [c for c in self._edges.columns if c not in ("src", "dst")]
        last = self.edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "eid").alias("x")).select("src", "dst", "x.*")
        return PropertyGraph(self._vertices, last)

    def undirected(self) -> DataFrame:
        """(a, b) with a < b: each neighbouring pair once, without loops."""
        return self._edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def mirrored(self) -> DataFrame:
        """(src, dst): both directions of undirected()."""
        own = self.undirected()
        return own.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(own.select(F.col("b").alias("src"), F.col("a").alias("dst")))

    # ---- reading and changing single elements

    def vertex(self, v: int) -> DataFrame:
        return self._vertices.where(F.col("id") == v)

    def edges_between(self, a: int, b: int) -> DataFrame:
        """All parallel edges, in append order."""
        return self.edges.where((F.col("src") == a) & (F.col("dst") == b)).orderBy("eid")

    def edge(self, a: int, b: int) -> DataFrame:
        """The last parallel edge."""
        return PropertyGraph(self._vertices, self._edges.where((F.col("src") == a) & (F.col("dst") == b))).simple().edges

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs (src, dst) that are edges."""
        return pairs.join(self._edges.select("src", "dst"), ["src", "dst"], "left_semi")

    def put_vertices(self, rows: DataFrame) -> PropertyGraph:
        """Add vertices or replace all their properties; of equal ids in rows any one may stay."""
        kept = self._vertices.join(rows.select("id"), "id", "left_anti")
        return PropertyGraph(kept.unionByName(rows.dropDuplicates(["id"]), allowMissingColumns=True), self._edges)

    def new_vertices(self, rows: DataFrame, order: str) -> PropertyGraph:
        """Add rows without ids; they get the numbers after the largest, in the order of a column."""
        top = self._vertices.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        return PropertyGraph(self._vertices.unionByName(numbered(rows, order, "id", top + 1), allowMissingColumns=True), self._edges)

    def update_vertices(self, rows: DataFrame) -> PropertyGraph:
        """Replace the properties of vertices that exist; others in rows are ignored."""
        return self.put_vertices(rows.join(self._vertices.select("id"), "id", "left_semi"))

    def add_edges(self, rows: DataFrame) -> PropertyGraph:
        """Append edges (src, dst and perhaps weight and others); missing endpoints are created.

        eids without a value follow the largest; their order is that of src, dst, weight."""
        if "weight" not in rows.columns:
            rows = rows.withColumn("weight", F.lit(1.0))
        if "eid" not in rows.columns:
            top = self._edges.agg(F.coalesce(F.max("eid"), F.lit(-1))).first()[0]
            rows = rows.withColumn("eid", F.lit(top + 1) + F.monotonically_increasing_id())
        return PropertyGraph.from_edges(self._edges.unionByName(rows, allowMissingColumns=True), self._vertices)

    def update_edges(self, rows: DataFrame) -> PropertyGraph:
        """Replace all edges of each pair in rows by the row, or add it."""
        kept = self._edges.join(rows.select("src", "dst"), ["src", "dst"], "left_anti")
        return PropertyGraph(self._vertices, kept).add_edges(rows.dropDuplicates(["src", "dst"]))

    def delete_edges(self, rows: DataFrame) -> PropertyGraph:
        """Without the edges of rows: by eid where rows has that column, else all parallel edges of each (src, dst)."""
        return PropertyGraph(self._vertices, self._edges.join(rows, ["eid"] if "eid" in rows.columns else ["src", "dst"], "left_anti"))

    def delete_vertices(self, ids: DataFrame) -> PropertyGraph:
        """Without the vertices of ids (id) and all their edges."""
        left = self._edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        return PropertyGraph(self._vertices.join(ids, "id", "left_anti"), left)

    def stats(self) -> DataFrame:
        """One row: vertices, edges and blocks (of up to 32 edges of one vertex, in either direction)."""
        degree = self._edges.groupBy("src").agg(F.ceil(F.count("*") / 32).alias("b")).unionAll(self._edges.groupBy("dst").agg(F.ceil(F.count("*") / 32).alias("b")))
        counts = self._vertices.agg(F.count("*").alias("n_vertices")).crossJoin(self._edges.agg(F.count("*").alias("n_edges")))  # one row each
        return counts.crossJoin(degree.agg(F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("n_blocks")))

    def dangling(self) -> DataFrame:
        """Edges with an endpoint that is no vertex."""
        ids = self._vertices.select("id")
        out = self._edges.join(ids, F.col("src") == F.col("id"), "left_anti")
        return out.unionByName(self._edges.join(ids, F.col("dst") == F.col("id"), "left_anti")).dropDuplicates(["eid"])

    # ---- neighbours and degrees

    def out_edges(self, ids: DataFrame | None = None) -> DataFrame:
        """(src, dst, eid, weight, ...) of the given ids (id), all if None."""
        return self.edges if ids is None else self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")

    def in_edges(self, ids: DataFrame | None = None) -> DataFrame:
        return self.edges if ids is None else self.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")

    def out_neighbours(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, neighbour, eid): a row for each out-edge; eid gives the order of a vertex's neighbours."""
        return self.out_edges(ids).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "eid")

    def in_neighbours(self, ids: DataFrame | None = None) -> DataFrame:
        return self.in_edges(ids).select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "eid")

    def detail(self, v: int, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
        """The vertex with all its properties, and its edges: (way, kind, n, other, ...) with n, the vertex's edges of that way
        and kind, the other end's properties as o_..., and the edge's own columns.  A missing kind counts as ""."""
        out = self.edges.where(F.col("src") == v).withColumns({"way": F.lit("out"), "other": F.col("dst")})
        into = self.edges.where(F.col("dst") == v).withColumns({"way": F.lit("in"), "other": F.col("src")})
        rows = out.unionByName(into).withColumn("kind", F.coalesce(F.col(kind).cast("string"), F.lit("")) if kind in self._edges.columns else F.lit(""))
        rows = rows.join(rows.groupBy("way", "kind").agg(F.count("*").alias("n")), ["way", "kind"])
        own = self._vertices.select([F.col(c).alias("other" if c == "id" else f"o_{c}") for c in self._vertices.columns])
        return self.vertex(v), rows.join(own, "other", "left")

    def neighbours(self, ids: DataFrame) -> DataFrame:
        """(id, neighbour): distinct, in both directions."""
        both = self._edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).unionAll(self._edges.select("dst", "src"))
        return both.join(ids.select("id"), "id", "left_semi").distinct()

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex, parallel edges counted."""
        out = self._edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
        into = self._edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        rows = self._vertices.select("id").join(out, "id", "left").join(into, "id", "left")
        return rows.select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))

    def density(self) -> DataFrame:
        """One row: density 2E / V(V - 1) (0 with fewer than two vertices) and average degree 2E / V."""
        own = self._vertices.agg(F.count("*").alias("v")).crossJoin(self._edges.agg(F.count("*").alias("e")))
        return own.select(F.when(F.col("v") < 2, 0.0).otherwise(2.0 * F.col("e") / (F.col("v") * (F.col("v") - 1.0))).alias("density"), F.when(F.col("v") == 0, 0.0).otherwise(2.0 * F.col("e") / F.col("v")).alias("average_degree"))

    def to_csr(self) -> DataFrame:
        """(id, place, first, n): each vertex's rank and its slice of the edges in order of (source rank, eid).

        Ranks are exact over any size: ranges of ids are counted one by one and offset by their predecessors' counts."""
        own = self.degrees().select("id", F.col("out_degree").alias("n")).repartitionByRange("id").withColumn("part", F.spark_partition_id())


        own = cut(own)
        w = W.partitionBy("part").orderBy("id")
        sums = own.groupBy("part").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
        sums = sums.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
        return own.join(F.broadcast(sums), "part").select("id", (F.col("c0") + F.row_number().over(w) - 1).alias("place"), (F.col("s0") + F.sum("n").over(w) - F.col("n")).alias("first"), "n")

    @classmethod
    def from_csr(cls, csr: DataFrame, targets: DataFrame) -> PropertyGraph:
        """From to_csr's rows and targets (place of the edge, dst)."""
        own = csr.where("n > 0").select(F.col("id").alias("src"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("eid"))
        return cls(csr.select("id"), own.join(targets.withColumnRenamed("place", "eid"), "eid").withColumn("weight", F.lit(1.0)))

    # ---- queries

    def find_vertices(self, *conditions: Column, community: tuple[DataFrame, int] | None = None) -> DataFrame:
        """community: labels (id, label) and the label that the vertices must have."""
        own = self._vertices.where(_all(conditions))
        if community is not None:
            labels, wanted = community
            own = own.join(labels.where(F.col("label") == wanted).select("id"), "id", "left_semi")
        return own

    def find_edges(self, *conditions: Column, src: int | None = None, dst: int | None = None) -> DataFrame:
        own = list(conditions)
        if src is not None:
            own.append(F.col("src") == src)
        if dst is not None:
            own.append(F.col("dst") == dst)
        return self.edges.where(_all(own))

    def find_neighbours(self, ids: DataFrame, *conditions: Column) -> DataFrame:
        """Undirected neighbours (id, and the neighbour's columns as n_...) that meet the conditions on vertex columns."""
        own = self._vertices.where(_all(conditions))
        return self.neighbours(ids).join(own.select([F.col(c).alias("neighbour" if c == "id" else f"n_{c}") for c in own.columns]), "neighbour")

    def induced(self, ids: DataFrame) -> PropertyGraph:
        """The subgraph of the given vertices."""
        ids = ids.select("id").distinct()
        kept = self._edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self._vertices.join(ids, "id", "left_semi"), kept)

    def aggregate(self, value: Column) -> DataFrame:
        """One row of count, sum, avg, min and max of a numeric column over the vertices that have it; none if none has."""
        own = self._vertices.select(value.cast("double").alias("x")).where("x is not null")
        return own.agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most")).where("n > 0")

    def group_counts(self, *keys: str) -> DataFrame:
        """(keys ..., n): vertices by properties, of the map `props` or of text columns.  Vertices that lack one are in the
        bucket MISSING, those whose value is no text in the bucket NO_TEXT."""

        def bucket(key: str) -> Column:
            if key not in self._vertices.columns and "props" in self._vertices.columns:
                c = P.get("props", key)
                return F.when(c.isNull(), MISSING).when(c["t"] == P.STRING, c["s"]).otherwise(NO_TEXT)
            text = dict(self._vertices.dtypes)[key] == "string"
            return F.when(F.col(key).isNull(), MISSING).otherwise(F.col(key) if text else F.lit(NO_TEXT))

        return self._vertices.groupBy(*[bucket(k).alias(k) for k in keys]).agg(F.count("*").alias("n"))

    def match(self, binds: list[tuple[str, Column | None]], steps: list[tuple[str, Column | str | None]], first_only: bool = False, parallel: bool = False) -> DataFrame:
        """Pattern a - step - b - step - c ...: binds names and vertex predicates, steps ("out" or "in", edge predicate or the edge's kind).

        A row for each embedding of the vertices, as columns named by the binds; with parallel one for each embedding of the
        edges too, so parallel edges repeat a row.  first_only keeps the smallest for each first vertex."""
        if len(binds) != len(steps) + 1:
            raise ValueError("a pattern ends in a bound vertex")

        def bound(name: str, condition: Column | None) -> DataFrame:
            own = self._vertices if condition is None else self._vertices.where(condition)
            return own.select(F.col("id").alias(name))

        rows = bound(*binds[0])
        for (name, condition), (way, over), (last, _) in zip(binds[1:], steps, binds):
            own = self._edges if over is None else self._edges.where(F.col("kind") == over if isinstance(over, str) else over)
            a, b = ("src", "dst") if way == "out" else ("dst", "src")
            hop = own.select(F.col(a).alias(last), F.col(b).alias(name))
            hop = hop if parallel else hop.distinct()
            rows = rows.join(hop, last)
            if condition is not None:
                rows = rows.join(bound(name, condition), name, "left_semi")
        rows = rows.select(*[n for n, _ in binds])
        if first_only:
            rest = [n for n, _ in binds[1:]]
            rows = rows.groupBy(binds[0][0]).agg(F.min(F.struct(*rest)).alias("x")).select(binds[0][0], "x.*")
        return rows


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


