"""Named property indexes: inverted tables on disk, kept up with the vertices' changes.

An index is a folder of its own, indexes/<name>, with definition, base and layers.  The base has a row (cell, bucket, id) for each vertex that has
the property, partitioned by a hash of the typed value and sorted by it, so a lookup opens one partition and skips row groups.  A change
writes a layer: the ids that it touches with their new cells (null where the property or the vertex is gone).  The newest layer of an id
counts.  Lookups read the layers too; compaction (rebuild, or more than MAX_LAYERS layers) folds them into a new base.

Values are compared as typed cells: the text "3", the Int 3 and the Double 3.0 are three values.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.plans.graph import PropertyGraph

BUCKETS = 64
MAX_LAYERS = 8
ENTRY = "t tinyint, value string, id long, layer int, bucket int"


class DuplicateValue(ValueError):
    """A value of a unique index has two owners."""


def _flat(cell: Column) -> tuple[Column, Column]:
    """Tag and canonical text of a cell: numbers by their bits, so that values are equal where their types and bits are."""
    value = F.when(cell["t"] == P.INT, cell["i"].cast("string")).when(cell["t"] == P.STRING, cell["s"]).when(cell["t"] == P.BOOL, cell["b"].cast("string"))
    bits = F.hex(F.encode(cell["d"].cast("string"), "UTF-8"))
    return cell["t"].cast("tinyint"), F.coalesce(value, F.when(cell["t"] == P.DOUBLE, bits), F.lit(""))


def cells(vertices: DataFrame, key: str) -> DataFrame:
    """(id, cell) of the vertices that have a property: of the map `props` if there is one, else of the typed column (null: it has none)."""
    if key in vertices.columns and key != "props":
        own = vertices.where(F.col(key).isNotNull()).select("id", P.packed(x=F.col(key)).alias("p"))
        return own.select("id", P.get("p", "x").alias("cell"))
    if "props" not in vertices.columns:
        return vertices.select("id", F.lit(None).cast(P.CELL).alias("cell")).limit(0)
    return vertices.select("id", P.get("props", key).alias("cell")).where("cell is not null")


class IndexRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _write(self, name: str, definition: dict) -> None:
        """The definition as a new file that takes the old one's place at once."""
        new = self._at(name, f"definition-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(definition).encode()))
        out.close()
        self._fs.delete(self._at(name, "definition"), False)
        self._fs.rename(new, self._at(name, "definition"))

    def definition(self, name: str) -> dict:
        """name, key, unique, and the folders that make up the index."""
        if not self.exists(name):
            raise KeyError(f"no index {name}")
        stream = self._fs.open(self._at(name, "definition"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # ---- the registry

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name, "definition"))

    def names(self) -> list[str]:
        return [n for n in sorted(s.getPath().getName() for s in self._fs.listStatus(self._at())) if self.exists(n)] if self._fs.exists(self._at()) else []

    def create(self, name: str, key: str, vertices: DataFrame, unique: str | None = None) -> None:
        """Index the property `key` of all vertices.  unique: None; "evict", the value's last owner stays (at one time: the largest id);
        "error", a second owner raises DuplicateValue.  ValueError if the name is taken."""
        if self.exists(name):
            raise ValueError(f"the index {name} exists")
        self._fs.mkdirs(self._at(name))
        self._base(name, {"name": name, "key": key, "unique": unique}, self._entries(cells(vertices, key), 0))

    def drop(self, name: str) -> None:
        """KeyError if there is none."""
        self.definition(name)
        self._fs.delete(self._at(name), True)

    def has(self, key: str) -> bool:
        """Whether any index is on this property."""
        return any(self.definition(n)["key"] == key for n in self.names())

    # ---- contents

    @staticmethod
    def _entries(own: DataFrame, layer: int) -> DataFrame:
        tag, value = _flat(F.col("cell"))
        own = own.select(F.when(F.col("cell").isNotNull(), tag).alias("t"), F.when(F.col("cell").isNotNull(), value).alias("value"), "id", F.lit(layer).alias("layer"))
        return own.withColumn("bucket", F.pmod(F.xxhash64("t", "value"), F.lit(BUCKETS)).cast("int"))

    def _base(self, name: str, definition: dict, entries: DataFrame) -> None:
        unique = definition["unique"]
        if unique:
            owner = entries.groupBy("t", "value").agg(F.max(F.struct("layer", "id")).alias("x"), F.count("*").alias("n"))
            if unique == "error" and owner.where("n > 1").take(1):
                raise DuplicateValue(f"a value of {definition['key']} has two owners")
            entries = entries.join(owner.select("t", "value", F.col("x.id").alias("id")), ["t", "value", "id"], "left_semi").select("t", "value", "id", "layer", "bucket")
        folder = f"base-{uuid.uuid4().hex}"
        rows = entries.withColumn("layer", F.lit(0)).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "t", "value", "id")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
        old = definition.get("folders", [])
        self._write(name, definition | {"folders": [folder]})
        for f in old:
            self._fs.delete(self._at(name, f), True)

    def entries(self, name: str) -> DataFrame:
        """(t, value, id, layer, bucket) of all that is indexed now."""
        folders = self.definition(name)["folders"]
        read = lambda f: self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}/{f}")
        base = read(folders[0])
        if len(folders) == 1:
            return base
        changed = read(folders[1])
        for f in folders[2:]:
            changed = changed.unionByName(read(f))
        newest = changed.groupBy("id").agg(F.max_by(F.struct("t", "value", "layer", "bucket"), "layer").alias("x"))
        return base.join(newest.select("id"), "id", "left_anti").select("t", "value", "id", "layer", "bucket").unionByName(newest.where("x.value is not null").select("x.t", "x.value", "id", "x.layer", "x.bucket"))

    def maintain(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """Follow a change: `changed` holds added and updated vertices as they are now, `deleted` (id) those that are gone."""
        for name in self.names():
            own = self.definition(name)
            now = changed.select("id").join(cells(changed, own["key"]), "id", "left")
            if deleted is not None:
                now = now.unionByName(deleted.select("id", F.lit(None).cast(P.CELL).alias("cell")))
            layer = own.get("layers", 0) + 1
            rows = self._entries(now, layer)
            if own["unique"]:
                before = self.entries(name).join(rows.select("id"), "id", "left_anti")
                taken = rows.where("value is not null").groupBy("t", "value").agg(F.max("id").alias("owner"), F.count("*").alias("n"))
                rivals = before.join(taken, ["t", "value"])
                if own["unique"] == "error" and (taken.where("n > 1").take(1) or rivals.take(1)):
                    raise DuplicateValue(f"a value of {own['key']} has two owners")
                lost = rows.join(taken, ["t", "value"]).where("id <> owner").select("id").unionByName(rivals.select("id"))
                gone = self._entries(lost.distinct().withColumn("cell", F.lit(None).cast(P.CELL)), layer)
                rows = rows.join(lost, "id", "left_anti").select("t", "value", "id", "layer", "bucket").unionByName(gone)
            folder = f"layer-{uuid.uuid4().hex}"
            rows.write.partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
            own |= {"folders": [*own["folders"], folder], "layers": layer}
            self._write(name, own)
            if len(own["folders"]) > MAX_LAYERS + 1:
                self._base(name, own, self.entries(name))

    def rebuild(self, vertices: DataFrame, key: str | None = None) -> None:
        """Index all vertices anew, for the indexes of one property or for all."""
        for name in self.names():
            own = self.definition(name)
            if key in (None, own["key"]):
                self._base(name, own, self._entries(cells(vertices, own["key"]), 0))

    # ---- lookups

    def exact(self, key: str, value: Any) -> DataFrame | None:
        """(id) of the vertices whose property equals a Python value of the same type; None where the property has no index."""
        return self.among(key, [value])

    def among(self, key: str, values: list) -> DataFrame | None:
        """(id), each once; None where the property has no index."""
        name = next((n for n in self.names() if self.definition(n)["key"] == key), None)
        if name is None:
            return None
        asked = self.spark.createDataFrame([(P.cell(v),) for v in values], "cell struct<t:tinyint,i:bigint,d:double,s:string,b:boolean>")
        tag, text = _flat(F.col("cell"))
        wanted = asked.select(tag.alias("t"), text.alias("value")).withColumn("bucket", F.pmod(F.xxhash64("t", "value"), F.lit(BUCKETS)).cast("int")).collect()  # the caller's list
        if not wanted:
            return self.entries(name).select("id").limit(0)
        match = F.lit(False)
        for r in wanted:
            match = match | ((F.col("bucket") == r["bucket"]) & (F.col("t") == r["t"]) & (F.col("value") == r["value"]))
        return self.entries(name).where(F.col("bucket").isin(sorted({r["bucket"] for r in wanted}))).where(match).select("id").distinct()

    def stats(self) -> DataFrame:
        """(name, key, n_values, n_entries) of every index."""
        out = self.spark.createDataFrame([], "name string, key string, n_values long, n_entries long")
        for name in self.names():
            own = self.entries(name).agg(F.count_distinct("t", "value").alias("n_values"), F.count("*").alias("n_entries"))
            out = out.unionByName(own.select(F.lit(name).alias("name"), F.lit(self.definition(name)["key"]).alias("key"), "n_values", "n_entries"))
        return out


class IndexedGraph:
    """A graph whose changes keep its indexes up, and whose lookups use them where there are any."""

    def __init__(self, g: PropertyGraph, indexes: IndexRegistry):
        self.graph, self.indexes = g, indexes

    def put_vertices(self, rows: DataFrame) -> IndexedGraph:
        self.indexes.maintain(rows.dropDuplicates(["id"]))
        return IndexedGraph(self.graph.put_vertices(rows), self.indexes)

    def delete_vertices(self, ids: DataFrame) -> IndexedGraph:
        self.indexes.maintain(self.graph.vertices.limit(0), ids.select("id").distinct())
        return IndexedGraph(self.graph.delete_vertices(ids), self.indexes)

    def find(self, key: str, value: Any) -> DataFrame:
        """The vertices with this value: by the index, or by a scan."""
        ids = self.indexes.exact(key, value)
        if ids is not None:
            return self.graph.vertices.join(ids, "id", "left_semi")
        own = cells(self.graph.vertices, key).select("id", F.create_map(F.lit("x"), F.col("cell")).alias("p"))
        return self.graph.vertices.join(own.where(P.equals("p", "x", value)).select("id"), "id", "left_semi")
