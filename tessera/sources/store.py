"""A versioned graph store: immutable data folders, version pointers, transactions, snapshots and a log of deltas.

Folder: data/<uuid>/vertices and data/<uuid>/edges as Parquet; current/<n>, a small file that names version n's data folder
and the log numbers folded into it; wal/<n>/, the Parquet rows of log entry n.

A writer puts its data into a folder of its own, then creates the pointer, exclusively and last.  Readers see whole versions only, a
writer that loses the race has touched nothing that others read, and a number is published once.  A pointer that
stays empty for PENDING_S seconds is that of a writer that died between creating and filling it; it is passed over.

A commit appends its rows to the log, publishes, and drops its log entry.  Log entries are replayed in the order of their numbers, that in
which they were appended.  The pointer knows which entries its version holds, so an entry that a crash left behind is
dropped, not replayed twice.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import numbered

#: at: the log entry's number; seq: the row's place within its entry or transaction.
DELTA = "op string, id long, src long, dst long, weight double, props string, tx string, seq long, at long"
EMPTY_VERTICES, EMPTY_EDGES = "id long, props string", "src long, dst long, eid long, weight double, props string"
PENDING_S = 60


class Conflict(RuntimeError):
    """Another version was published since the one that a change was derived from."""


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- files

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _create(self, at, text: str) -> bool:
        """Create a file with this text; False if it is there already."""
        if not self._fs.createNewFile(at):
            return False
        out = self._fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, at) -> str:
        jvm = self.spark.sparkContext._jvm
        stream = self._fs.open(at)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # ---- versions

    def _pointers(self) -> dict[int, dict | None]:
        """Published versions by number; None where a pointer is still empty."""
        out: dict[int, dict | None] = {}
        for name in self._names("current"):
            if name.isdigit():
                text = self._text(self._path("current", name))
                out[int(name)] = json.loads(text) if text else None
        return out

    def version(self) -> int:
        """The newest published version, 0 if there is none."""
        return max([0, *(n for n, p in self._pointers().items() if p)])

    def snapshot(self, version: int | None = None) -> PropertyGraph:
        """The graph of a version, the newest if None; later commits don't change it."""
        version = self.version() if version is None else version
        if not version:
            return PropertyGraph(self.spark.createDataFrame([], EMPTY_VERTICES), self.spark.createDataFrame([], EMPTY_EDGES))
        pointer = json.loads(self._text(self._path("current", str(version))))
        own = f"{self.path}/data/{pointer['data']}"
        return PropertyGraph(self.spark.read.parquet(f"{own}/vertices"), self.spark.read.parquet(f"{own}/edges"))

    def publish(self, g: PropertyGraph, base: int | None = None, folded: list[int] | None = None) -> int:
        """Write g as the next version.  Edges are sorted by source within files, so point reads skip row groups.

        base: the version that g was derived from; if another was published meanwhile, Conflict is raised and the
        store is as it was.  folded: the log entries that g holds and its base does not."""
        if base is not None:
            self._unchanged(base)
        name = uuid.uuid4().hex
        own = f"{self.path}/data/{name}"
        g.vertices.sortWithinPartitions("id").write.parquet(f"{own}/vertices")
        g.edges.sortWithinPartitions("src", "eid").write.parquet(f"{own}/edges")
        while True:
            try:
                now = self._unchanged(base)
                pointers = self._pointers()
                number = max([0, *pointers]) + 1
                left = set(map(int, self._names("wal")))
                held = sorted(({*(pointers[now]["folded"] if now else ()), *(folded or ())}) & left)
                self._fs.mkdirs(self._path("current"))
                if self._create(self._path("current", str(number)), json.dumps({"data": name, "folded": held})):
                    return number
                if base is not None:
                    raise Conflict(f"version {number} was published by another writer")
            except Conflict:
                self._fs.delete(self._path("data", name), True)
                raise

    def _unchanged(self, base: int | None) -> int:
        """The newest version; Conflict if it isn't base, or if a younger one is being published."""
        pointers = self._pointers()
        now = max([0, *(n for n, p in pointers.items() if p)])
        if base is not None:
            if now != base:
                raise Conflict(f"version {now} was published since {base}")
            for n in pointers:
                if n > base and time.time() - self._fs.getFileStatus(self._path("current", str(n))).getModificationTime() / 1000 < PENDING_S:
                    raise Conflict(f"version {n} is being published by another writer")
        return now

    def begin(self) -> Transaction:
        return Transaction(self)

    # ---- the log

    def write_log(self, rows: DataFrame) -> int:
        """Append rows as one log entry; its number.  An entry counts once it is written whole."""
        number = max([0, *map(int, self._names("wal")), *map(int, self._names("wal-numbers"))]) + 1
        self._fs.mkdirs(self._path("wal-numbers"))
        while not self._fs.createNewFile(self._path("wal-numbers", str(number))):
            number += 1
        rows.withColumn("at", F.lit(number).cast("long")).write.parquet(f"{self.path}/wal/{number}")
        return number

    def log(self) -> DataFrame:
        """The rows of all whole entries that the newest version doesn't hold."""
        now = self.version()
        held = set(self._pointers()[now]["folded"]) if now else set()
        left = [n for n in sorted(map(int, self._names("wal"))) if n not in held and self._fs.exists(self._path("wal", str(n), "_SUCCESS"))]
        if not left:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/wal/{n}" for n in left])

    def drop_log(self, numbers: list[int]) -> None:
        for n in numbers:
            self._fs.delete(self._path("wal", str(n)), True)

    def recover(self) -> int | None:
        """Fold the log's transactions that committed into a new version and drop the log; None if there are none."""
        numbers = [int(n) for n in self._names("wal")]
        if not numbers:
            return None
        base = self.version()
        done = replayable(self.log())
        out = self.publish(fold(self.snapshot(base), done), base, numbers) if done.take(1) else None
        self.drop_log(numbers)
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Delete the data folders of all versions but the `keep` newest, and those that no version names and that are older than
        PENDING_S seconds times 60; how many.  Snapshots of deleted versions can't be read any longer."""
        published = {n: p for n, p in self._pointers().items() if p}
        stay = {published[n]["data"] for n in sorted(published)[-keep:]}
        named = {p["data"] for p in published.values()}
        gone = 0
        for name in self._names("data"):
            age = time.time() - self._fs.getFileStatus(self._path("data", name)).getModificationTime() / 1000
            if name not in stay and (name in named or age > 60 * PENDING_S):
                self._fs.delete(self._path("data", name), True)
                gone += 1
        for n in sorted(published)[:-keep]:
            self._fs.delete(self._path("current", str(n)), False)
        return gone


def replayable(log: DataFrame) -> DataFrame:
    """The rows of transactions with a commit and without a rollback."""
    ends = log.groupBy("tx").agg(F.bool_or(F.col("op") == "commit").alias("c"), F.bool_or(F.col("op") == "rollback").alias("r"))
    return log.join(ends.where("c and not r").select("tx"), "tx", "left_semi").where("op not in ('begin', 'commit', 'rollback')")


def fold(g: PropertyGraph, log: DataFrame) -> PropertyGraph:
    """g after the operations of log in order of (at, seq): add_vertex (upsert), delete_vertex (its edges go too), add_edge (append,
    endpoints are created), delete_edge (all parallel edges so far).

    New eids follow the largest in the log's order: ranges of the log are numbered one by one and offset by their predecessors."""
    order = F.struct(F.coalesce("at", F.lit(0).cast("long")).alias("at"), "seq")
    v = log.where("op in ('add_vertex', 'delete_vertex')").groupBy("id").agg(F.max_by(F.struct("op", "props"), order).alias("x"), F.max(F.when(F.col("op") == "delete_vertex", order)).alias("gone"))
    changed = v.select("id", "x.op", "x.props", "gone")
    kept = g.vertices.join(changed.select("id"), "id", "left_anti").unionByName(changed.where("op = 'add_vertex'").select("id", "props"), allowMissingColumns=True)
    cuts = log.where("op = 'delete_edge'").groupBy("src", "dst").agg(F.max(order).alias("_cut"))
    new = log.where("op = 'add_edge'").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"), "props", order.alias("_at"))
    rows = g.edges.withColumn("_at", F.lit(None).cast("struct<at:bigint,seq:bigint>")).unionByName(new.withColumn("eid", F.lit(None).cast("long")), allowMissingColumns=True)
    gone = v.where("gone is not null").select("id", "gone")
    for end in ("src", "dst"):
        rows = rows.join(gone.select(F.col("id").alias(end), F.col("gone").alias(f"_{end}")), end, "left").where(F.col(f"_{end}").isNull() | (F.col("_at").isNotNull() & (F.col("_at") > F.col(f"_{end}"))))
    rows = rows.join(cuts, ["src", "dst"], "left").where(F.col("_cut").isNull() | (F.col("_at").isNotNull() & (F.col("_at") > F.col("_cut")))).drop("_cut", "_src", "_dst")
    top = g.edges.agg(F.coalesce(F.max("eid"), F.lit(-1))).first()[0]
    added = numbered(rows.where("_at is not null").drop("eid"), "_at", "eid", top + 1)
    left = rows.where("_at is null").unionByName(added).drop("_at")
    return PropertyGraph.from_edges(left, kept)


class Transaction:
    """Staged operations; commit logs them and publishes one version with all of them, anything else leaves the store as it was."""

    def __init__(self, store: GraphStore):
        self.store, self.base, self.tx, self.rows, self.state = store, store.version(), uuid.uuid4().hex, [], "active"

    def _add(self, op: str, id=None, src=None, dst=None, weight=None, props=None) -> None:
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        self.rows.append((op, id, src, dst, weight, props, self.tx, len(self.rows), None))

    def add_vertex(self, id: int, props: str | None = None) -> None:
        self._add("add_vertex", id=id, props=props)

    def add_edge(self, src: int, dst: int, weight: float = 1.0, props: str | None = None) -> None:
        self._add("add_edge", src=src, dst=dst, weight=weight, props=props)

    def delete_vertex(self, id: int) -> None:
        self._add("delete_vertex", id=id)

    def delete_edge(self, src: int, dst: int) -> None:
        self._add("delete_edge", src=src, dst=dst)

    def log(self) -> DataFrame:
        """What commit appends to the store's log: begin, the operations, commit."""
        end = lambda op, seq: (op, None, None, None, None, None, self.tx, seq, None)
        return self.store.spark.createDataFrame([end("begin", -1), *self.rows, end("commit", len(self.rows))], DELTA)

    def commit(self) -> int:
        """The version published.  Raises Conflict, and changes nothing, if another one was published since the transaction began."""
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        entry = self.store.write_log(self.log())
        try:
            out = self.store.publish(fold(self.store.snapshot(self.base), self.store.spark.createDataFrame(self.rows, DELTA)), self.base, [entry])
        finally:
            self.store.drop_log([entry])
        self.state = "committed"
        return out

    def rollback(self) -> None:
        self.state, self.rows = "rolled back", []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.state == "active":
            self.rollback()
