"""The fixpoint driver: rounds over tables that are written to the shared folder, so plans stay short and lost executors cost no state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without one, a temporary folder.  A cluster has to name it."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-rounds-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A table in the shared folder.  by: its bucket column; joins and aggregates by it need no exchange, as all such
    tables have spark.sql.shuffle.partitions buckets, each of them sorted."""

    def __init__(self, df: DataFrame, *metrics: Column, by: str | None = None):
        self.spark, own = df.sparkSession, uuid.uuid4().hex
        self.path, self.name = f"{shared_dir(self.spark)}/round-{own}", f"tessera_{own}" if by else None
        seen = Observation(own) if metrics else None
        rows = df if seen is None else df.observe(seen, *metrics)
        if by is None:
            rows.write.parquet(self.path)
            self.df = self.plain = self.spark.read.schema(df.schema).parquet(self.path)
        else:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            rows.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", self.path).saveAsTable(self.name)
            self.df, self.plain = self.spark.table(self.name), self.spark.read.schema(df.schema).parquet(self.path)
        self.seen = {} if seen is None else seen.get

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def cut(df: DataFrame) -> DataFrame:
    """df written once and read again without its lineage."""
    return Stored(df).df


def cut_observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """cut, and the metrics (aggregates with aliases) gathered by the same job."""
    own = Stored(df, *metrics)
    return own.df, own.seen


class Rounds:
    """The states of one loop: writing a state deletes the one before it, so a loop holds two at most.

    Only for states that nothing but the next round reads.  by: the column that states are bucketed by."""

    def __init__(self, by: str | None = None) -> None:
        self.by, self._last = by, None

    def cut(self, df: DataFrame) -> DataFrame:
        return self.observed(df)[0]

    def observed(self, df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
        new = Stored(df, *metrics, by=self.by)
        self.close()
        self._last = new
        return new.df, new.seen

    def close(self) -> None:
        if self._last is not None:
            self._last.drop()
        self._last = None


class Grown:
    """A table that rounds append to.  When there are more than MOST parts all but the newest are merged, so neither the plan nor
    the number of files grows with the rounds, and a row is rewritten once in MOST rounds.

    merge: what to make of the merged rows, where later ones supersede others."""

    MOST = 8

    def __init__(self, by: str | None = None, merge: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.by, self.merge, self.parts = by, merge, []

    def add(self, df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
        """The part as it was written, and its metrics."""
        if len(self.parts) > self.MOST:
            old = self.parts[:-1]
            self.parts = [Stored(self.merge(_union(old)), by=self.by), self.parts[-1]]
            new = Stored(df, *metrics, by=self.by)  # df may read the old parts, so they go last
            for p in old:
                p.drop()
        else:
            new = Stored(df, *metrics, by=self.by)
        self.parts.append(new)
        return new.df, new.seen

    @property
    def df(self) -> DataFrame:
        return _union(self.parts)


def _union(parts: list[Stored]) -> DataFrame:
    """All rows of the parts.  Spark takes a union of bucketed tables for bucketed too, but appends their partitions where it reads
    them by columns, so an id of two parts would be two groups: several parts are read as plain files."""
    if len(parts) == 1:
        return parts[0].df
    out = parts[0].plain
    for p in parts[1:]:
        out = out.unionByName(p.plain)
    return out


def numbered(df: DataFrame, order: str, to: str, first: int = 0) -> DataFrame:
    """df with a column `to`: first, first + 1, ... in the order of a column that has no equal values.  Ranges are numbered one by one
    and offset by their predecessors' counts, so no task sees all rows."""
    own = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = own.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_c0"))
    number = F.col("_c0") + F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1 + F.lit(first)
    return own.join(F.broadcast(before), "_part").withColumn(to, number.cast("long")).drop("_part", "_c0")
