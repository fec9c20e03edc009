"""Streams of new edges: each micro-batch updates stored results by the delta operators."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental


class ComponentStream:
    """Connected components that follow a stream of edges (src, dst): batch n reads state n - 1 and writes state n.

    State folders are named by batch id and overwritten when a batch is run again, so a restarted stream gives the
    same states."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/state-{batch:012d}") if batch >= 0 else self.spark.createDataFrame([], "id long, label long")

    def update(self, edges: DataFrame, batch: int) -> None:
        """For foreachBatch.  Rows without both ends are left out."""
        now, _ = incremental.connected_components(self._state(batch - 1), edges.where("src is not null and dst is not null").select("src", "dst"))
        now.write.mode("overwrite").parquet(f"{self.path}/state-{batch:012d}")
        self.last = batch

    def start(self, edges: DataFrame, checkpoint: str, trigger: dict | None = None):
        return edges.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def labels(self) -> DataFrame:
        return self._state(self.last)


def degree_stream(edges: DataFrame, time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Out-degrees by tumbling window of event time, with a watermark for late edges."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window), "src").agg(F.count("*").alias("out_degree"))


