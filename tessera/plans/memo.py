"""Results kept by graph version: an algorithm runs once for each version and set of options, and a new version starts afresh."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tessera.plans.graph import PropertyGraph
from tessera.plans.iterate import delete
from tessera.sources.store import GraphStore


class Memo:
    """Folder memo/<version>/<name>-<digest of the options> in the store's folder, written by Spark's commit protocol: a folder without
    its success mark is a result that was never finished, and is worked out again."""

    def __init__(self, store: GraphStore):
        self.store = store

    def _folder(self, name: str, options: dict[str, Any], version: int) -> str:
        told = hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.store.path}/memo/{version}/{name}-{told}"

    def _there(self, folder: str) -> bool:
        return self.store._fs.exists(self.store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"))

    def holds(self, name: str, version: int | None = None, **options: Any) -> bool:
        return self._there(self._folder(name, options, self.store.version() if version is None else version))

    def get(self, name: str, compute: Callable[..., DataFrame], version: int | None = None, **options: Any) -> DataFrame:
        """compute(graph, **options) of a version, the newest if None; read back where it was worked out before."""
        version = self.store.version() if version is None else version
        folder = self._folder(name, options, version)
        if not self._there(folder):
            g: PropertyGraph = self.store.snapshot(version)
            compute(g, **options).write.mode("overwrite").parquet(folder)
        return self.store.spark.read.parquet(folder)

    def forget(self, version: int) -> None:
        """Drop a version's results."""
        delete(self.store.spark, f"{self.store.path}/memo/{version}")
