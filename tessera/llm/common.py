"""Helpers shared by the training-data operators: shared folders, code shipping, Arrow text batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most UTF-8 bytes that a Python worker handles at once (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 18

#: Bytes of a batch between the JVM and a Python worker, where the session sets no bound of its own: rows are whole
#: texts, and a worker holds its batch several times over.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()
#: What this worker remembers from one task to the next, by name: functions that forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, however the driver found it, and bound the batches."""
    if spark.conf.get(_BOUND, "1b") == "1b":
        spark.conf.set(_BOUND, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "tessera_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *, keep: str = "") -> DataFrame:
    """df.mapInArrow(run, schema) on executors that have this package.

    A worker lives on for other tasks, so a task's freed memory goes back to the machine when it ends, and what earlier tasks of
    other kinds remembered is forgotten when it begins; keep: the name of what this kind remembers."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in REMEMBERED.items():
            if name != keep:
                forget()
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(whole, schema)


def released() -> None:
    """Return freed memory, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a local master gets a temporary
    folder, and a cluster an error, as its machines share none that could be guessed."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: no lineage, and whole if executors are lost."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that nothing reads any longer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Held:
    """stored, for a table that its maker can drop."""

    def __init__(self, df: DataFrame, what: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        dropped(self.spark, self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets; a null key counts as empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % buckets


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most CHUNK_BYTES of text each, one row at least."""
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < len(off) - 1:
        end = int(np.searchsorted(off, off[start] + CHUNK_BYTES, side="right")) - 1
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def seg_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]; empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside; a run never goes over the bounds in off."""
    edge = np.zeros(len(inside), bool)
    edge[off[:-1][off[:-1] < len(inside)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


_MIX = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that span_hashes works on at once; a longer span is worked on by itself.
STRETCH = 1 << 18


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, n of each."""
    for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
        if len(_powers[i]) < n:
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (in order, not overlapping), independent of its place: prefix sums of bytes times powers of
    their places, with the place of the span divided out.  Long texts are worked through in stretches."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(ends, base + STRETCH, side="right")))
        a, b = starts[done:stop] - base, ends[done:stop] - base
        part = buf[base : base + int(b[-1])]
        power, inverse = _power(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[part] * power[: len(part)], dtype=np.uint64)])
        out[done:stop] = mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _MIX[7])
        done = stop
    return out
