"""Token ids as directly addressable codes.

An id is cut into chunks of BITS bits.  Level 0 holds the lowest chunk of every id and a bitmap with one bit for each, set
where the id goes on; level 1 holds the next chunk of those that go on, and so forth.  A rank directory keeps the number of set
bits before every RANK-th place of a bitmap, so that the place of any id on the next level is one directory entry plus
a count over fewer than RANK bits: token i is read without decoding any other, and the ids of a
range lie in one run on every level.

Files: a Parquet folder, one row a segment of whole documents (SEGMENT ids or one document), uncompressed, in row groups of about GROUP
bytes with the statistics of shard and segment, so that a reader of a few places opens few of them; written by Spark's commit
protocol, so lost executors leave no half files.  Columns: shard and segment (both ascend with the documents' order),
shard_start (ids of the shard before the segment), doc_ids, bounds (first id of each document within the segment, and
the end), payload (the codes, see `pack`).  Shards are ranges of ascending key; null keys come first, equal keys stand
in order of their text.

Edge cases: null text counts as empty and holds the end id alone; repeated rows are documents of their own; an empty
table gives an empty folder of the same schema; ids take up to 32 bits.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

BITS = 8
RANK = 512
SEGMENT = 1 << 16
GROUP = 1 << 20
#: Segments that a lookup names to the scan one by one; more are joined.
NAMED = 1_000
END_ID = 2
#: Distinct pieces of text whose ids a worker remembers.
CACHE = 800_000
MAGIC = b"DAC1"

#: Characters on which all versions of the tokenizer's pattern agree: no digits or spaces beyond ASCII.
_PLAIN = re.compile("[^\\t\\n\\r -~¡-±´-¸º»¿-ɏ]")
_L, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", " \\t\\n\\r"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def pack(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The codes of ids: magic, count, bits, number of levels, then for each level its count, chunks (whole bytes each),
    a flag whether a bitmap follows, the bitmap (low bit first) and its rank directory."""
    ids = np.asarray(ids, np.uint32)
    width = 1 if bits <= 8 else 2
    parts, rest, levels = [], ids, 0
    while levels == 0 or len(rest):
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(f"<u{width}")
        on = rest >> np.uint32(bits) > 0
        more = bool(on.any())
        parts += [struct.pack("<QB", len(rest), more), chunk.tobytes()]
        if more:
            bitmap = np.packbits(on, bitorder="little")
            parts += [bitmap.tobytes(), np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, len(on), RANK)))]).astype("<u4").tobytes()]
        rest = rest[on] >> np.uint32(bits)
        levels += 1
    return MAGIC + struct.pack("<QBB", len(ids), bits, levels) + b"".join(parts)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a packed id sequence")
        self.count, self.bits, levels = struct.unpack_from("<QBB", data, 4)
        width, at = (1 if self.bits <= 8 else 2), 14
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for _ in range(levels):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, f"<u{width}", n, at)
            at += n * width
            bitmap = ranks = None
            if more:
                bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bitmap)
                ranks = np.frombuffer(data, "<u4", (n + RANK - 1) // RANK + 1, at)
                at += ranks.nbytes
            self.levels.append((chunk, bitmap, ranks))

    def __len__(self) -> int:
        return self.count

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, bitmap, ranks = self.levels[level]
        first = i // RANK * RANK
        bits = np.unpackbits(bitmap[first // 8 : (i + 7) // 8], count=i - first, bitorder="little")
        return int(ranks[i // RANK]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = shift = 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            shift += self.bits
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive), as far as they go."""
        b, parts = min(b, self.count), []
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            parts.append([chunk[a:b].astype(np.uint32), None])
            if bitmap is None or a >= b:
                break
            parts[-1][1] = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            a, b = self._rank(level, a), self._rank(level, b)
        out = np.zeros(0, np.uint32)
        for chunk, on in reversed(parts):
            if on is not None and len(out):
                chunk[on] |= out << np.uint32(self.bits)
            out = chunk
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return own, {}, own.encode("\n", add_special_tokens=False).ids


common.REMEMBERED["pieces"] = _tokenizer.cache_clear


def _path(tokenizer: str) -> str:
    """A file's own path, or the place of a public vocabulary on the machine that asks."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _pieces(new: list[str], own, line: list[int]) -> dict[str, bytes]:
    """Each piece's ids.  Pieces without white space but a leading space go through the library as one text, each after a
    line break, which is a piece of its own there; the ids are parted at its id."""
    plain = [p for p in new if not p.isspace()]
    found = {p: np.array(own.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in new if p.isspace()}
    ids = np.array(own.encode("\n" + "\n".join(plain), add_special_tokens=False).ids if plain else [], "<u4")
    at = np.flatnonzero(ids == line[0]) if len(line) == 1 else np.zeros(0, int)
    if len(at) != len(plain):
        return found | {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(plain, own.encode_batch_fast(plain, add_special_tokens=False))}
    data, ends = ids.tobytes(), np.append(at[1:], len(ids))
    return found | {p: data[4 * a + 4 : 4 * b] for p, a, b in zip(plain, at.tolist(), ends.tolist())}


def encode(text: str, tokenizer: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers.

    The tokenizer joins no pieces, so equal pieces have equal ids: each distinct piece goes through the library once.
    Texts with characters on which pattern versions could differ, or a special token's string, go through whole.
    """
    own, known, line = _tokenizer(tokenizer)
    if _PLAIN.search(text) or "<|" in text:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pieces = _PIECE.findall(text)
    try:
        return b"".join(map(known.__getitem__, pieces))
    except KeyError:
        new = list(set(pieces).difference(known))
        found = _pieces(new, own, line)
        if len(known) + len(found) <= CACHE:
            known.update(found)
            return b"".join(map(known.__getitem__, pieces))
        return b"".join([found.get(p) or known[p] for p in pieces])


SEGMENTS = "shard int, segment int, shard_start long, doc_ids array<long>, bounds array<long>, payload binary"


def write_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, segment: int = SEGMENT, shards: int | None = None) -> None:
    """Encode every text, append end_id and write the folder at path.  The key is an integer column."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "k").sortWithinPartitions("k", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _path(tokenizer)
        shard, number, done, size = TaskContext.get().partitionId(), 0, 0, 0
        keys, held = [], []

        def close() -> pa.RecordBatch:
            nonlocal number, done, size
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
            row = [[shard], [number], [done], [keys], [bounds.tolist()], [pack(np.frombuffer(b"".join(held), "<u4"))]]
            number, done, size = number + 1, done + int(bounds[-1]), 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["shard", "segment", "shard_start", "doc_ids", "bounds", "payload"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                held.append(encode(t.as_py(), file) + end)
                size += len(held[-1]) // 4
                if size >= segment:
                    yield close()
                    keys, held = [], []
        if keys:
            yield close()

    common.mapped(rows, run, SEGMENTS, keep="pieces").write.options(**{"compression": "uncompressed", "parquet.block.size": GROUP, "parquet.page.size": GROUP}).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first): ids of all shards before each.  One row a shard, as many as write_tokens had partitions."""
    ends = spark.read.schema(SEGMENTS).parquet(path).groupBy("shard").agg(F.max(F.col("shard_start") + F.element_at("bounds", -1)).alias("n"))
    first, rows = 0, []
    for shard, n in sorted(map(tuple, ends.collect())):
        rows.append((shard, first))
        first += n
    return spark.createDataFrame(rows, "shard int, first long")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, bounds = Codes(row["payload"]), np.array(row["bounds"])
                whole = codes.range(0, len(codes)).astype("<u4")
                parts = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                n = len(parts)
                cols = [pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + row["shard_start"]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    docs = common.mapped(spark.read.schema(SEGMENTS).parquet(path), run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    docs = docs.join(F.broadcast(shard_starts(spark, path)), "shard")
    return docs.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """(place, id): the ids at the given places among all ids, each read by itself; places beyond the end give no row.

    A place's segment is found by the columns beside the payload; of the payloads only those row groups are read that hold
    a wanted segment, where these are few enough to be named."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    parts = files.select("shard", "segment", "shard_start", F.element_at("bounds", -1).alias("n")).join(F.broadcast(shard_starts(spark, path)), "shard")
    parts = parts.select("shard", "segment", (F.col("first") + F.col("shard_start")).alias("a"), "n")
    step = parts.agg(F.max("n")).first()[0] or 1
    wanted = places.select(F.col(place).cast("long").alias("place"), F.explode(F.array(F.floor(F.col(place) / step), F.floor(F.col(place) / step) - 1)).alias("cell"))
    wanted = wanted.join(parts.withColumn("cell", F.floor(F.col("a") / step)), "cell").where("place >= a and place < a + n")
    wanted = common.stored(wanted.groupBy("shard", "segment", "a").agg(F.collect_list("place").alias("places")), "token-places")
    named = wanted.select("shard", "segment").limit(NAMED + 1).collect()
    if len(named) <= NAMED:
        match = F.lit(False)
        for shard in sorted({r["shard"] for r in named}):
            match = match | ((F.col("shard") == shard) & F.col("segment").isin([r["segment"] for r in named if r["shard"] == shard]))
        files = files.where(match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["payload"])
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array([codes[p - row["a"]] for p in row["places"]], pa.int64())], ["place", "id"])

    return common.mapped(files.select("shard", "segment", "payload").join(wanted, ["shard", "segment"]).select("a", "payload", "places"), run, "place long, id long")


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
