"""Secret scans over an incremental blob ledger.

Every version of a document is content-addressed by the SHA-256 of its text.  The ledger is a folder of finished pairs:
one row for each blob and rule with the rule's version, and the spans found.  A scan first reduces the versions to blobs, drops the
(blob, rule, version) pairs that the ledger has, reads the text of one representative of each blob that is left, applies
only its missing rules, appends the results, and joins the current versions' findings back to every path.  A rule whose
version changes is scanned anew for all blobs; a document that changes costs its new blob alone.

Rules: assign, access and hex find leftmost non-overlapping matches each and drop those that fail a
check without retrying.  key_block (PEM headers) and bearer (three-part web tokens) add spans to these.

Edge cases: null texts count as the empty blob.  Repeated rows and equal texts share a blob and get a row each.  Null paths are kept.
An empty table gives an empty result.  A ledger folder that doesn't exist yet is an empty ledger; each scan writes a folder of
its own below it with Spark's commit protocol, so a failed scan leaves nothing that a later one would read as finished.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common


@dataclass(frozen=True)
class Rule:
    """pattern: what to find; check: whether a match counts (else it is dropped, not retried)."""

    name: str
    version: int
    pattern: str
    check: Callable[[re.Match], bool] = lambda m: True


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # runs are maximal, so shorter ones need not be matched to be dropped
    Rule("key_block", 1, r"-----BEGIN (?:[A-Z]{2,16} )?PRIVATE KEY-----"),
    Rule("bearer", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
ORDER = {r.name: i for i, r in enumerate(RULES)}
LEDGER = "blob string, rule string, version int, spans array<struct<s:bigint,e:bigint>>"


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Spans in code points."""
    return [m.span() for m in re.finditer(rule.pattern, text) if rule.check(m)]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The finished pairs: the rows of all scans below path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if not there:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, findings: array of (s, rule number, e, rule) in order of start, then rule) of every row of docs; the ledger grows."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    content = F.coalesce(F.col(text), F.lit(""))
    versions = common.stored(docs.select(F.col(key), F.sha2(content, 256).alias("blob"), F.xxhash64(F.col(key)).alias("_at")), "secret-versions")
    blobs = versions.groupBy("blob").agg(F.min("_at").alias("_at"))
    old = ledger(spark, ledger_path).join(F.broadcast(wanted), ["rule", "version"]).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    todo = blobs.join(old, "blob", "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules)).select("blob", "_at", F.coalesce("done", F.array().cast("array<string>")).alias("done"))
    todo = common.stored(todo, "secret-todo")
    # texts travel to their blobs compressed; one row of each blob meets its representative's key hash

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            shrink = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([shrink(x) for x in raw], pa.binary())], ["_at", "blob", "z"])

    rows = common.mapped(docs.select(F.xxhash64(F.col(key)).alias("_at"), F.col(text).alias("t")), packed, "_at long, blob string, z binary")
    rows = rows.join(todo.hint("shuffle_hash"), ["blob", "_at"]).select("blob", "done", "z")
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            out: list[tuple] = []
            grow = zstandard.ZstdDecompressor().decompress
            for blob, done, z in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = grow(z).decode()
                out += [(blob, r.name, r.version, [{"s": a, "e": b} for a, b in find(r, t)]) for r in by_name.values() if r.name not in done]
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["blob", "rule", "version", "spans"])

    fresh = common.mapped(rows, run, LEDGER).groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))
    fresh.write.parquet(f"{ledger_path.rstrip('/')}/scan-{uuid.uuid4().hex}")
    number = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule"))
    found = ledger(spark, ledger_path).join(F.broadcast(wanted), ["rule", "version"]).where("size(spans) > 0").join(blobs.select("blob"), "blob", "left_semi")
    found = found.select("blob", "rule", number.alias("n"), F.explode("spans").alias("x")).select("blob", F.struct("x.s", "n", "x.e", "rule").alias("f"))
    # stored, so that the join below reads plain exchanges, whose hot blobs are split at run time
    found = common.stored(found.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings")), "secret-findings")
    empty = F.array().cast("array<struct<s:bigint,n:bigint,e:bigint,rule:string>>")
    return versions.join(found, "blob", "left").select(key, "blob", F.coalesce("findings", empty).alias("findings"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    rows = scan(common.table(spark, sf_dir, "documents"), common.scratch(spark, "secret-ledger"))
    base = F.filter("findings", lambda f: f["rule"].isin(*BASE))
    text = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["rule"], f["s"].cast("string"), f["e"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["rule"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
