"""From raw documents to token files: five stages, each over all that its predecessor kept.

toxicity          drops documents whose score reaches 0.7
near_duplicates   keeps one document of each SimHash component: the smallest doc_id, then the smallest hash of the text
decontamination   drops documents that hold a window of any benchmark item
mixing            repeats documents by their fitted rates, all at least once
tokens            writes the token files and returns a row for each document in them

Rows with a null id or text go through every stage; to near_duplicates a document is an id with a text, so different texts under one
id, or without one, are different documents (a null id comes after all others).  Stages keep the columns of documents and drop others;
an empty table gives an empty result.  ORACLE_SQL is None: the classifiers, XXH64 votes and the tokenizer can't be expressed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, mixing, simhash, tokens
from tessera.llm import toxicity as tox

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None
#: Keys of documents (id and hash, 16 bytes each) that may be sent to every executor.
MAX_BROADCAST_IDS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of a score of 0.7 or more.  A null text scores as an empty one; with no usable label all have one score, the prior's,
    and stay while that is below 0.7.  Repeated rows stay or go together."""
    model = tox.train(docs, common.table(spark, sf_dir, "labels"), common.fold("doc_id", 3) != 1)
    return tox.score(docs.select(*COLUMNS), model, to="_score").where("_score < 0.7").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, null last, then of the smallest hash of the text.  A null text counts as empty;
    equal rows are one document."""
    who = F.struct(F.col("doc_id").isNull().alias("blank"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = simhash.near_duplicates(docs.select(who.alias("who"), "text"), key="who")  # component_id: the component's smallest who
    stays = F.col("who").eqNullSafe(F.col("component_id"))
    groups = common.stored(found.select("who.id", "who.hash", stays.alias("stays")).groupBy("id", "hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")), "stage-groups")
    # the keys that go are far fewer than those that stay: counted, so few enough travel to the texts, else texts to them
    gone = groups.where("not stays").select(F.col("id").alias("_id"), F.col("hash").alias("_gone"))
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    rows = rows.join(gone, (F.col("_hash") == F.col("_gone")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    repeated = groups.where("stays and n > 1").limit(1).count()
    return (rows.dropDuplicates(["doc_id", "_hash"]) if repeated else rows).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of any benchmark item.  A null text has no words and stays; with an empty benchmark all stay."""
    return decontaminate.scan(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"), min_items=1).where("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, at least once.  A document without words has rate 1 if no domain is short, and is drawn like
    others; rows with equal ids get copies of their own rates by one draw; a null id has a draw of its own."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.labelled_languages(docs, common.table(spark, sf_dir, "labels")), least=1.0)
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the token files: doc_id, start, n_tokens, ids_crc32.  A null text holds the end id alone; null ids come first, equal
    ids in the order of their texts."""
    path = common.scratch(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path)
    return tokens.read_tokens(spark, path)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("tokens", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's result is written to the shared folder and read again as the next one's docs."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
