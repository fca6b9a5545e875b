"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and
works on all that its predecessor kept.  All but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.decontaminate import without_leaks
from textloom.llm.minhash_dedup import near_duplicates
from textloom.llm.packing import pack, vocabulary
from textloom.llm.pii import find_pii, redact
from textloom.llm.quality import score_quality
from textloom.llm.shared import lean, stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return score_quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates (five words, similarity 0.8).

    Rows that share a doc_id are documents each, in the order of their texts; rows with a
    null doc_id are near duplicates of nothing.
    """
    known, alone = docs.filter("doc_id is not null"), docs.filter("doc_id is null").select(*COLUMNS)
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        nodes = known.withColumn("node", F.col("doc_id").cast("long"))
    else:  # ids of their own, in the order of doc_id
        nodes = stash(known.orderBy(*COLUMNS).withColumn("node", F.monotonically_increasing_id()), "nodes")
    kept = near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("node"))
    return nodes.join(stash(kept, "kept").hint("merge"), "node", "left_semi").select(*COLUMNS).unionByName(alone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are judged one by one."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows."""
    found = find_pii(docs, keep=("text", "lang", "source", "n_chars"))
    text = redact(F.coalesce("text", F.lit("")), F.col("spans"))
    out = found.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"), "lang", "source", "n_chars", F.size("spans").alias("n"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier, a tokenizer and edit distances are beyond SQL; a test compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lean(docs)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
