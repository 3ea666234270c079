"""From raw documents to token ids: quality rules, near-duplicates, repeated passages, benchmark leaks, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, decontamination, quality, simhash, substring
from weftgraph.llm.common import Scratch, modest_batches, shielded, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their own columns, whatever their names.

    Null and empty texts fail the base rules. Equal rows are judged alike; null
    ids have no label. An empty table stays empty.
    """
    mine, back = shielded(docs, quality.ADDED)
    return quality.quality_rules(mine, table(spark, sf_dir, "labels")).filter("kept").select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the least id, null ids last, of several such the one of the least text.

    Rows of one id are rows of their own. Null and wordless texts are
    near-duplicates of each other. An empty table stays empty.
    """
    modest_batches(spark)
    return simhash.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier; untouched texts stay as they are, emptied ones go.

    ``n_chars``, where there is one, follows the text. A null text stays. Rows
    of one id count as one document, null as the least id. Other columns stay,
    whatever their names; an empty table stays empty.
    """
    modest_batches(spark)
    mine, back = shielded(docs, substring.ADDED)
    found = substring.remove_repeats(mine).filter("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))).select(*back)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns, whatever their names. Null and empty texts stay, equal rows too."""
    modest_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, and the digest of what they give back.

    One row for each document, equal ones too; a null text has no tokens, a
    null id stays null; other columns are not carried. An empty table stays empty.
    """
    modest_batches(spark)
    ranks = public_tokenizers.path(RANKS)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encoding_stage),
]

#: The stages are no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), compression="snappy")
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
