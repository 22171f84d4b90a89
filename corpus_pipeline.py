"""From raw documents to tokens: five stages, each one operator of ``claravoz.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns what stays; ``run`` writes a stage's result to the shared folder
and reads it again as the next one's documents. All but the last return the
columns of their input. Every stage handles null and repeated ids, null, empty and
very long texts, empty tables and extra columns; names that begin with ``_key_`` or
``_li_`` are theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claravoz.llm import byte_bpe, decontamination, exact_dedup, language_id, simhash_trie
from claravoz.llm.tables import stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without a letter and texts that no learned language accounts for."""
    return language_id.reject_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of the documents that are equal but for white space: the longest, then first."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by fingerprints."""
    return simhash_trie.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold an item of the benchmark, changed figures included."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their digest, and the digest of what they decode to, of every document."""
    return byte_bpe.encode(docs, tokens=True)


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_documents),
]

#: SQL has no XXH64 fingerprints, trigram filters or BPE; tests/llm compares ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
