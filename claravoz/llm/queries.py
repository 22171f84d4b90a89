"""The queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claravoz.llm import alignment, byte_bpe, decontamination, exact_dedup, language_id, licenses, periodic_runs, pii, piece_counts, simhash_trie, toxicity, unit_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, word for word or with other names and figures."""
    leaks = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "place", "tokens", "covered", "changed")


def op2_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats text of an earlier one: removed spans, and the text that stays."""
    found = unit_dedup.changed(table(spark, sf_dir, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["keep_doc_id"]))
    return found.select(
        "doc_id", F.size("spans").cast("long").alias("n_removed"), F.array_join(listed, ",").alias("removed"),
        F.array_sort(F.array_distinct("spans.keep_doc_id")).alias("kept_in"), "clean_text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 4,096 tokens."""
    found = piece_counts.count_tokens(table(spark, sf_dir, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the copy that stays and the size of its group."""
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that disclose it."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory above.

    A document is the file ``source/lang/<id div 100>/<id>.txt``; one whose words are to a
    third or more a licence notice speaks for its directory.
    """
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.expr("doc_id div 100"), F.concat(F.col("doc_id"), F.lit(".txt")))
    found = licenses.scan(docs, path, is_licence=F.col("notice_share") >= 1 / 3)
    return found.withColumn("licences", F.array_join("licences", ","))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_trie.find_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and of the decoded bytes of every document."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), tokens=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, learned from the labels that are not held out."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers, and the links' support in the corpus."""
    found = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return alignment.score(found.select("doc_id", "n_a", "n_b", "n_groups", digest, "links", "times"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text, by the CRC of its id, ends in loops of its own words.

    A null id has the CRC of the empty text.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", crc.alias("_crc"), F.when(crc % 10 == 0, words).alias("_words"))
    sized = cut.select("*", F.size("_words").alias("_n"), F.expr("_crc div 10").alias("_g"))
    at = sized.select("*", F.expr("CASE WHEN _n > 0 THEN CAST(_g % _n AS INT) END").alias("_a")).select(
        "*", F.expr("CAST(1 + (_n - _a) div (3 + _g % 8) AS INT)").alias("_p"))
    turned = F.expr("array_join(transform(sequence(0, _n - 1), i -> _words[IF(i < _a, i, _a + (i - _a) % _p)]), ' ')")
    return at.select("doc_id", F.when(F.col("_a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of the documents looped first."""
    found = periodic_runs.find_runs(looped(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), longest.alias("_most"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256")).select(
        "doc_id", "n_runs", (-F.col("_most.back")).alias("start"), F.col("_most.length").alias("length"), (-F.col("_most.less")).alias("period"),
        F.expr("1000 * _most.length div -_most.less").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and payload of every page's record in an archive without repeated payloads."""
    found = warc.archive_and_resolve(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_unit_dedup": op2_unit_dedup,
    "op3_language_id": op3_language_id,
    "op4_piece_counts": op4_piece_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM bare
            WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked""",
    "op13_warc": r"""
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest,
                   row_number() OVER w AS place, first_value(page_id) OVER w AS original
            FROM pages
            WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST))
        SELECT page_id, strlen(payload) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(digest, 1 + 5 * (k // 4), 5))::BIGINT) >> (15 - 5 * (k % 4))::BIGINT) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
               CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN original END AS refers_to
        FROM payloads""",
}
