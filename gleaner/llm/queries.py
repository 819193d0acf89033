"""The queries of the operators here: each applied to its whole table, with the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    alignment, embeddings, exactdedup, fingerprints, langid, licences, linededup, packing, pii, ranking, sentencepiece_bpe, simhash,
    toxicity,
)
from gleaner.llm.common import query, share_of, table
from gleaner.session import scratch


@query("op1_license_scan", licences.scan_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and labels of every whole text."""
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


#: A key for tests; data of one's own needs one's own.
PII_KEY = b"a key for tests; a run of one's own names its own"


@query("op2_pii_pseudonyms")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text with pseudonyms in place of personal data, and how many of which kinds were put."""
    found = pii.redact(table(spark, folder, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",").alias("kinds"))


@query("op3_embedding_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    found = embeddings.near_vectors(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op4_simhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document, learned from the four folds that are not held out."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(share_of("doc_id", 5) != 0))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", (share_of("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_packing", packing.pack_sql())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    found = packing.pack(packing.sequences(table(spark, folder, "documents")))
    return found.withColumnRenamed("id", "doc_id")


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the three folds that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = langid.prototypes(docs.filter(share_of("doc_id", 4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), known)
    return found.select("doc_id", (share_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op8_line_dedup", linededup.LINE_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document before and after those that three documents hold are dropped."""
    found = linededup.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM n""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The keeper and the size of every document's group of equal texts."""
    found = exactdedup.dedup(spark, f"{folder}/documents.parquet", scratch(spark, "exact-dedup"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op10_sentencepiece")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """How every document is cut with merge-dropout, and whether its ids decode to its text."""
    return sentencepiece_bpe.encode_digest(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query("op11_fingerprints", fingerprints.FINGERPRINT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and how alike they and the next document's are."""
    found = fingerprints.edited(fingerprints.with_next(table(spark, folder, "documents")))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@query("op12_ranked_search", ranking.RANK_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return ranking.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers' cuts of every whole text, links counted over the corpus."""
    return alignment.link_counts(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
