"""The registered queries of the corpus operators: one ``opN_<name>`` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import (
    collocations, decontaminate, divergence, exact_dedup, license_scan, line_dedup, mixing, ngram_join, pii, sharding, simhash,
    toxicity, warc,
)
from docsift.llm.common import prepare, scratch_path, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    prepare(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; fold 0 by id is held out of the training."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (toxicity.fold(docs["doc_id"]) == 0).alias("held_out"), toxicity.score_column(docs["text"], model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, near equal in bytes, equal texts together."""
    prepare(spark)
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    prepare(spark)
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of its equal texts."""
    prepare(spark)
    rows = exact_dedup.exact_groups(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the numbers and dates of persons replaced by pseudonyms."""
    prepare(spark)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc.doc_id", "text", "n_found", "kinds")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five documents hold."""
    prepare(spark)
    rows = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, normalised, and read back by their index."""
    prepare(spark)
    folder = scratch_path(spark, "warc")
    warc.write_monolithic(warc.plan_records(table(spark, sf_dir, "pages")), f"{folder}/whole")
    records = warc.read_records(warc.normalise(spark, f"{folder}/whole", f"{folder}/members"))
    return records.select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat benchmark items: a row per document and item."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.explode(decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))).alias("hit"))
    return rows.select("doc_id", "hit.item_id", F.col("hit.start").alias("start_word"), "hit.similarity")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all sources."""
    prepare(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets of all documents, linked at a Jaccard similarity of 0.8."""
    prepare(spark)
    rows = ngram_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, and their most particular terms."""
    prepare(spark)
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all languages."""
    prepare(spark)
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_toxicity, op3_sharding, op4_simhash, op5_exact_dedup, op6_pii, op7_line_dedup, op8_warc,
        op9_decontamination, op10_mixing, op11_ngram_join, op12_divergence, op13_collocations,
    )
}
