"""From documents to shards of a training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes what a stage returns as Parquet and reads it again, so
no stage is computed twice and a lost executor costs its own tasks only.

1. toxicity: documents that score 0.5 or more go.
2. near_dedup: of each SimHash component the smallest id stays.
3. decontaminate: documents that repeat a benchmark item go.
4. mix: documents are repeated or left out so that sources meet their weights.
5. shard: every row gets its shard and slot.

Toxicity is learned, SimHash needs XXH64 and sharding is iterative, so there is
no SQL for the rows of ``run``. The tests hold the operator of each stage against
plain Python, and each stage's rows against what that operator decides.

Edge cases are those of the operators: null texts count as empty and stay unless
a later stage says otherwise, null ids and sources are kept, very long texts
are read whole, repeated rows are near duplicates of each other (one stays),
columns of clashing names travel along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontaminate, mixing, sharding, simhash, toxicity
from docsift.llm.common import materialize, pack, prepare, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = pack(docs).withColumn("score", toxicity.score_column(F.col("doc.text"), model))
    return scored.where("score < 0.5").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.one_of_each(docs, shingle=simhash.SHINGLE, radius=simhash.RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.emit(mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per document copy with its shard."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
