"""Vector table (pos, doc_id, embedding): positions, width check, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators.sizing import broadcast_if_small
from docsift.session import materialize

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def empty_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VECTOR_SCHEMA)


def check_width(vectors: DataFrame, dim: int, doc_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A document whose vectors are not all ``dim`` wide fails whole.

    Returns (kept vector rows, rejected documents (doc_id, reason)). The
    per-document flag is a partial/final ``bool_and`` aggregate. The few
    rejected documents are the build side of an anti-join (broadcast if their
    count is checked small), so the vectors stream; a vector without a
    document id is not kept."""
    ok = F.coalesce(F.size("embedding") == dim, F.lit(False))  # a NULL vector has no width
    flags = vectors.groupBy(doc_col).agg(F.bool_and(ok).alias("_ok"))
    bad = flags.where(~F.col("_ok")).select(
        F.col(doc_col).alias("doc_id"), F.lit(f"embedding width differs from {dim}").alias("reason")
    )
    few = broadcast_if_small(bad.select(F.col("doc_id").alias("_bad")))
    kept = vectors.where(F.col(doc_col).isNotNull())
    return kept.join(few, kept[doc_col] == few["_bad"], "left_anti"), bad


def document_offsets(docs: DataFrame, order_cols: list[str], count_col: str, base, carry: tuple = ()) -> DataFrame:
    """W2 at document level: first position of each document.

    positions are dense from ``base`` in (order_cols) order. A distributed
    exclusive prefix sum: range-partition the narrow (order, count) table,
    number rows inside each partition, total each partition (one row per
    partition), prefix those totals, add back. No single-partition sort of
    all rows; only the per-partition totals meet in one place.

    The number of partitions is that of shuffles, joined at run time where they
    are small. The bounds of a range partitioning come from a sample, so the partition
    of a row is only known once: it is written with the rows, and both the
    local sums and the totals read that table.
    ``base`` is the current ntotal (see ``next_position``); ``carry`` names
    extra columns passed through.
    """
    narrow = docs.select(*order_cols, count_col, *carry)
    ranged = materialize(
        narrow.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()), "document-offsets"
    )
    w_local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(count_col).over(w_local), F.lit(0)).cast("bigint"))
    totals = ranged.groupBy("_pid").agg(F.sum(count_col).cast("bigint").alias("_tot"))
    w_prefix = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select("_pid", F.coalesce(F.sum("_tot").over(w_prefix), F.lit(0)).cast("bigint").alias("_pre"))
    out = local.join(F.broadcast(prefix), "_pid")  # one row per partition: bounded
    start = F.lit(int(base)).cast("bigint") + F.col("_pre") + F.col("_local")
    return out.select(*order_cols, count_col, *carry, start.alias("first_pos"))


def next_position(vectors: DataFrame) -> int:
    """Current ``ntotal`` (max(pos)+1, 0 if empty): one number to the driver."""
    return int(vectors.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("base")).first()["base"])


def append(vectors: DataFrame, new_vectors: DataFrame) -> DataFrame:
    """Bag union; no dedup (M7)."""
    return vectors.unionByName(new_vectors.select(*vectors.columns))


def last_position(vectors: DataFrame) -> DataFrame:
    """A2: document -> its last position (the id_to_index map)."""
    return vectors.groupBy("doc_id").agg(F.max("pos").cast("bigint").alias("last_pos"))


def counts_per_document(vectors: DataFrame) -> DataFrame:
    """A3: vectors per document."""
    return vectors.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_vectors"))


def total(vectors: DataFrame) -> DataFrame:
    """A3: ntotal."""
    return vectors.agg(F.count(F.lit(1)).cast("bigint").alias("ntotal"))


def position_lookup(positions: DataFrame, vectors: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Position -> document; a missing position gives NULL. Which side is
    built or shuffled is Spark's choice by the sizes it finds."""
    mapping = vectors.select(F.col("pos").alias("_vpos"), "doc_id")
    return mapping.join(positions, mapping["_vpos"] == positions[pos_col], "right").select(
        *[positions[c] for c in positions.columns], mapping["doc_id"]
    )
