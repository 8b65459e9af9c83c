"""Document registry: (id, title, file_path, status).

Uniqueness of ``id`` is kept by the jobs that write it (anti-join + dedup);
every operator here is a DataFrame -> DataFrame step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.config import STATUS_PROCESSED
from docsift.operators import sizing

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def empty_registry(spark: SparkSession) -> DataFrame:
    """P8 (clear): an empty frame with the registry schema."""
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def list_documents(registry: DataFrame) -> DataFrame:
    """(id, title, file_path), no ordering."""
    return registry.select("id", "title", "file_path")


def list_titles(registry: DataFrame) -> DataFrame:
    """Titles, duplicates kept."""
    return registry.select("title")


def exists(ids: DataFrame, registry: DataFrame, id_col: str = "id") -> DataFrame:
    """P3 for many ids at once: every input row plus ``processed`` boolean.

    The registry side is reduced to its distinct key set before the join,
    so the flag never multiplies input rows."""
    known = registry.select(F.col("id").alias("_known_id")).distinct()
    return ids.join(known, ids[id_col] == known["_known_id"], "left").select(
        *[ids[c] for c in ids.columns], known["_known_id"].isNotNull().alias("processed")
    )


def lookup(registry: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Registry rows whose id is in ``ids``: one row per document however
    often it is listed; unknown or NULL ids match nothing; no order kept."""
    wanted = sizing.broadcast_if_small(ids.select(F.col(id_col).alias("id")).distinct())
    return list_documents(registry).join(wanted, "id", "left_semi")


def delete(registry: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The registry without the given ids (vectors are left alone: M8)."""
    gone = ids.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    return registry.join(sizing.broadcast_if_small(gone), "id", "left_anti")


def dedup_first_wins(docs: DataFrame, order_col: str = "list_order") -> DataFrame:
    """A1: one row per content id; the first document in listing order wins.

    ``min_by`` is a declarative aggregate: partial per partition, so a copy
    group of any size costs one row per partition in the shuffle."""
    return docs.groupBy("id").agg(
        F.min_by(F.struct(*[c for c in docs.columns if c != "id"]), F.col(order_col)).alias("_w")
    ).select("id", "_w.*")


def insert_if_absent(incoming: DataFrame, registry: DataFrame | None, order_col: str = "list_order") -> DataFrame:
    """Rows to append to the registry: unseen ids, deduplicated.

    Dedup runs first: its partial aggregation collapses copy groups inside
    each partition before the shuffle (a hot content id costs one row per
    partition), and the anti-join then sees every id once, on the id
    partitioning the aggregate already produced. Both run before any
    chunking, so known content is dropped before the costly steps. (Dropping
    known ids and deduplicating commute: dedup is per id.)"""
    fresh = dedup_first_wins(incoming, order_col)
    if registry is None:  # first run: nothing registered yet
        return fresh
    return fresh.join(registry.select("id"), "id", "left_anti")


def registry_rows(docs: DataFrame) -> DataFrame:
    """Registry rows from deduplicated documents (id, title, path)."""
    return docs.select(
        "id", "title", F.col("path").alias("file_path"), F.lit(STATUS_PROCESSED).alias("status")
    )
