"""Retrieval (C2): top-k hits -> distinct documents -> registry metadata.

Hits of documents no longer in the registry (orphans, M8/M9) still take
top-k slots and only vanish at the metadata join, so a query may get fewer
than k documents. The join is placed after the window on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.config import DEFAULT, EngineConfig
from docsift.operators import search, sizing


def distinct_hit_documents(hits: DataFrame) -> DataFrame:
    """A5: one row per (query, document); its rank is its best hit rank."""
    return (
        hits.where(F.col("doc_id").isNotNull())
        .groupBy("query_id", "doc_id")
        .agg(F.min("rank").cast("bigint").alias("rank"))
    )


def attach_metadata(doc_hits: DataFrame, registry: DataFrame, max_hits: int | None = None,
                    cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Keep hits whose document is registered, add title and path.

    When the hit side is known to be small (``max_hits``, e.g. queries x k,
    within ``max_broadcast_rows``) it is broadcast, so the registry is only
    scanned (pruned to three columns), never shuffled; known to be larger, it
    is joined by shuffle; unknown, it is counted first. The registry itself is
    never broadcast. A known bound spares the count, so a search runs once."""
    meta = registry.select(F.col("id").alias("doc_id"), "title", "file_path")
    if max_hits is None:
        hits = sizing.broadcast_if_small(doc_hits, cfg=cfg)
    else:
        hits = F.broadcast(doc_hits) if max_hits <= cfg.max_broadcast_rows else doc_hits
    return meta.join(hits, "doc_id", "inner").select(
        "query_id", "rank", F.col("doc_id").alias("id"), "title", "file_path"
    )


def retrieve(
    vectors: DataFrame,
    registry: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    cfg: EngineConfig = DEFAULT,
    dim: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, title, file_path)."""
    k = k or cfg.retrieve_k
    info: dict = {}
    hits = search.knn(vectors, queries, k, cfg, dim=dim, info=info)
    return attach_metadata(distinct_hit_documents(hits), registry, info["n_queries"] * k, cfg)
