"""Ingest job (C1): files -> registry rows + vector rows + rejected rows.

Data flow and partitioning:

    files (path, list_order, text)
      -> reasons (S8)                      narrow
      -> id = md5(text), title             narrow
      -> min_by(order) per id (A1)         partial agg, no text: copies collapse
                                           map-side
      -> left_anti registry on id (J1)     on the id partitioning of the agg;
                                           written
      -> texts of the winners              semi-join by path, broadcast when few;
                                           dealt out by id if splits are uneven
      -> chunk rows (F13)                  narrow; huge documents by cells
                                           spread over tasks; written once
      -> document offsets (W2)             from per-document counts: narrow
      -> explode, featurize (F14)          narrow
      -> pos = first_pos + chunk_no        join with the doc-level offsets
                                           (broadcast by AQE when small)
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.config import DEFAULT, EngineConfig
from docsift.functions import chunking
from docsift.functions import features as fx
from docsift.functions import text as tx
from docsift.operators import registry as reg
from docsift.operators import sizing
from docsift.operators import vectors as vec
from docsift.session import materialize
from docsift.sources import files as src


@dataclass
class IngestResult:
    registry_rows: DataFrame  # (id, title, file_path, status)
    vectors: DataFrame  # (pos, doc_id, embedding)
    chunks: DataFrame  # (doc_id, chunk_no, start, end, chunk)
    rejected: DataFrame  # (path, reason)


#: New texts below this many bytes are chunked where they are read.
MIN_DEALT_BYTES = 1 << 20
#: Bytes of text a task gets when documents are dealt out.
DEALT_BYTES = 64 << 20


def identify(files: DataFrame, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """F1 + F2 on accepted files: (id, title, path, list_order[, text], carry)."""
    cols = [tx.content_id("text").alias("id"), tx.title("text").alias("title"), "path", "list_order"]
    return files.select(*cols, *(["text"] if keep_text else []), *carry)


def new_documents(files: DataFrame, registry: DataFrame | None, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """Accepted, unseen, deduplicated documents and the rejected files
    (``registry`` None: nothing registered yet).

    Dedup and the anti-join see the narrow (id, title, path, list_order)
    columns only, and their result is written. With ``keep_text`` the texts of
    the winners are then fetched by a semi-join on (path, list_order), which
    names a file: with a checked small number of winners (a run that finds
    little new) the files stream past a broadcast and no text is shuffled. A
    file listed twice under one path and order gives one document."""
    good, bad = src.split_rejected(files)
    if not keep_text:
        return reg.insert_if_absent(identify(good, keep_text=False), registry, "list_order"), bad
    sized = identify(good.withColumns({"_bytes": F.octet_length("text"), "_split": F.spark_partition_id()}), False, ("_bytes", "_split"))
    winners = materialize(reg.insert_if_absent(sized, registry, "list_order"), "new-documents")
    texts = good.select("path", "list_order", "text").join(
        sizing.broadcast_if_small(winners.drop("_bytes", "_split")), ["path", "list_order"]
    )
    return _dealt(texts.select("id", "title", "path", "list_order", "text"), winners), bad


def _dealt(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The documents, dealt out by id where the splits of the input would not
    spread the work: the new texts' bytes per split are known from the winners.
    A split with more than twice an even share of the cores (one large row
    group, few splits, new documents in one corner of the input) costs one
    shuffle of the texts; inputs in many even splits stay where they are."""
    per_split = winners.groupBy("_split").agg(F.sum("_bytes").alias("b"))
    total, largest = per_split.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    cores = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    if total <= MIN_DEALT_BYTES or largest * cores <= 2 * total:
        return docs
    return docs.repartition(max(cores, math.ceil(total / DEALT_BYTES)), "id")


def stage(files: DataFrame, registry: DataFrame | None, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Document-level result of the one pass that chunks: (id, list_order,
    title, path, chunks, cells) for the new documents, and the rejected
    files. Chunks for ordinary documents, cells of text for huge ones
    (chunked later across tasks); the text itself is not kept."""
    docs, bad = new_documents(files, registry)
    chunks, cells = chunking.chunk_or_cells(
        "text", cfg.chunk_size, cfg.chunk_overlap, cfg.separators, cfg.split_doc_chars
    )
    return docs.select("id", "list_order", "title", "path", chunks.alias("chunks"), cells.alias("cells")), bad


def ingest(
    files: DataFrame,
    registry: DataFrame | None,
    vectors: DataFrame,
    cfg: EngineConfig = DEFAULT,
    featurizer=None,
    base: int | None = None,
    staging_path: str | None = None,
) -> IngestResult:
    """C1. ``files``: (path, list_order, text[, _utf8]). ``base``: first free
    position (computed from ``vectors`` when not given).

    The one chunking pass is written once (staging); chunk counts per
    document are a partial aggregate of the chunk rows, so positions are
    known before any vector exists. A featurizer that does not declare ``fixed_width == dim`` goes
    through the checked path: its vectors are written, checked per document
    (P6) and only then given positions."""
    staged_lazy, bad = stage(files, registry, cfg)
    staged = materialize(staged_lazy, "ingest-staging", staging_path)
    rows = chunking.rows_from_staged(
        staged, ["id", "list_order"], size=cfg.chunk_size, overlap=cfg.chunk_overlap, separators=cfg.separators,
        split_chars=cfg.split_doc_chars,
    )
    chunks = rows.withColumnRenamed("id", "doc_id")
    # one row per document that has chunks (blank ones were rejected before)
    firsts = staged.where((F.size("chunks") > 0) | (F.size("cells") > 0)).select("id", "list_order", "title", "path")
    start = vec.next_position(vectors) if base is None else base
    fz = featurizer or fx.hashing_featurizer(cfg.dim)
    if getattr(fz, "fixed_width", None) == cfg.dim:
        per_doc = chunks.groupBy("doc_id", "list_order").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
        feats = fx.featurize(chunks, "chunk", cfg.dim, fz)
        docs_ok = firsts
        width_rejects = files.sparkSession.createDataFrame([], "path string, reason string")
    else:
        feats = materialize(
            fx.featurize(chunks, "chunk", cfg.dim, fz).select("doc_id", "list_order", "chunk_no", "embedding"),
            "ingest-features",
            None if staging_path is None else staging_path.rstrip("/") + "-features",
        )
        feats, bad_width = vec.check_width(feats, cfg.dim)
        per_doc = feats.groupBy("doc_id", "list_order").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
        docs_ok = firsts.join(bad_width.select(F.col("doc_id").alias("id")), "id", "left_anti")
        width_rejects = bad_width.join(firsts.select(F.col("id").alias("doc_id"), "path"), "doc_id").select(
            "path", "reason"
        )
    offsets = vec.document_offsets(per_doc, ["list_order", "doc_id"], "n", start).select("doc_id", "first_pos")
    # one row per new document: broadcast only when that count is checked
    # small, else a shuffle join on doc_id
    if firsts.count() <= cfg.max_broadcast_rows:
        offsets = F.broadcast(offsets)
    new_vectors = feats.join(offsets, "doc_id").select(
        (F.col("first_pos") + F.col("chunk_no")).cast("bigint").alias("pos"),
        "doc_id",
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    return IngestResult(
        registry_rows=reg.registry_rows(docs_ok),
        vectors=new_vectors,
        chunks=chunks.select("doc_id", "chunk_no", "start", "end", "chunk"),
        rejected=bad.unionByName(width_rejects),
    )


def files_from_folder_batch(raw: DataFrame, md_to_html=None) -> DataFrame:
    """binaryFile rows -> (path, format, text, _utf8, list_order); listing
    order is the path order. ``md_to_html``: see ``decode_files``."""
    return src.decode_files(raw, md_to_html).withColumn("list_order", F.col("path"))


def files_from_folder(spark, folder: str, md_to_html=None) -> DataFrame:
    """S1 -> (path, list_order, text, _utf8)."""
    return files_from_folder_batch(src.read_folder(spark, folder), md_to_html)
