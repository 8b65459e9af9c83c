"""File and page sources.

``read_folder`` is the folder scan: one row per file of a folder, every one
of them (``sources/folder.py``). Decoding, validation and extraction are
column expressions, and failures become rows of a ``rejected`` frame, never
exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.operators import sizing
from docsift.session import materialize
from docsift.sources import folder as fld


#: Formats whose bytes are decoded here; files of others are listed, not opened.
TEXT_EXTENSIONS = (".txt", ".md")


def read_folder(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, skipped_only: bool = False
) -> DataFrame:
    """(path, length, content, error) for the direct children of a folder."""
    return fld.scan(spark, folder, extensions, skipped_only)


def decode_files(raw: DataFrame, md_to_html: Callable[[Column], Column] | None = None) -> DataFrame:
    """S2+S3+S4: (path, format, text) with text NULL when undecodable.

    Strict UTF-8 (``is_valid_utf8`` guard instead of a failing decode), CRLF
    and CR folded to LF, BOM kept. Markdown goes through ``md_to_html``, the
    caller's renderer, and the tag-run extraction; without a renderer its
    text is NULL. PDF bytes cannot be parsed here (text NULL), PDF text
    enters through ``concat_pages`` instead. An ``error`` of the reader is
    kept as the reason to reject the file."""
    fmt = tx.detect_format("path")
    valid = F.expr("is_valid_utf8(content)")
    decoded = tx.fold_newlines(F.when(valid, F.col("content").cast("string")))
    text = F.when(fmt == "txt", decoded)
    if md_to_html is not None:
        text = text.when(fmt == "md", tx.html_text_runs(md_to_html(decoded)))
    cols = ["path", fmt.alias("format"), text.alias("text"), valid.alias("_utf8")]
    return raw.select(*cols, *([F.col("error").alias("_error")] if "error" in raw.columns else []))


def reject_reasons(files: DataFrame) -> F.Column:
    """Why a file yields no document (NULL when it is fine).

    files: (path, format?, text). Order of checks follows the reproduced
    flow: type, decoding, empty text (no first line), no chunks."""
    fmt = tx.detect_format("path")
    reason = F.when(fmt.isNull(), F.lit("Unsupported file type"))
    if "_error" in files.columns:
        reason = reason.when(F.col("_error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("_error")))
    if "_utf8" in files.columns:
        reason = reason.when(~F.col("_utf8"), F.lit("invalid UTF-8"))
    if "format" in files.columns:
        reason = reason.when(F.col("text").isNull() & (fmt == "pdf"), F.lit("PDF parsing not available"))
        reason = reason.when(F.col("text").isNull() & (fmt == "md"), F.lit("no Markdown renderer given"))
    return (
        reason.when(F.col("text").isNull(), F.lit("no text"))
        .when(F.col("text") == "", F.lit("empty text"))
        .when(tx.is_blank("text"), F.lit("no chunks"))
    )


def split_rejected(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted files, rejected(path, reason))."""
    tagged = files.withColumn("_reason", reject_reasons(files))
    good = tagged.where(F.col("_reason").isNull()).drop("_reason", "_utf8", "_error")
    bad = tagged.where(F.col("_reason").isNotNull()).select("path", F.col("_reason").alias("reason"))
    return good, bad


def concat_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """Page texts of a document joined in page order, no separator.

    One output string per document is the semantics; the aggregate is
    partial per partition and ordered by page number."""
    return pages.groupBy(doc_col).agg(
        F.expr(f"listagg({text_col}, '') WITHIN GROUP (ORDER BY {page_col})").alias("text")
    )


def read_by_path(requests: DataFrame, files: DataFrame | None = None, path_col: str = "file_path", strict: bool = False) -> DataFrame:
    """Texts for a list of paths; input rows and duplicates kept. A
    missing path is flagged (``missing``); with ``strict`` one missing path
    fails the whole batch, as the reproduced reader did.

    Without ``files`` the paths are opened: each distinct one once, by the task
    that has it, and no other file of the folder. ``files`` (path, text) is a
    table of texts instead."""
    if files is None:
        opened = materialize(decode_files(fld.open_paths(requests, path_col)), "opened-files")
        content = opened.where(F.coalesce(F.col("_error") != fld.MISSING, F.lit(True))).select(F.col("path").alias("_p"), F.col("text").alias("content"))
        content = sizing.broadcast_if_small(content)
    else:
        wanted = requests.select(F.col(path_col).alias("path")).distinct()
        # filter the (large) file table by the requested set first: with a
        # checked small request set the semi-join streams the files (broadcast
        # build side); the following join is small on both sides
        needed = files.join(sizing.broadcast_if_small(wanted), "path", "left_semi")
        content = needed.select(F.col("path").alias("_p"), F.col("text").alias("content"))
    out = requests.join(content, requests[path_col] == content["_p"], "left")
    out = out.select(*[requests[c] for c in requests.columns], "content", F.col("_p").isNull().alias("missing"))
    if strict:
        bad = out.where("missing").select(path_col).first()
        if bad is not None:
            raise FileNotFoundError(bad[0])
    return out
