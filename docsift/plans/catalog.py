"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each one reads whole driver tables (see ``fixtures``) and exercises the
operators named in its docstring. Column names and types match the SQL in
``oracles`` (bigint for integers, double for reals, distances rounded to 6
places because the two engines sum squares in different orders).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.config import DEFAULT
from docsift.functions import chunking
from docsift.functions import features as fx
from docsift.functions import slices
from docsift.functions import text as tx
from docsift.operators import answers as ans
from docsift.operators import registry as reg
from docsift.operators import retrieval, search
from docsift.operators import vectors as vec
from docsift.plans import fixtures as fxt
from docsift.plans import ingest
from docsift.session import materialize
from docsift.sources import files as src

Query = Callable[[SparkSession, str], DataFrame]
RETRIEVE_K = DEFAULT.retrieve_k  # 3
SEARCH_K = DEFAULT.top_k  # 5
PADDED_K = 16  # larger than the number of labels, so slots stay empty


def _round(c: str = "dist"):
    return F.round(F.col(c), 6).alias(c)


# -- search and retrieval ---------------------------------------------------

def retrieve_top3(spark, d):
    """C2 flagship: every embedding queries the index; top-3 hits -> distinct
    documents -> registry metadata (J2-J4, A5, A6, W1, K1, J3)."""
    return retrieval.retrieve(fxt.vectors(spark, d), fxt.registry(spark, d), fxt.query_vectors(spark, d), RETRIEVE_K)


def knn_top5(spark, d):
    """K1: exact top-5 by squared L2, ties by position."""
    hits = search.knn(fxt.vectors(spark, d), fxt.query_vectors(spark, d), SEARCH_K)
    return hits.select("query_id", "rank", "pos", "doc_id", _round())


def label_centroids(spark, d) -> DataFrame:
    """Index of per-label mean vectors (pos = label) derived from embeddings."""
    e = fxt.table(spark, d, "embeddings")
    el = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = el.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")
    ).select(
        F.col("label").cast("bigint").alias("pos"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("doc_id"),
        "embedding",
    )


def knn_padded(spark, d):
    """K2: k (16) larger than the index (one centroid per label): slots past
    the index size carry pos -1 and no document."""
    hits = search.knn(label_centroids(spark, d), fxt.query_vectors(spark, d), PADDED_K, pad=True)
    return hits.select("query_id", "rank", "pos", "doc_id", _round())


def knn_with_deleted_docs(spark, d):
    """M8/M9: documents deleted from the registry keep their vectors; their
    hits still take top-k slots and vanish only at the metadata join."""
    r = reg.delete(fxt.registry(spark, d), fxt.deleted_ids(spark, d))
    return retrieval.retrieve(fxt.vectors(spark, d), r, fxt.query_vectors(spark, d), RETRIEVE_K)


def position_lookup(spark, d):
    """Position -> document, NULL for positions past the index."""
    e = fxt.table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("pos"))
    return vec.position_lookup(e, fxt.vectors(spark, d)).select("pos", "doc_id")


def last_position_per_doc(spark, d):
    """A2: document -> last position."""
    return vec.last_position(fxt.vectors(spark, d))


def vector_counts(spark, d):
    """A3: vectors per document."""
    return vec.counts_per_document(fxt.vectors(spark, d))


def vector_total(spark, d):
    """A3: ntotal."""
    return vec.total(fxt.vectors(spark, d))


def _reappend(vectors: DataFrame, subset: DataFrame) -> DataFrame:
    """W2 + U1: append ``subset`` again after the current index; new
    positions are dense from max(pos)+1 in (doc_id, old pos) order."""
    base = vec.next_position(vectors)
    ones = subset.select("doc_id", F.col("pos").alias("src_pos"), F.lit(1).cast("bigint").alias("_one"))
    placed = vec.document_offsets(ones, ["doc_id", "src_pos"], "_one", base)
    return placed.select(F.col("first_pos").alias("pos"), "doc_id", "src_pos")


def append_positions(spark, d):
    """W2 + U1 + M7: storing every vector again appends a second copy."""
    v = fxt.vectors(spark, d)
    return _reappend(v, v)


def reingest_after_delete(spark, d):
    """Deleted documents ingested again append their vectors again."""
    v = fxt.vectors(spark, d)
    return _reappend(v, v.join(fxt.deleted_ids(spark, d).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"))


def reject_bad_width(spark, d):
    """Vectors one element short (vec_id % 11 = 0) fail their whole
    document; the kept rows remain."""
    v = fxt.vectors(spark, d)
    short = F.when(F.col("pos") % 11 == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    kept, _ = vec.check_width(v.withColumn("embedding", short), fxt.embedding_width(spark, d))
    return kept.select("pos", "doc_id")


# -- registry ---------------------------------------------------------------

def content_ids(spark, d):
    """md5 content id of every document."""
    return fxt.table(spark, d, "documents").select("doc_id", tx.content_id("text").alias("id"))


def titles(spark, d):
    """F2 + F3: first line, stripped."""
    return fxt.table(spark, d, "documents").select("doc_id", tx.title("text").alias("title"))


def dedup_first_wins(spark, d):
    """A1: one row per content; the lowest listing order wins."""
    docs = fxt.table(spark, d, "documents").select(
        tx.content_id("text").alias("id"), F.col("doc_id").alias("list_order"), F.lit(1).alias("_one")
    )
    winners = reg.dedup_first_wins(docs.select("id", "list_order"), "list_order")
    copies = docs.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("copies"))
    return winners.join(copies, "id").select("id", F.col("list_order").alias("first_doc_id"), "copies")


def incremental_ingest(spark, d):
    """All files arrive at a registry holding the even ones; only unseen
    content is added, deduplicated."""
    mixed = fxt.mixed_files(spark, d)
    good, _ = src.split_rejected(mixed)
    new = reg.insert_if_absent(ingest.identify(good, keep_text=False), fxt.registry0(spark, d, mixed))
    return reg.registry_rows(new)


def registry_list(spark, d):
    """P1."""
    return reg.list_documents(fxt.registry(spark, d))


def registry_titles(spark, d):
    """P2 (duplicates kept)."""
    return reg.list_titles(fxt.registry(spark, d))


def registry_exists(spark, d):
    """P3 for every file against the even-file registry."""
    ids = fxt.files(spark, d).select("path", tx.content_id("text").alias("id"))
    return reg.exists(ids, fxt.registry0(spark, d))


def registry_lookup(spark, d):
    """IN-list of every vector's document (duplicates, unknown ids)."""
    ids = fxt.vectors(spark, d).select(F.col("doc_id").alias("id"))
    return reg.lookup(fxt.registry(spark, d), ids)


def registry_delete(spark, d):
    """P7."""
    return reg.delete(fxt.registry(spark, d), fxt.deleted_ids(spark, d))


# -- sources ----------------------------------------------------------------

def detect_format(spark, d):
    """S2 + F4."""
    f = fxt.mixed_files(spark, d)
    return f.select("path", tx.file_extension("path").alias("ext"), tx.detect_format("path").alias("format"))


def quarantine(spark, d):
    """Unsupported type, empty text, blank text."""
    _, bad = src.split_rejected(fxt.mixed_files(spark, d))
    return bad


def html_text_runs(spark, d):
    """Tag runs with their brackets, joined."""
    p = fxt.table(spark, d, "pages")
    return p.select("page_id", tx.html_text_runs("html").alias("text"))


def html_runs_title(spark, d):
    """S4 + F1 + F2 on the extracted text."""
    p = fxt.table(spark, d, "pages").select("page_id", tx.html_text_runs("html").alias("t"))
    return p.select("page_id", tx.content_id("t").alias("id"), tx.title("t").alias("title"))


def page_concat(spark, d):
    """S5 + A4: conversations as PDFs (conv = document, turn = page)."""
    c = fxt.table(spark, d, "conversations")
    pages = src.concat_pages(c, "conv_id", "turn", "text")
    return pages.select("conv_id", tx.content_id("text").alias("id"), F.length("text").cast("bigint").alias("n_chars"), "text")


def read_by_path(spark, d):
    """Every retrieved path read back (duplicates kept, missing flagged)."""
    r = materialize(retrieve_top3(spark, d).select("query_id", "rank", "file_path"), "retrieved")
    out = src.read_by_path(r, fxt.files(spark, d))
    return out.select("query_id", "rank", "file_path", F.length("content").cast("bigint").alias("n_chars"), "missing")


def folder_scan(spark, d):
    """S1 + S3 + S8: all documents written as files of a folder and scanned:
    every file listed, read or rejected with its reason."""
    root = fxt.folder(spark, fxt.folder_files_of(fxt.table(spark, d, "documents")), "folder-scan")
    good, bad = src.split_rejected(src.decode_files(src.read_folder(spark, root)))
    name = F.regexp_extract("path", "[^/]*$", 0).alias("name")
    read = good.select(name, tx.content_id("text").alias("id"), F.length("text").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("reason"))
    none = bad.select(name, F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("n_chars"), "reason")
    return read.unionByName(none)


def read_opened_files(spark, d):
    """S6 + J6: the retrieved files opened by their paths in a folder that holds
    all documents but every 9th; duplicates kept, missing ones flagged."""
    docs = fxt.table(spark, d, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")
    there = docs.where(F.col("doc_id") % 9 != 0).select(name, F.col("text").cast("binary").alias("content"))
    root = fxt.folder(spark, there, "opened-files")
    number = F.regexp_extract("file_path", "kb/([0-9]+)", 1)
    hits = materialize(retrieve_top3(spark, d).select("query_id", "rank", F.concat(F.lit(root + "/"), number, F.lit(".txt")).alias("path")), "retrieved")
    out = src.read_by_path(hits, path_col="path")
    return out.select(
        "query_id", "rank", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.md5("content").alias("id"),
        F.length("content").cast("bigint").alias("n_chars"), "missing",
    )


# -- questions, prompts, answers --------------------------------------------

def _question_vectors(questions: DataFrame, width: int) -> DataFrame:
    """Written once: a search counts its queries before it reads them."""
    return materialize(fx.featurize(questions, "text", width).select("query_id", "embedding"), "question-vectors")


def query_features(spark, d):
    """hashed, normalised features of every question (sparse form)."""
    return fx.sparse_features(fxt.questions(spark, d), ["query_id"], "text", fxt.embedding_width(spark, d))


def model_features(spark, d):
    """F14 as a model hook: every question encoded in batches by a loaded model
    (here the hashing rule in numpy), as non-zero entries."""
    width = fxt.embedding_width(spark, d)
    model = fx.model_featurizer(lambda: (width, regex.compile(fx.TOKEN_PATTERN)), _hash_encode, width)
    dense = fx.featurize(fxt.questions(spark, d), "text", width, model)
    return nonzero_entries(dense, "query_id")


def _hash_encode(model, texts: list[str]) -> np.ndarray:
    width, token = model
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        for tok in token.findall(text.lower()):
            code = hashlib.md5(tok.encode()).hexdigest()
            row[int(code[:8], 16) % width] += -1 if int(code[8], 16) % 2 else 1
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1.0)[:, None]


def retrieve_questions(spark, d):
    """C2 from text: question -> features -> top-3 -> documents."""
    width = fxt.embedding_width(spark, d)
    return retrieval.retrieve(
        fxt.vectors(spark, d), fxt.registry(spark, d), _question_vectors(fxt.questions(spark, d), width), RETRIEVE_K, dim=width
    )


def _retrieved(spark, d):
    """Retrieval for every question, written once under the checkpoint
    directory: prompts, responses and answers all read it."""
    return materialize(retrieve_questions(spark, d), "retrieved")


def _prompts(spark, d, retrieved: DataFrame | None = None):
    r = _retrieved(spark, d) if retrieved is None else retrieved
    return ans.build_prompts(r, fxt.questions(spark, d), fxt.files(spark, d))


def _kept(spark, d):
    """The answers need hits and responses only, no prompt text."""
    r = _retrieved(spark, d)
    hits = r.select("query_id", F.col("id").alias("doc_id"), "rank", "file_path")
    return ans.keep_informative(hits, fxt.responses(spark, d, hits))


def prompts(spark, d):
    """J6 + F5 + F8."""
    return _prompts(spark, d).select("query_id", "doc_id", "rank", "prompt")


def messages(spark, d):
    """system + user message per prompt, one row per message."""
    m = ans.messages(_prompts(spark, d), DEFAULT.system_prompt)
    return m.select("query_id", "doc_id", F.posexplode("messages").alias("msg_no", "msg")).select(
        "query_id", "doc_id", F.col("msg_no").cast("bigint"), F.col("msg.role").alias("role"), F.col("msg.content").alias("content")
    )


def filter_answers(spark, d):
    """J5 + F16 + P5."""
    return _kept(spark, d)


def format_answers(spark, d):
    """one answer per question."""
    return ans.format_answers(_kept(spark, d), fxt.questions(spark, d))


def answer_queries(spark, d):
    """Route every question, retrieve and format only for the
    'retrieve' ones, name the listing (``title_message``) for 'list', model
    answer for 'converse'."""
    q = fxt.questions(spark, d)
    routes = materialize(ans.route(q, keywords=fxt.FIXTURE_KEYWORDS), "routes")
    wanted = q.join(routes.where(F.col("route") == "retrieve"), "query_id", "left_semi")
    width = fxt.embedding_width(spark, d)
    qv = _question_vectors(wanted, width)
    hits = materialize(
        retrieval.retrieve(fxt.vectors(spark, d), fxt.registry(spark, d), qv, RETRIEVE_K, dim=width), "retrieved"
    )
    keyed = hits.select("query_id", F.col("id").alias("doc_id"), "rank", "file_path")
    kept = ans.keep_informative(keyed, fxt.responses(spark, d, keyed))
    formatted = ans.format_answers(kept, wanted)
    return ans.answer(routes, formatted, fxt.converse_responses(spark, d))


def route_queries(spark, d):
    """the reproduced phrases, fixture keywords."""
    return ans.route(fxt.questions(spark, d), keywords=fxt.FIXTURE_KEYWORDS)


def title_message(spark, d):
    """F11 as lines."""
    return ans.title_message_lines(fxt.registry(spark, d))


# -- ingest (chunking, featurisation, positions) ----------------------------

def _ingest(spark, d):
    return ingest.ingest(fxt.files(spark, d), None, vec.empty_vectors(spark), DEFAULT, base=0)


def _chunks(spark, d):
    staged, _ = ingest.stage(fxt.files(spark, d), None)
    return chunking.rows_from_staged(materialize(staged, "chunk-staging"), ["id"]).withColumnRenamed("id", "doc_id")


def chunks(spark, d):
    """F13 over every accepted, deduplicated document."""
    return _chunks(spark, d).select("doc_id", "chunk_no", "start", "chunk")


def chunk_counts(spark, d):
    """A3: chunks per document (partial aggregate of the chunk rows)."""
    return _chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"))


def chunk_features(spark, d):
    """F13 + F14 + F15: the dense vectors the ingest stores, non-zero entries."""
    dense = fx.featurize(_chunks(spark, d), "chunk", DEFAULT.dim)
    return nonzero_entries(dense, "doc_id", "chunk_no")


def page_chunks(spark, d):
    """S5 + A4 + F13: conversations as page tables, chunked across the page
    borders without the whole string; cells of a thousand characters, so that
    most documents have several."""
    c = fxt.table(spark, d, "conversations")
    out = slices.chunk_pages(c, "conv_id", "turn", "text", cell_chars=1000, split_chars=2000)
    return out.select(F.col("doc").alias("doc_id"), "chunk_no", "start", "chunk")


def nonzero_entries(vectors: DataFrame, *keys: str) -> DataFrame:
    """Dense vectors as (keys, bucket, weight), zeros left out."""
    e = vectors.select(*keys, F.posexplode("embedding").alias("bucket", "weight")).where(F.col("weight") != 0)
    return e.select(*keys, F.col("bucket").cast("bigint"), F.col("weight").cast("double"))


def ingest_end_to_end(spark, d):
    """Registry rows after the full job (chunk, featurise, width check)."""
    return _ingest(spark, d).registry_rows


def ingest_positions(spark, d):
    """C1 + W2: first position and vector count per document."""
    v = _ingest(spark, d).vectors
    return v.groupBy("doc_id").agg(
        F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).cast("bigint").alias("n_vectors")
    )


QUERIES: dict[str, Query] = {
    "retrieve_top3": retrieve_top3,
    "knn_top5": knn_top5,
    "knn_padded": knn_padded,
    "knn_with_deleted_docs": knn_with_deleted_docs,
    "position_lookup": position_lookup,
    "last_position_per_doc": last_position_per_doc,
    "vector_counts": vector_counts,
    "vector_total": vector_total,
    "append_positions": append_positions,
    "reingest_after_delete": reingest_after_delete,
    "reject_bad_width": reject_bad_width,
    "content_ids": content_ids,
    "titles": titles,
    "dedup_first_wins": dedup_first_wins,
    "incremental_ingest": incremental_ingest,
    "registry_list": registry_list,
    "registry_titles": registry_titles,
    "registry_exists": registry_exists,
    "registry_lookup": registry_lookup,
    "registry_delete": registry_delete,
    "detect_format": detect_format,
    "quarantine": quarantine,
    "html_text_runs": html_text_runs,
    "html_runs_title": html_runs_title,
    "page_concat": page_concat,
    "read_by_path": read_by_path,
    "folder_scan": folder_scan,
    "read_opened_files": read_opened_files,
    "query_features": query_features,
    "model_features": model_features,
    "retrieve_questions": retrieve_questions,
    "prompts": prompts,
    "messages": messages,
    "filter_answers": filter_answers,
    "format_answers": format_answers,
    "route_queries": route_queries,
    "answer_queries": answer_queries,
    "title_message": title_message,
    "chunks": chunks,
    "chunk_counts": chunk_counts,
    "page_chunks": page_chunks,
    "chunk_features": chunk_features,
    "ingest_end_to_end": ingest_end_to_end,
    "ingest_positions": ingest_positions,
}
