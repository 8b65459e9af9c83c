"""Recursive overlapping character chunking.

Rule (separators tried in order "\\n\\n", "\\n", " ", ""; size 300, overlap 50):

1. Use the first separator that occurs in the text ("" always matches).
2. Split on it; the separator stays at the start of the following piece;
   empty pieces are dropped.
3. Pieces shorter than ``size`` are collected into a run; a longer piece
   flushes the run and is split again with the later separators (or kept
   whole when none are left).
4. A run is merged greedily: add pieces while the total stays <= size; on
   overflow emit the group, then drop pieces from its front while
   total > overlap or (total + next > size and total > 0).
5. Each emitted group is stripped (Python whitespace); blank groups vanish.

Because separators are kept, every chunk is a contiguous span of the text:
the per-row work computes the spans and slices them (Arrow batch UDF, one
list array per batch); ``posexplode`` turns them into rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.config import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS

# documents longer than this are chunked cell by cell across tasks
SPLIT_DOC_CHARS = 1_000_000
CELL_CHARS = 1_000_000


def _strip_span(text: str, a: int, b: int):
    seg = text[a:b]
    st = seg.strip()
    if not st:
        return None
    a2 = a + (len(seg) - len(seg.lstrip()))
    return a2, a2 + len(st)


def _pieces(text: str, lo: int, hi: int, sep: str):
    """[start, end) of the pieces of text[lo:hi] split on ``sep``, the
    separator kept at the start of the following piece, empty pieces dropped."""
    if sep == "":
        return [(i, i + 1) for i in range(lo, hi)]
    parts = text[lo:hi].split(sep)
    w = len(sep)
    out = []
    a = lo
    b = lo + len(parts[0])
    if b > a:
        out.append((a, b))
    for p in parts[1:]:
        a, b = b, b + w + len(p)
        out.append((a, b))
    return out


def _merge(text, run, size, overlap, out):
    start = 0  # index into run of the current group's first piece
    total = 0
    for i, (a, b) in enumerate(run):
        n = b - a
        if total + n > size:
            if i > start:
                sp = _strip_span(text, run[start][0], run[i - 1][1])
                if sp:
                    out.append(sp)
                while total > overlap or (total + n > size and total > 0):
                    total -= run[start][1] - run[start][0]
                    start += 1
        total += n
    if start < len(run):
        sp = _strip_span(text, run[start][0], run[-1][1])
        if sp:
            out.append(sp)


def _split(text, lo, hi, seps, size, overlap, out):
    sep, rest = seps[-1], ()
    for i, s in enumerate(seps):
        if s == "":
            sep = s
            break
        if text.find(s, lo, hi) != -1:
            sep, rest = s, seps[i + 1:]
            break
    run = []
    for a, b in _pieces(text, lo, hi, sep):
        if b - a < size:
            run.append((a, b))
            continue
        if run:
            _merge(text, run, size, overlap, out)
            run = []
        if not rest:
            sp = _strip_span(text, a, b)
            if sp:
                out.append(sp)
        else:
            _split(text, a, b, rest, size, overlap, out)
    if run:
        _merge(text, run, size, overlap, out)


def chunk_spans(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                separators=SEPARATORS) -> list[tuple[int, int]]:
    """Chunk boundaries as [start, end) code-point offsets."""
    if not text:
        return []
    if len(text) <= size:  # whole text is one group
        sp = _strip_span(text, 0, len(text))
        return [sp] if sp else []
    out: list[tuple[int, int]] = []
    _split(text, 0, len(text), tuple(separators), size, overlap, out)
    return out


CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("chunk", T.StringType()),
        ]
    )
)


def _chunks_udf(size: int, overlap: int, separators):
    @F.arrow_udf(CHUNK_TYPE)
    def chunks(texts: pa.Array) -> pa.Array:
        """Texts -> [(start, end, chunk), ...] per row, as one list array.
        Python slices each chunk in O(length): linear in the document, where
        cutting by code-point offsets in the JVM would rescan from the start
        for every chunk."""
        starts: list[int] = []
        ends: list[int] = []
        pieces: list[str] = []
        offsets = [0]
        for t in texts.to_pylist():
            for a, b in chunk_spans(t, size, overlap, separators):
                starts.append(a)
                ends.append(b)
                pieces.append(t[a:b])
            offsets.append(len(pieces))
        items = pa.StructArray.from_arrays(
            [pa.array(starts, type=pa.int32()), pa.array(ends, type=pa.int32()), pa.array(pieces, type=pa.string())],
            names=["start", "end", "chunk"],
        )
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items)

    return chunks


def chunk_array(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> Column:
    """array<struct<start, end, chunk>> for a text column."""
    t = F.col(text) if isinstance(text, str) else text
    return _chunks_udf(size, overlap, tuple(separators))(t)


def explode_chunks(df: DataFrame, chunks_col: str, keep: list[str]) -> DataFrame:
    """Chunk array -> one row per chunk (keep..., chunk_no, start, end, chunk).
    ``start``/``end`` are 0-based code-point offsets."""
    rows = df.select(*keep, F.posexplode(chunks_col).alias("chunk_no", "_c"))
    return rows.select(
        *keep,
        F.col("chunk_no").cast("bigint"),
        F.col("_c.start").cast("bigint").alias("start"),
        F.col("_c.end").cast("bigint").alias("end"),
        F.col("_c.chunk").alias("chunk"),
    )


def _cells_udf(cell_chars: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cells(texts: pa.Array) -> pa.Array:
        cut = [[t[i : i + cell_chars] for i in range(0, len(t or ""), cell_chars)] for t in texts.to_pylist()]
        return pa.array(cut, pa.list_(pa.string()))

    return cells


def chunk_or_cells(text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS,
                   split_chars: int = SPLIT_DOC_CHARS, cell_chars: int = CELL_CHARS) -> tuple[Column, Column]:
    """Two columns for one pass over the documents: the chunks of documents
    up to ``split_chars`` characters, and the cells of longer ones, which are
    cut but not searched here (``slices``). Each UDF sees NULL for the other
    kind, so a huge document is never chunked whole inside one task."""
    length = F.length(text_col)
    small_text = F.when(length <= split_chars, F.col(text_col))
    big_text = F.when(length > split_chars, F.col(text_col))
    return chunk_array(small_text, size, overlap, tuple(separators)), _cells_udf(cell_chars)(big_text)


def rows_from_staged(staged: DataFrame, keep: list[str], chunks_col: str = "chunks", cells_col: str = "cells",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS,
                     split_chars: int = SPLIT_DOC_CHARS, cell_chars: int = CELL_CHARS) -> DataFrame:
    """Chunk rows (keep..., chunk_no, start, end, chunk) from a document-level
    table holding ``chunks`` (small documents) and ``cells`` (huge ones);
    ``keep[0]`` names the document.

    Cells are chunked by tasks of their own (``slices``). That branch is only
    planned when some document has cells (a pruned read of that column)."""
    whole = explode_chunks(staged.where(F.size(chunks_col) > 0), chunks_col, keep)
    huge = staged.where(F.size(cells_col) > 0)
    if huge.select(cells_col).isEmpty():
        return whole
    from docsift.functions import slices
    from docsift.operators.sizing import broadcast_if_small

    cells = huge.select(F.col(keep[0]).cast("string").alias("doc"), F.posexplode(cells_col).alias("_i", "text"))
    parts = cells.select("doc", (F.col("_i") * F.lit(cell_chars)).cast("bigint").alias("offset"), "text")
    chunks = slices.numbered(slices.chunk_parts(parts, size, overlap, separators, cell_chars, split_chars))
    docs = broadcast_if_small(huge.select(*keep))
    rows = chunks.join(docs, chunks["doc"] == docs[keep[0]].cast("string"))
    return whole.unionByName(rows.select(*keep, "chunk_no", "start", "end", "chunk"))


def chunk_rows(df: DataFrame, text_col: str, keep: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators=SEPARATORS, split_chars: int = SPLIT_DOC_CHARS, cell_chars: int = CELL_CHARS) -> DataFrame:
    """F13 as a job: documents -> (keep..., chunk_no, start, end, chunk).

    One pass computes chunks (or, for documents over ``split_chars``, cells);
    that document-level result is written once under the checkpoint
    directory, and the rows are read from it (``rows_from_staged``)."""
    from docsift.session import materialize

    chunks, cells = chunk_or_cells(text_col, size, overlap, separators, split_chars, cell_chars)
    staged = materialize(df.select(*keep, chunks.alias("chunks"), cells.alias("cells")), "chunk-staging")
    return rows_from_staged(staged, keep, size=size, overlap=overlap, separators=separators, split_chars=split_chars, cell_chars=cell_chars)


chunk = chunk_rows  # F13 as a job
