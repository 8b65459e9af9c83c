"""Chunking of documents that no task holds whole.

A document is a sequence of cells of equal length, cut from one huge text or
from the texts of its pages. The chunks are those of ``chunking.chunk_spans``
over the whole text:

1. Pieces begin at the separators. A cell sees its text and ``ahead``, the
   first characters of the next cell, so that every step from a position in
   it is known there. Of a separator of equal characters (an empty line) that
   crosses the cells, the cell needs to know whether the first of its own
   line breaks is taken: a parity, which each cell passes on.
2. Where one group of pieces begins, the next begin follows (``Cell.follow``):
   chunk begins are the path of these steps from the start of the document.
   Paths that enter a cell at different places soon run together, so a cell is
   summed up as a table: from each place where a path can enter to the place
   where it leaves, for either parity.
3. The tables of a document are short (a step is shorter than ``ahead``) and are
   folded in order; the fold gives each cell its parity and entry, and names the
   long pieces that cross into cells beyond what ``ahead`` shows.
4. Each cell walks its own part of the path and cuts its chunks. Crossing long
   pieces are documents of their own for the later separators: small ones are
   put together, huge ones are cut in cells again.

Steps 1, 2 and 4 are tasks of one cell each; only tables meet per document.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.config import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS
from docsift.functions.chunking import CELL_CHARS, SPLIT_DOC_CHARS, _split, _strip_span

_SUMMARY = "doc string, span string, cell bigint, parity int, out int, first bigint, entries array<bigint>, exits array<bigint>"
_FOLDED = "doc string, span string, cell bigint, parity int, entry bigint, begin bigint, stop bigint"
_CHUNKS = "doc string, span string, at array<bigint>, start bigint, end bigint, chunk string"


def ahead_chars(size: int, separators) -> int:
    return 2 * size + max(map(len, separators))


class Cell:
    """Piece starts of a cell and what is ahead of it. ``closed``: the text
    reaches the end of the document."""

    def __init__(self, text: str, n: int, sep: str, parity: int, first: bool, closed: bool, size: int, overlap: int) -> None:
        self.text, self.n, self.size, self.overlap = text, n, size, overlap
        self.end = len(text) if closed else None
        if not sep:
            self.edges = list(range(len(text)))
            return
        self.edges = [0] if first and text else []
        at = text.find(sep, 1 if parity and text[:1] == sep[0] else 0)
        while at >= 0:
            if at or not first:
                self.edges.append(at)
            at = text.find(sep, at + len(sep))

    def stop(self, i: int) -> int | None:
        """Where piece i ends; None if that is beyond what is ahead."""
        return self.edges[i + 1] if i + 1 < len(self.edges) else self.end

    def long(self, i: int) -> bool:
        stop = self.stop(i)
        return stop is None or stop - self.edges[i] >= self.size

    def follow(self, i: int) -> tuple[int | None, int | None]:
        """(end of the group or long piece that begins at edge i, the next begin)."""
        if self.long(i):
            return self.stop(i), self.stop(i)
        limit = self.edges[i] + self.size
        j = bisect_right(self.edges, limit) - 1
        if self.long(j):
            return self.edges[j], self.edges[j]
        if self.stop(j) <= limit:  # the document ends in this group
            return self.stop(j), self.stop(j)
        least = max(self.edges[j] - self.overlap, self.stop(j) - self.size)
        return self.edges[j], self.edges[min(j, bisect_left(self.edges, least, i))]

    def exits(self) -> list[int]:
        """For each edge of the cell where the path from it leaves; -1 - begin for a
        long piece whose end is not in sight."""
        own = bisect_left(self.edges, self.n)
        out = [0] * own
        for i in range(own - 1, -1, -1):
            to = self.follow(i)[1]
            if to is None:
                out[i] = -1 - self.edges[i]
            else:
                out[i] = to if to >= self.n else out[bisect_left(self.edges, to)]
        return out

    def walk(self, entry: int) -> Iterator[tuple[int, int | None, bool]]:
        """(begin, end, is a long piece) of the groups that begin in the cell."""
        at: int | None = entry
        while at is not None and at < self.n:
            i = bisect_left(self.edges, at)
            end, to = self.follow(i)
            yield at, end, self.long(i)
            at = to


def out_parity(text: str, n: int, sep: str, parity: int) -> int:
    """Line breaks of a separator of two that are open at the end of the cell."""
    if len(sep) < 2:
        return 0
    run = n - len(text[:n].rstrip(sep[0]))
    return (run + (parity if run == n else 0)) % len(sep)


def _summaries(size: int, overlap: int, separators, ahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, span, cell, start, text, more, closed, sep in zip(*(c.to_pylist() for c in b.columns)):
                for parity in range(max(1, len(separators[sep]))):
                    c = Cell(text + more, len(text), separators[sep], parity, cell == 0, closed, size, overlap)
                    exits = c.exits()
                    known = [i for i in range(len(exits)) if i == 0 or c.edges[i] < ahead]
                    rows.append((
                        doc, span, cell, parity, out_parity(text, len(text), separators[sep], parity),
                        start + c.edges[0] if exits else None, [start + c.edges[i] for i in known],
                        [start + exits[i] if exits[i] >= 0 else exits[i] - start for i in known],
                    ))
            yield _batch(rows, _SUMMARY)

    return run


def fold(cells: list[tuple[int, int, int, dict[int, tuple]]]) -> Iterator[tuple]:
    """Cells (number, start, end, tables by parity) of a document in order ->
    (cell, parity, entry, None, None) and (None, None, None, begin, end) of the
    long pieces that cross them."""
    parity, state = 0, 0
    for cell, _, end, tables in cells:
        out, first, exits = tables[parity]
        entry = None
        if state < 0:
            if first is not None:
                yield None, None, None, -1 - state, first
                entry = first
        elif state < end:
            entry = state
        yield cell, parity, entry, None, None
        if entry is not None:
            state = exits[entry]
        parity = out
    if state < 0:
        yield None, None, None, -1 - state, cells[-1][2]


def _folded(key, pdf):
    import pandas as pd

    doc, span = key
    cells = []
    for cell, rows in pdf.sort_values(["cell", "parity"]).groupby("cell"):
        tables = {
            int(r.parity): (int(r.out), None if pd.isna(r.first) else int(r.first), dict(zip(map(int, r.entries), map(int, r.exits))))
            for r in rows.itertuples()
        }
        cells.append((int(cell), int(rows["start"].iloc[0]), int(rows["end"].iloc[0]), tables))
    out = pd.DataFrame(list(fold(cells)), columns=["cell", "parity", "entry", "begin", "stop"]).astype("Int64")
    out.insert(0, "span", span)
    out.insert(0, "doc", doc)
    return out.astype({"parity": "Int32"})


def _chunk_batches(size: int, overlap: int, separators):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, span, cell, start, text, more, closed, sep, parity, entry in zip(*(c.to_pylist() for c in b.columns)):
                if entry is None:
                    continue
                c = Cell(text + more, len(text), separators[sep], parity, cell == 0, closed, size, overlap)
                later = tuple(separators[sep + 1 :])
                for at, end, long in c.walk(entry - start):
                    if end is None:  # a piece that other cells end
                        continue
                    spans: list = []
                    if long and later:
                        _split(c.text, at, end, later, size, overlap, spans)
                    else:
                        spans = [s for s in [_strip_span(c.text, at, end)] if s]
                    for k, (lo, hi) in enumerate(spans):
                        rows.append((doc, span, [start + at, k], start + lo, start + hi, c.text[lo:hi]))
            yield _batch(rows, _CHUNKS)

    return run


def _whole_batches(size: int, overlap: int, separators):
    """Long pieces put together: (doc, span, begin, sep, text) -> chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, span, begin, sep, text in zip(*(c.to_pylist() for c in b.columns)):
                spans: list = []
                later = tuple(separators[sep + 1 :])
                if later:
                    _split(text, 0, len(text), later, size, overlap, spans)
                else:
                    spans = [s for s in [_strip_span(text, 0, len(text))] if s]
                rows += [(doc, span, [begin, k], begin + lo, begin + hi, text[lo:hi]) for k, (lo, hi) in enumerate(spans)]
            yield _batch(rows, _CHUNKS)

    return run


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _cut(cell_chars: int):
    @F.arrow_udf("array<struct<cell:bigint,offset:bigint,text:string>>")
    def cut(texts: pa.Array, offsets: pa.Array) -> pa.Array:
        """A text that begins at ``offset`` of its document, cut where cells begin."""
        out = []
        for text, offset in zip(texts.to_pylist(), offsets.to_pylist()):
            row, at = [], 0
            while at < len(text or ""):
                cell = (offset + at) // cell_chars
                to = min(len(text), (cell + 1) * cell_chars - offset)
                row.append({"cell": cell, "offset": offset + at, "text": text[at:to]})
                at = to
            out.append(row)
        return pa.array(out, pa.list_(pa.struct([("cell", pa.int64()), ("offset", pa.int64()), ("text", pa.string())])))

    return cut


def cells_of(parts: DataFrame, cell_chars: int, ahead: int) -> DataFrame:
    """Parts (doc, span, offset, text, least) of documents -> cells (doc, span,
    cell, start, text, ahead, closed, least), with no document in one place.
    ``least``: the first separator that the document may be split at."""
    from docsift.session import materialize

    cut = parts.select("doc", "span", "least", F.explode(_cut(cell_chars)(F.col("text"), F.col("offset"))).alias("x"))
    joined = F.expr("listagg(x.text, '') WITHIN GROUP (ORDER BY x.offset)").alias("text")
    cells = materialize(cut.groupBy("doc", "span", "least", F.col("x.cell").alias("cell")).agg(joined), "cells")
    heads = cells.select("doc", "span", (F.col("cell") - 1).alias("cell"), F.substring("text", 1, ahead).alias("ahead"), F.length("text").alias("next"))
    rows = cells.join(heads, ["doc", "span", "cell"], "left")
    return rows.select(
        "doc", "span", "cell", (F.col("cell") * cell_chars).alias("start"), "text", F.coalesce("ahead", F.lit("")).alias("ahead"),
        F.coalesce(F.col("next") < ahead, F.lit(True)).alias("closed"), "least",
    )


def chunk_parts(
    parts: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS, cell_chars: int = CELL_CHARS,
    split_chars: int = SPLIT_DOC_CHARS,
) -> DataFrame:
    """Chunks (doc, at, start, end, chunk) of documents given as parts (doc,
    offset, text), ordered by ``at`` within a document."""
    from docsift.session import materialize

    separators = tuple(separators)
    ahead = ahead_chars(size, separators)
    if cell_chars < ahead:
        raise ValueError(f"a cell holds at least {ahead} characters")
    todo, done = parts.select("doc", F.lit("").alias("span"), "offset", "text", F.lit(0).alias("least")), []
    while True:
        cells = materialize(cells_of(todo, cell_chars, ahead), "cells-ahead")
        # The first separator from this level on that the document holds; the empty one always.
        seen = F.concat("text", F.substring("ahead", 1, max(map(len, separators)) - 1))
        which = F.coalesce(*[
            F.when((F.col("least") <= i) & (F.contains(seen, F.lit(s)) if s else F.lit(True)), i) for i, s in enumerate(separators)
        ], F.lit(len(separators) - 1))
        found = cells.groupBy("doc", "span").agg(F.min(which).alias("sep"))
        cells = materialize(cells.drop("least").join(found, ["doc", "span"]), "cells-sep")
        cols = ["doc", "span", "cell", "start", "text", "ahead", "closed", "sep"]
        tables = cells.select(*cols).mapInArrow(_summaries(size, overlap, separators, ahead), _SUMMARY)
        ends = cells.select("doc", "span", "cell", "start", (F.col("start") + F.length("text")).alias("end"))
        tables = tables.join(ends, ["doc", "span", "cell"])
        folded = materialize(tables.groupBy("doc", "span").applyInPandas(_folded, _FOLDED), "cells-folded")
        entered = folded.where("cell IS NOT NULL").select("doc", "span", "cell", "parity", "entry")
        walked = cells.join(entered, ["doc", "span", "cell"]).select(*cols, "parity", "entry")
        done.append(walked.mapInArrow(_chunk_batches(size, overlap, separators), _CHUNKS))

        # Long pieces that cross cells: parts of them, by the cells they lie in.
        crossing = folded.where("begin IS NOT NULL").select("doc", "span", "begin", "stop")
        if crossing.isEmpty():
            break
        where = F.explode(F.sequence(F.floor(F.col("begin") / cell_chars), F.floor((F.col("stop") - 1) / cell_chars)))
        pieces = crossing.withColumn("cell", where).join(cells.select("doc", "span", "cell", "start", "text", "sep"), ["doc", "span", "cell"])
        lo = F.greatest(F.col("begin") - F.col("start"), F.lit(0))
        body = F.substr("text", (lo + 1).cast("int"), (F.col("stop") - F.col("start") - lo).cast("int"))
        pieces = pieces.select("doc", "span", "begin", "stop", "sep", (F.col("start") + lo).alias("offset"), body.alias("text"))
        pieces = materialize(pieces, "crossing")
        huge = (F.col("stop") - F.col("begin") > split_chars) & (F.col("sep") + 1 < len(separators))
        whole = pieces.where(~huge).groupBy("doc", "span", "begin", "sep").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY offset)").alias("text"))
        done.append(whole.select("doc", "span", "begin", "sep", "text").mapInArrow(_whole_batches(size, overlap, separators), _CHUNKS))
        rest = pieces.where(huge)
        if rest.isEmpty():
            break
        todo = rest.select(
            "doc", F.concat("span", F.lit("/"), "begin").alias("span"), (F.col("offset") - F.col("begin")).alias("offset"), "text",
            (F.col("sep") + 1).alias("least"),
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # A nested document's positions count from the long piece it is.
    begins = F.transform(F.filter(F.split("span", "/"), lambda s: s != ""), lambda s: s.cast("bigint"))
    base = F.aggregate(begins, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select(
        "doc", F.concat(begins, "at").alias("at"), (base + F.col("start")).alias("start"), (base + F.col("end")).alias("end"), "chunk"
    )


def numbered(chunks: DataFrame) -> DataFrame:
    """(doc, at, start, end, chunk) -> (doc, chunk_no, start, end, chunk), by a
    distributed prefix sum over all chunks."""
    from docsift.operators import vectors as vec

    one = chunks.withColumn("_one", F.lit(1).cast("bigint"))
    placed = vec.document_offsets(one, ["doc", "at"], "_one", 0, carry=("start", "end", "chunk"))
    firsts = placed.groupBy("doc").agg(F.min("first_pos").alias("_first"))
    return placed.join(firsts, "doc").select("doc", (F.col("first_pos") - F.col("_first")).alias("chunk_no"), "start", "end", "chunk")


def chunk_pages(
    pages: DataFrame, doc_col: str, page_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    separators=SEPARATORS, cell_chars: int = CELL_CHARS, split_chars: int = SPLIT_DOC_CHARS,
) -> DataFrame:
    """S5 + F13: chunks of documents that come as page tables, as if the pages
    were joined in order, whatever the length: (doc, chunk_no, start, end,
    chunk). Where a page begins follows from a prefix sum of the lengths. A
    document of ``size`` characters or less is one chunk. NULL pages are empty;
    pages of one number are taken in the order of a hash of their texts."""
    from docsift.operators import vectors as vec

    text = F.coalesce(pages[text_col], F.lit(""))
    rows = pages.select(
        pages[doc_col].cast("string").alias("doc"), pages[page_col].alias("_page"), text.alias("text"),
        F.length(text).cast("bigint").alias("_n"), F.xxhash64(text).alias("_tie"),
    )
    placed = vec.document_offsets(rows, ["doc", "_page", "_tie"], "_n", 0, carry=("text",))
    starts = placed.groupBy("doc").agg(F.min("first_pos").alias("_first"), F.sum("_n").alias("all"))
    parts = placed.join(starts, "doc").select("doc", (F.col("first_pos") - F.col("_first")).alias("offset"), "text", "all")
    return _chunk_placed(parts, size, overlap, tuple(separators), cell_chars, split_chars)


def _chunk_placed(parts: DataFrame, size: int, overlap: int, separators: tuple, cell_chars: int, split_chars: int) -> DataFrame:
    """Parts (doc, offset, text, all: the document's length) -> numbered chunks."""
    short = parts.where(F.col("all") <= size).groupBy("doc").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY offset)").alias("text"))
    one = short.select("doc", F.lit("").alias("span"), F.lit(0).cast("bigint").alias("begin"), F.lit(len(separators) - 1).alias("sep"), "text")
    one = one.mapInArrow(_whole_batches(size, overlap, separators), _CHUNKS).drop("span")
    return numbered(chunk_parts(parts.where(F.col("all") > size), size, overlap, separators, cell_chars, split_chars).unionByName(one))


def chunk_texts(
    docs: DataFrame, doc_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS,
    cell_chars: int = CELL_CHARS, split_chars: int = SPLIT_DOC_CHARS,
) -> DataFrame:
    """F13 of huge texts: cut in cells by the task that reads them, chunked by
    as many tasks as there are cells."""
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = docs.select(
        docs[doc_col].cast("string").alias("doc"), F.lit(0).cast("bigint").alias("offset"), text.alias("text"), F.length(text).alias("all")
    )
    return _chunk_placed(parts, size, overlap, tuple(separators), cell_chars, split_chars)
