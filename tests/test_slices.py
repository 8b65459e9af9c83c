"""Chunking by cells equals chunking of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from docsift.config import SEPARATORS
from docsift.functions import chunking, slices

SIZE, OVERLAP = 20, 6
AHEAD = slices.ahead_chars(SIZE, SEPARATORS)


def texts(seed, n=60):
    """Texts whose separators crowd, run on, are missing, and cross the cells."""
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(["ab \n", "abcdefgh ", "a\n\n\n", "abc", " \n", "abcdefghijklmnop\n ", "ab\n\n xyzxyzxyz"])
        blocks = [rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 5, 30]) for _ in range(rng.randrange(1, 200))]
        yield "".join(blocks)


def by_cells(text, cell_chars, split_chars, size=SIZE, overlap=OVERLAP, seps=SEPARATORS, least=0):
    """The steps of ``slices`` in one process: (order, start, end)."""
    ahead = slices.ahead_chars(size, seps)
    sep_no = next(i for i, s in enumerate(seps) if i >= least and (not s or s in text))
    sep = seps[sep_no]
    cut = [text[i : i + cell_chars] for i in range(0, len(text), cell_chars)]
    cells, rows = [], []
    for i, own in enumerate(cut):
        more = cut[i + 1][:ahead] if i + 1 < len(cut) else ""
        closed = i + 1 >= len(cut) or len(cut[i + 1]) < ahead
        start, tables, made = i * cell_chars, {}, {}
        for parity in range(max(1, len(sep))):
            c = slices.Cell(own + more, len(own), sep, parity, i == 0, closed, size, overlap)
            exits = c.exits()
            known = [k for k in range(len(exits)) if k == 0 or c.edges[k] < ahead]
            tables[parity] = (
                slices.out_parity(own, len(own), sep, parity), start + c.edges[0] if exits else None,
                {start + c.edges[k]: start + exits[k] if exits[k] >= 0 else exits[k] - start for k in known},
            )
            made[parity] = c
        cells.append((i, start, start + len(own), tables))
        rows.append((start, made))
    later = tuple(seps[sep_no + 1 :])
    for cell, parity, entry, begin, stop in slices.fold(cells):
        if begin is not None:
            piece = text[begin:stop]
            if len(piece) > split_chars and later:
                for order, lo, hi in by_cells(piece, cell_chars, split_chars, size, overlap, seps, sep_no + 1):
                    yield (begin, *order), begin + lo, begin + hi
            else:
                spans = []
                if later:
                    chunking._split(piece, 0, len(piece), later, size, overlap, spans)
                else:
                    spans = [s for s in [chunking._strip_span(piece, 0, len(piece))] if s]
                for k, (lo, hi) in enumerate(spans):
                    yield (begin, k), begin + lo, begin + hi
        elif entry is not None:
            start, made = rows[cell]
            for at, end, long in made[parity].walk(entry - start):
                if end is None:
                    continue
                spans = []
                if long and later:
                    chunking._split(made[parity].text, at, end, later, size, overlap, spans)
                else:
                    spans = [s for s in [chunking._strip_span(made[parity].text, at, end)] if s]
                for k, (lo, hi) in enumerate(spans):
                    yield (start + at, k), start + lo, start + hi


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cell_chars", [AHEAD, AHEAD + 7, 150])
def test_cells_give_the_chunks_of_the_whole_text(seed, cell_chars):
    for text in texts(seed):
        if len(text) <= SIZE:
            continue
        for split_chars in (60, 10**6):
            got = [(lo, hi) for _, lo, hi in sorted(by_cells(text, cell_chars, split_chars))]
            assert got == chunking.chunk_spans(text, SIZE, OVERLAP), (text, split_chars)


def _plain(docs, size=SIZE, overlap=OVERLAP):
    out = []
    for doc, text in docs.items():
        out += [(doc, n, lo, hi, text[lo:hi]) for n, (lo, hi) in enumerate(chunking.chunk_spans(text, size, overlap))]
    return sorted(out)


def test_pages_are_chunked_across_their_borders(spark):
    rng = random.Random(11)
    docs = {f"d{i}": t for i, t in enumerate(texts(3, 40))} | {"one": "short", "blank": " \n ", "é": "é\n\n" * 90, "none": ""}
    pages = []
    for doc, text in docs.items():
        at = n = 0
        while at < len(text) or n == 0:
            to = at + rng.choice([0, 1, 2, 40, 300])
            pages.append((doc, n, text[at:to] or None))
            at, n = to, n + 1
    rng.shuffle(pages)
    df = spark.createDataFrame(pages, "doc string, page int, text string").repartition(5)
    got = slices.chunk_pages(df, "doc", "page", "text", SIZE, OVERLAP, cell_chars=AHEAD + 11, split_chars=70)
    assert sorted(tuple(r) for r in got.collect()) == _plain(docs)
    assert slices.chunk_pages(df.where("false"), "doc", "page", "text").count() == 0


def test_a_huge_text_is_chunked_by_many_tasks(spark):
    """Ten million characters of short lines, without an empty one: the cells
    of one run are walked by several tasks."""
    text = "".join(f"line {i} " + "x" * (i * 7 % 50) + "\n" for i in range(250_000))
    df = spark.createDataFrame([(1, text), (2, "tiny")], "id int, text string")
    cells = slices.cells_of(
        df.select(F.col("id").alias("doc"), F.lit("").alias("span"), F.lit(0).cast("bigint").alias("offset"), "text", F.lit(0).alias("least")),
        slices.CELL_CHARS, slices.ahead_chars(300, SEPARATORS),
    )
    assert cells.where("doc = 1").count() == -(-len(text) // slices.CELL_CHARS) > 9
    got = slices.chunk_texts(df, "id", "text").where("doc = '1'").select("chunk_no", "start", "end").collect()
    assert sorted(tuple(r) for r in got) == [(n, lo, hi) for n, (lo, hi) in enumerate(chunking.chunk_spans(text))]
