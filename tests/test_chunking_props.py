"""Property checks of the chunking rule on random texts and parameters:
span chunker == plain statement of the rule == the SQL restatement."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.config import SEPARATORS
from docsift.functions import slices
from docsift.functions.chunking import chunk_spans
from docsift.plans.oracle_chunks import chunk_ctes

from .test_chunking import plain_split
from .test_slices import by_cells

ALPHABET = st.sampled_from(["a", "b", "é", " ", " ", "\n", "\n", "\t", "　", "x"])
TEXTS = st.lists(ALPHABET, min_size=0, max_size=400).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(4, 40), st.integers(0, 20))
def test_span_chunker_equals_plain_rule(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = chunk_spans(text, size, overlap)
    assert [text[a:b] for a, b in spans] == plain_split(text, size=size, overlap=overlap)
    assert all(b - a <= size for a, b in spans)


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=8), st.integers(4, 40), st.integers(0, 20))
def test_sql_chunker_equals_span_chunker(texts, size, overlap):
    overlap = min(overlap, size - 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(doc_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(f"d{i}", x) for i, x in enumerate(texts)])
    sql = "WITH RECURSIVE " + chunk_ctes("SELECT doc_id, text FROM t", size, overlap)
    rows = con.sql(sql + "\nSELECT doc_id, chunk_no, start, chunk FROM sql_chunks").fetchall()
    got = sorted((d, int(n), int(s), c) for d, n, s, c in rows)
    want = sorted(
        (f"d{i}", n, a, x[a:b]) for i, x in enumerate(texts) for n, (a, b) in enumerate(chunk_spans(x, size, overlap))
    )
    assert got == want


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(4, 40), st.integers(0, 20), st.integers(0, 60))
def test_cells_compose_to_the_whole(text, size, overlap, more):
    """Chunking cell by cell (the path of huge documents) gives the same chunks
    as chunking the whole text."""
    overlap = min(overlap, size - 1)
    if len(text) <= size:
        return
    cell_chars = slices.ahead_chars(size, SEPARATORS) + more
    got = [(lo, hi) for _, lo, hi in sorted(by_cells(text, cell_chars, 3 * size, size, overlap))]
    assert got == chunk_spans(text, size, overlap)
