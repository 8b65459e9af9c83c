"""span chunker vs a plain list-of-strings statement of the rule."""

import duckdb
from pyspark.sql import functions as F
import pytest

from docsift.functions.chunking import chunk_spans

from .conftest import SF001, SF01


def plain_split(text, separators=("\n\n", "\n", " ", ""), size=300, overlap=50):
    """The rule written directly over strings (no offsets)."""
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep, rest = s, list(separators[i + 1:])
            break
    if sep:
        parts = text.split(sep)
        pieces = [parts[0]] + [sep + p for p in parts[1:]]
    else:
        pieces = list(text)
    pieces = [p for p in pieces if p != ""]
    out, good = [], []
    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out.extend(plain_merge(good, size, overlap))
            good = []
        if not rest:
            out.append(p)
        else:
            out.extend(plain_split(p, tuple(rest), size, overlap))
    if good:
        out.extend(plain_merge(good, size, overlap))
    return [c for c in (x.strip() for x in out) if c]


def plain_merge(pieces, size, overlap):
    docs, cur, total = [], [], 0
    for p in pieces:
        n = len(p)
        if total + n > size:
            if cur:
                doc = "".join(cur).strip()
                if doc:
                    docs.append(doc)
                while total > overlap or (total + n > size and total > 0):
                    total -= len(cur[0])
                    cur = cur[1:]
        cur.append(p)
        total += n
    doc = "".join(cur).strip()
    if doc:
        docs.append(doc)
    return docs


EDGE = [
    ("a\n\n\nb", 1),
    ("x" * 1000, 4),
    ("a " * 400, 4),
    (("w" * 320 + " ") * 3, 6),
    ("\n \n", 0),
    ("a" * 300, 1),
    ("a" * 299 + " b" * 40 + "\n\n" + "c d " * 100, 4),
    (" lead\n\n\n\ntail ", 1),
]


@pytest.mark.parametrize("text,count", EDGE)
def test_edge_strings(text, count):
    spans = chunk_spans(text)
    assert len(spans) == count
    assert [text[a:b] for a, b in spans] == plain_split(text)


def _texts(sf):
    return [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' order by doc_id").fetchall()]


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_fixture_documents_match_plain_rule(sf):
    for text in _texts(sf):
        spans = chunk_spans(text)
        chunks = [text[a:b] for a, b in spans]
        assert chunks == plain_split(text)
        # invariants: size bound, contiguous spans in increasing order
        assert all(len(c) <= 300 for c in chunks)
        starts = [a for a, _ in spans]
        assert starts == sorted(starts) and len(set(starts)) == len(starts)
        # every non-whitespace character is covered by some chunk
        covered = set()
        for a, b in spans:
            covered.update(range(a, b))
        assert all(ch.isspace() or i in covered for i, ch in enumerate(text))


def test_unicode_and_no_separator_levels():
    text = "é" * 310 + "😀" * 5 + " " + "ß" * 20
    assert [text[a:b] for a, b in chunk_spans(text)] == plain_split(text)


def test_spark_chunks_equal_python(spark):
    from docsift.plans import catalog

    df = catalog.chunks(spark, SF001)
    got = {(r.doc_id, r.chunk_no): (r.start, r.chunk) for r in df.collect()}
    docs = duckdb.sql(f"select md5(text) id, text from '{SF001}/documents.parquet'").fetchall()
    expected = {}
    for i, text in docs:
        for n, (a, b) in enumerate(chunk_spans(text)):
            expected[(i, n)] = (a, text[a:b])
    assert got == expected


def test_split_path_equals_whole_path(spark):
    """Long documents chunked cell by cell across tasks give the same rows
    as chunking each document whole (threshold lowered to force it)."""
    from docsift.functions import chunking

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("d"), "text")
    whole = chunking.explode_chunks(docs.withColumn("_c", chunking.chunk_array("text")), "_c", ["d"])
    split = chunking.chunk_rows(docs, "text", ["d"], split_chars=500, cell_chars=700)
    assert sorted(tuple(r) for r in split.collect()) == sorted(tuple(r) for r in whole.collect())
