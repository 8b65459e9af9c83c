"""Property checks: distributed positions and exact search."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.operators import search
from docsift.operators import vectors as vec


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=300), st.integers(1, 7), st.integers(0, 1000))
def test_document_offsets_equal_sequential_prefix(spark, counts, parts, base):
    rows = [(i * 7 % 1009, f"d{i}", n) for i, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "o long, d string, n long").repartition(parts)
    got = {r.d: r.first_pos for r in vec.document_offsets(df, ["o", "d"], "n", base, carry=()).collect()}
    acc, want = base, {}
    for o, d, n in sorted(rows):
        want[d] = acc
        acc += n
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 60), st.integers(1, 25), st.integers(1, 9), st.integers(1, 8), st.booleans())
def test_knn_equals_brute_force(spark, n_vec, n_q, dim, k, dupes):
    rng = np.random.default_rng(n_vec * 1000 + n_q * 10 + dim)
    V = rng.integers(-3, 4, size=(n_vec, dim)).astype(np.float32)  # small ints: many exact ties
    if dupes:
        V[::2] = V[0]
    Q = rng.integers(-3, 4, size=(n_q, dim)).astype(np.float32)
    v = spark.createDataFrame([(i, f"x{i}", V[i].tolist()) for i in range(n_vec)], "pos long, doc_id string, embedding array<float>")
    q = spark.createDataFrame([(j, Q[j].tolist()) for j in range(n_q)], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.pos) for r in search.knn(v, q, k).collect())
    want = []
    for j in range(n_q):
        d = ((V.astype(np.float64) - Q[j]) ** 2).sum(axis=1)
        order = sorted(range(n_vec), key=lambda i: (d[i], i))[:k]
        want += [(j, r + 1, i) for r, i in enumerate(order)]
    assert got == sorted(want)
