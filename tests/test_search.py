"""Exact search against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.config import EngineConfig
from docsift.operators import search


def _frames(spark, V, Q, docs=None):
    vrows = [(i, docs[i] if docs else f"d{i // 2}", V[i].tolist()) for i in range(len(V))]
    v = spark.createDataFrame(vrows, "pos long, doc_id string, embedding array<float>")
    q = spark.createDataFrame([(100 + j, Q[j].tolist()) for j in range(len(Q))], "query_id long, embedding array<float>")
    return v, q


def _brute(V, Q, k):
    V64 = V.astype(np.float32).astype(np.float64)
    Q64 = Q.astype(np.float32).astype(np.float64)
    out = {}
    for j, q in enumerate(Q64):
        d = ((V64 - q) ** 2).sum(axis=1)
        order = sorted(range(len(V)), key=lambda i: (d[i], i))[:k]
        out[100 + j] = [(r + 1, i) for r, i in enumerate(order)]
    return out


@pytest.mark.parametrize("block_bytes", [64 * 1024 * 1024, 2000])
def test_knn_matches_brute_force(spark, block_bytes):
    rng = np.random.default_rng(1)
    V = rng.normal(size=(700, 16)).astype(np.float32)
    Q = rng.normal(size=(40, 16)).astype(np.float32)
    v, q = _frames(spark, V, Q)
    cfg = EngineConfig(max_query_block_bytes=block_bytes)  # small bound forces several query blocks
    got = {}
    for r in search.knn(v, q, 5, cfg).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.pos))
    assert {k: sorted(x) for k, x in got.items()} == _brute(V, Q, 5)


def test_ties_broken_by_position(spark):
    V = np.array([[1, 0], [0, 1], [-1, 0], [0, -1], [2, 2]], dtype=np.float32)
    Q = np.array([[0, 0]], dtype=np.float32)
    v, q = _frames(spark, V, Q)
    got = [(r.rank, r.pos) for r in search.knn(v, q, 3).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2)]


def test_padding_when_k_exceeds_index(spark):
    V = np.eye(4, dtype=np.float32)
    Q = np.zeros((2, 4), dtype=np.float32)
    v, q = _frames(spark, V, Q)
    rows = search.knn(v, q, 6, pad=True).collect()
    assert len(rows) == 12
    assert sorted(r.pos for r in rows if r.query_id == 100) == [-1, -1, 0, 1, 2, 3]
    assert all(r.doc_id is None for r in rows if r.pos == -1)


def test_near_ties_resolved_exactly(spark):
    # distances differ below the expansion's rounding; exact rescoring decides
    base = np.full(8, 1000.0, dtype=np.float32)
    V = np.stack([base, base + np.float32(0.001), base - np.float32(0.001)]).astype(np.float32)
    Q = (base + np.float32(0.0009))[None, :]
    v, q = _frames(spark, V, Q)
    got = [r.pos for r in search.knn(v, q, 1).collect()]
    assert got == [b for _, b in _brute(V, Q, 1)[100]]


def test_null_vectors_are_skipped(spark):
    v = spark.createDataFrame(
        [(0, "a", [0.0, 0.0]), (1, "b", None), (2, "c", [1.0, 1.0])], "pos long, doc_id string, embedding array<float>"
    )
    q = spark.createDataFrame([(1, [0.1, 0.1]), (2, None)], "query_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.pos) for r in search.knn(v, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 0), (1, 2, 2)]


def test_many_queries_small_index_swaps_roles(spark):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(50, 16)).astype(np.float32)
    Q = rng.normal(size=(300, 16)).astype(np.float32)
    v, q = _frames(spark, V, Q)
    cfg = EngineConfig(max_query_block_bytes=12000)  # queries 38 kB > bound >= index estimate 9.6 kB
    got = {}
    for r in search.knn(v, q, 4, cfg).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.pos))
    assert {k: sorted(x) for k, x in got.items()} == _brute(V, Q, 4)


def test_two_large_sides_meet_on_the_executors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    V = rng.normal(size=(900, 8)).astype(np.float32)
    Q = rng.normal(size=(200, 8)).astype(np.float32)
    v, q = _frames(spark, V, Q)
    whole = search.knn(v, q, 6).collect()
    monkeypatch.setattr(search, "STRIPE_BLOCKS", 3)
    monkeypatch.setattr(type(q), "toArrow", None)  # nothing passes through the driver
    many = search.knn(v, q, 6, EngineConfig(max_query_block_bytes=2500)).collect()
    assert len(whole) == 1200 and sorted(many) == sorted(whole)


def test_partial_lists_are_merged_with_bounded_fan_in(spark):
    rng = np.random.default_rng(8)
    V = rng.normal(size=(600, 6)).astype(np.float32)
    Q = rng.normal(size=(9, 6)).astype(np.float32)
    v, q = _frames(spark, V, Q)
    v = v.repartition(40)
    one = sorted(search.knn(v, q, 4).collect())
    assert sorted(search.knn(v, q, 4, EngineConfig(top_k_fan_in=3)).collect()) == one
    partial = search._stream_vectors(search._vector_rows(q, F.col("query_id")), search._vector_rows(v, F.col("pos"), F.col("doc_id")), 4, 6)
    assert partial.groupBy("query_id").count().agg(F.max("count")).first()[0] > 100  # 40 tasks x 4
    merged = search.merge_top_k(partial, F.spark_partition_id(), 4, 3)
    assert merged.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 4


def test_search_runs_once_above_the_broadcast_bound(spark):
    """The vectors are scanned once, however many hits there are."""
    from docsift.operators import registry as reg
    from docsift.operators import retrieval

    rng = np.random.default_rng(9)
    v, q = _frames(spark, rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    scanned = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            scanned.add(b.num_rows)
            yield b

    counted = v.mapInArrow(count, v.schema)
    registry = v.select("doc_id").distinct().select(F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.lit("p").alias("file_path"), F.lit("processed").alias("status"))
    registry = spark.createDataFrame(registry.collect(), reg.REGISTRY_SCHEMA)
    small = retrieval.retrieve(counted, registry, q, 3, EngineConfig(max_broadcast_rows=1)).collect()
    assert scanned.value == 50
    assert sorted(small) == sorted(retrieval.retrieve(v, registry, q, 3).collect()) and len(small) > 40


def test_floats_stay_floats_on_the_way(spark):
    rng = np.random.default_rng(10)
    v, q = _frames(spark, rng.normal(size=(30, 4)).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32))
    met = search._blocks_by_stripes(search._vector_rows(q, F.col("query_id")), search._vector_rows(v, F.col("pos"), F.col("doc_id")), 2, 4, 50, 60)
    plan = met._jdf.queryExecution().toString()
    assert "array<double>" not in plan
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert met.rdd.getNumPartitions() <= most < 50 * 60


def _scan(V, Q, k, rows=500):
    """The kernel over batches, and the pairs it scored exactly."""
    import pyarrow as pa

    scored, offer = [], search._Best.offer

    def counted(self, qi, at, pos, vmat):
        scored.append(len(qi))
        offer(self, qi, at, pos, vmat)

    def batches():
        for at in range(0, len(V), rows):
            part = V[at : at + rows]
            ids = np.arange(at, at + len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([f"d{i}" for i in ids]), pa.array(part.tolist(), pa.list_(pa.from_numpy_dtype(V.dtype)))],
                names=["pos", "doc_id", "embedding"],
            )

    with pytest.MonkeyPatch.context() as m:
        m.setattr(search._Best, "offer", counted)
        out = list(search._partition_topk(100 + np.arange(len(Q)), Q, k, V.shape[1])(batches()))
    got = {}
    for r in (r for b in out for r in b.to_pylist()):
        got.setdefault(r["query_id"], []).append((len(got.get(r["query_id"], [])) + 1, r["pos"]))
        assert r["doc_id"] == f"d{r['pos']}"
    return got, sum(scored)


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e18])
def test_scan_is_exact_at_any_scale(scale):
    rng = np.random.default_rng(11)
    V = (rng.normal(size=(2000, 12)) * scale).astype(np.float32)
    Q = np.r_[V[:30], (rng.normal(size=(30, 12)) * scale).astype(np.float32)]
    assert _scan(V, Q, 4)[0] == _brute(V, Q, 4)


def test_few_pairs_are_scored_whatever_the_copies():
    """A query's k-th distance so far bounds the later tiles, and of equal
    vectors a batch scores k: not k of every slice, and not every copy."""
    rng = np.random.default_rng(12)
    V, Q = rng.normal(size=(6000, 8)).astype(np.float32), rng.normal(size=(200, 8)).astype(np.float32)
    got, scored = _scan(V, Q, 3)
    assert got == _brute(V, Q, 3) and scored < 200 * 60
    V[rng.random(6000) < 0.7] = Q[0]
    got, scored = _scan(V, Q, 3)
    assert got == _brute(V, Q, 3) and scored < 200 * 90


def test_a_big_search_is_dealt_out_evenly(spark):
    """Groups follow the distances to compute, and each has a task."""
    for n_q, n_v in ((100_000, 100_000), (800_000, 600_000), (5000, 6_000_000)):
        blocks, stripes = search._grid(n_q, n_v, 64, 3, EngineConfig(), 12)
        assert blocks * stripes >= 36 and n_q * n_v / (blocks * stripes) <= 1.5 * search.GROUP_CELLS
        assert n_q * 64 * 8 / blocks <= EngineConfig().max_query_block_bytes
    rng = np.random.default_rng(13)
    v, q = _frames(spark, rng.normal(size=(300, 4)).astype(np.float32), rng.normal(size=(300, 4)).astype(np.float32))
    met = search._blocks_by_stripes(search._vector_rows(q, F.col("query_id")), search._vector_rows(v, F.col("pos"), F.col("doc_id")), 2, 4, 4, 3)
    tasks = met.groupBy(F.spark_partition_id()).agg(F.countDistinct("query_id").alias("n")).collect()
    assert len(tasks) == 12 and sum(r.n for r in tasks) == 300 * 3
