"""Persistent store: delete keeps vectors (M8), orphans take top-k slots
(M9), re-ingest after delete appends again (M10), clear (M11), width change
(M12), replay safety (M13)."""

import os
import tempfile

from pyspark.sql import functions as F

from docsift.config import EngineConfig
from docsift.operators import registry as reg
from docsift.operators import retrieval
from docsift.operators import vectors as vec
from docsift.sources.store import Store
from docsift.streaming.jobs import ingest_batch

CFG = EngineConfig(dim=16)


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, list_order long, text string")


def _store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="docsift-store-"))


DOCS = [
    ("kb/a.txt", 0, "Alpha title\n" + "alpha words " * 60),
    ("kb/b.txt", 1, "Beta title\n" + "beta words " * 60),
]


def test_delete_keeps_vectors_and_reingest_appends_again(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    reg0 = {r.file_path: r.id for r in st.registry().collect()}
    n0 = st.vectors().count()
    a_id = reg0["kb/a.txt"]
    st.delete(spark.createDataFrame([(a_id,)], "id string"))
    assert sorted(r.file_path for r in st.registry().collect()) == ["kb/b.txt"]
    assert st.vectors().count() == n0  # M8: orphans stay
    # M9: a query equal to one of A's vectors now returns no A document
    qv = st.vectors().where(F.col("doc_id") == a_id).select(F.lit(1).cast("bigint").alias("query_id"), "embedding").limit(1)
    hits = retrieval.retrieve(st.vectors(), st.registry(), qv, k=2, cfg=CFG).collect()
    assert all(h.id != a_id for h in hits)
    # Ingesting A again appends its vectors again under the same id
    ingest_batch(st, _files(spark, DOCS[:1]), 2, CFG)
    assert sorted(r.file_path for r in st.registry().collect()) == ["kb/a.txt", "kb/b.txt"]
    a_vecs = st.vectors().where(F.col("doc_id") == a_id).count()
    assert st.vectors().count() == n0 + a_vecs // 2
    pos = sorted(r.pos for r in st.vectors().collect())
    assert pos == list(range(len(pos)))


def test_clear_empties_everything_and_restarts_positions(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    st.clear()
    assert st.registry().count() == 0 and st.vectors().count() == 0  # M11
    ingest_batch(st, _files(spark, DOCS[1:]), 2, CFG)
    assert [r.file_path for r in st.registry().collect()] == ["kb/b.txt"]
    assert min(r.pos for r in st.vectors().collect()) == 0


def test_width_change_clears(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS[:1]), 0, CFG)
    ingest_batch(st, _files(spark, DOCS[1:]), 1, EngineConfig(dim=8))  # M12
    assert [r.file_path for r in st.registry().collect()] == ["kb/b.txt"]
    assert {r.w for r in st.vectors().select(F.size("embedding").alias("w")).collect()} == {8}


def test_replay_of_a_batch_is_idempotent(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS[:1]), 0, CFG)
    ingest_batch(st, _files(spark, DOCS[1:]), 1, CFG)
    snap = (sorted(tuple(r) for r in st.registry().collect()), sorted(r.pos for r in st.vectors().collect()))
    ingest_batch(st, _files(spark, DOCS[1:]), 1, CFG)  # crash after writing, batch re-run
    assert (sorted(tuple(r) for r in st.registry().collect()), sorted(r.pos for r in st.vectors().collect())) == snap


def _ids(st):
    return {r.file_path: r.id for r in st.registry().collect()}


def _frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_delete_then_ingest_in_the_next_batch_brings_the_document_back(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    a_id = _ids(st)["kb/a.txt"]
    st.delete(_frame(spark, a_id))  # right after the batch that wrote it
    assert set(_ids(st)) == {"kb/b.txt"}
    ingest_batch(st, _files(spark, DOCS), 1, CFG)  # consecutive batch id, as a stream gives
    assert set(_ids(st)) == {"kb/a.txt", "kb/b.txt"}


def test_two_deletes_both_hold(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    ids = _ids(st)
    st.delete(_frame(spark, ids["kb/a.txt"]))
    st.delete(_frame(spark, ids["kb/b.txt"], None, "unknown"))
    assert _ids(st) == {}


def test_replay_after_a_delete_does_not_revive_the_document(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    n = st.vectors().count()
    st.delete(_frame(spark, _ids(st)["kb/a.txt"]))
    ingest_batch(st, _files(spark, DOCS), 0, CFG)  # replay of batch 0
    assert set(_ids(st)) == {"kb/b.txt"} and st.vectors().count() == n


def test_an_empty_replay_replaces_what_the_batch_wrote(spark):
    st = _store(spark)
    ingest_batch(st, _files(spark, DOCS), 0, CFG)
    ingest_batch(st, _files(spark, DOCS).where("false"), 0, CFG)
    assert _ids(st) == {} and st.vectors().count() == 0


def test_staging_is_removed_after_the_ingest(spark):
    import os

    st = _store(spark)
    op = ingest_batch(st, _files(spark, DOCS), 0, CFG)
    assert not os.path.exists(st.staging(op)) and set(_ids(st)) == {"kb/a.txt", "kb/b.txt"}


def _plain(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


def _opened(df):
    """Files that hold rows of the frame."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_merge_bounds_the_files_and_keeps_every_row(spark):
    """Many operations become a few files; rows, replays, deletes and clears stay as they were."""
    st = _store(spark)
    for i in range(24):
        docs = spark.createDataFrame([(f"d{i}", f"T{i}", f"kb/{i}.txt", "processed")], reg.REGISTRY_SCHEMA).coalesce(1)
        op = st._log("ingest", i)
        st.write("vectors", spark.createDataFrame([(3 * i + j, f"d{i}", [float(i), float(j)]) for j in range(3)], vec.VECTOR_SCHEMA).coalesce(1), op)
        st.record_ingest(op, 3 * i)
        st.write("registry", docs, op)
    gone = st.delete(spark.createDataFrame([("d5",), ("d23",)], "id string"))
    before = _plain(st.registry()), _plain(st.vectors())
    assert len(st.registry().inputFiles()) >= 24
    op = st.merge()
    assert op == gone + 1 and (_plain(st.registry()), _plain(st.vectors())) == before
    # the last ingest may be replayed, so it is not merged: its own folder and the merged files
    cores = spark.sparkContext.defaultParallelism
    past = Store(spark, st.root)._merged("registry", op)
    assert len(spark.read.parquet(past).inputFiles()) <= cores
    assert len(_opened(spark.read.parquet(past).where("id = 'd17'"))) == 1  # sorted: an id is in one file
    assert st.begin_ingest(3) == 3 and st.begin_ingest(23) == 23  # old batch ids are still known
    st.write("registry", docs, 23)  # a replay of the last ingest overwrites its own rows
    assert _plain(st.registry()) == before[0]
    assert st.next_position(before=op + 1) == 72
    assert st.merge() is None  # nothing new
    again = _files(spark, DOCS[:1])
    ingest_batch(st, again, 24, EngineConfig(dim=2))
    assert min(r.pos for r in st.vectors().where("length(doc_id) > 3").collect()) == 72
    rows = _plain(st.registry()), _plain(st.vectors())
    assert st.merge() > op and (_plain(st.registry()), _plain(st.vectors())) == rows
    left = [f for f in os.listdir(f"{st.root}/registry") if f.startswith("op=")]
    assert len(left) <= 3  # folders that the first merge replaced are gone
    st.clear()
    assert st.registry().count() == 0 and st.vectors().count() == 0
    ingest_batch(st, again, 25, EngineConfig(dim=2))
    st.merge(keep_last=0)
    assert [r.file_path for r in st.registry().collect()] == ["kb/a.txt"] and min(r.pos for r in st.vectors().collect()) == 0


def test_position_lookup_opens_the_operations_it_needs(spark):
    st = _store(spark)
    for i in range(5):
        op = st._log("ingest", i)
        rows = [(10 * i + j, f"d{i}", [float(j)]) for j in range(10)]
        st.write("vectors", spark.createDataFrame(rows, vec.VECTOR_SCHEMA).coalesce(1), op)
        st.record_ingest(op, 10 * i)
    asked = spark.createDataFrame([(12,), (17,), (17,), (31,), (99,), (None,)], "pos long")
    expected = [(12, "d1"), (17, "d1"), (17, "d1"), (31, "d3"), (99, None), (None, None)]
    found = st.lookup_positions(asked)
    assert _plain(found) == sorted(expected, key=repr)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "op#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "IN (1,3)" in plan or "(op#" in plan
    st.merge()
    assert _plain(st.lookup_positions(asked)) == sorted(expected, key=repr)
    none = spark.createDataFrame([(99,)], "pos long")
    assert _plain(st.lookup_positions(none)) == [(99, None)]
