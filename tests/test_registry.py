"""Registry semantics: create/read/delete (the reproduced tests' intent) and
the M-rules of the document registry."""

import pytest
from pyspark.sql import functions as F

from docsift.operators import registry as reg
from docsift.operators import retrieval
from docsift.operators import vectors as vec
from docsift.plans import ingest


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, list_order long, text string")


def test_create_list_exists_then_delete(spark):
    files = _files(spark, [("kb/test_path_1.txt", 0, "Doc one\nbody")])
    res = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), base=0)
    r = res.registry_rows.cache()
    listed = reg.list_documents(r).collect()
    assert len(listed) == 1 and listed[0].file_path == "kb/test_path_1.txt" and listed[0].title == "Doc one"
    ids = spark.createDataFrame([(listed[0].id,), ("unknown",)], "id string")
    flags = {row.id: row.processed for row in reg.exists(ids, r).collect()}
    assert flags == {listed[0].id: True, "unknown": False}
    after = reg.delete(r, ids.limit(1))
    assert reg.list_documents(after).count() == 0
    assert reg.exists(ids, after).where("processed").count() == 0


def test_first_file_wins_and_known_content_skipped(spark):
    files = _files(
        spark,
        [("kb/b.txt", 1, "same\ntext"), ("kb/a.txt", 0, "same\ntext"), ("kb/c.md", 2, "other")],
    )
    first = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), base=0)
    rows = {r.file_path: r for r in first.registry_rows.collect()}
    assert set(rows) == {"kb/a.txt", "kb/c.md"}  # M1-M3
    known = first.registry_rows
    again = ingest.ingest(files, known, first.vectors, base=100)
    assert again.registry_rows.count() == 0 and again.vectors.count() == 0  # J1


def test_empty_blank_unsupported_are_rejected(spark):
    files = _files(
        spark,
        [("kb/e.txt", 0, ""), ("kb/w.txt", 1, " \n\t "), ("kb/x.docx", 2, "text"), ("kb/ok.pdf", 3, "fine")],
    )
    res = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), base=0)
    reasons = {r.path: r.reason for r in res.rejected.collect()}
    assert reasons == {"kb/e.txt": "empty text", "kb/w.txt": "no chunks", "kb/x.docx": "Unsupported file type"}
    assert [r.file_path for r in res.registry_rows.collect()] == ["kb/ok.pdf"]


def test_positions_dense_in_listing_order(spark):
    long = ("word " * 200).strip()  # several chunks
    files = _files(spark, [("kb/2.txt", 2, "b\n" + long), ("kb/1.txt", 1, "a\n" + long), ("kb/3.txt", 3, "c")])
    res = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), base=7)
    v = res.vectors.join(res.registry_rows.select(F.col("id").alias("doc_id"), "file_path"), "doc_id")
    rows = sorted((r.pos, r.file_path) for r in v.collect())
    assert [p for p, _ in rows] == list(range(7, 7 + len(rows)))  # M5, W2
    paths = [f for _, f in rows]
    assert paths == sorted(paths, key=lambda p: int(p[3]))  # document order, then chunk order


def test_orphans_keep_slots_after_delete(spark):
    # two documents, vectors at positions 0,1 (doc A) and 2 (doc B); query near A
    registry = spark.createDataFrame([("A", "ta", "pa", "processed"), ("B", "tb", "pb", "processed")], reg.REGISTRY_SCHEMA)
    vectors = spark.createDataFrame(
        [(0, "A", [0.0, 0.0]), (1, "A", [0.1, 0.0]), (2, "B", [1.0, 1.0])], vec.VECTOR_SCHEMA
    )
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    full = retrieval.retrieve(vectors, registry, queries, k=2).collect()
    assert [(r.id, r.rank) for r in full] == [("A", 1)]  # A twice in top-2: one document
    after = reg.delete(registry, spark.createDataFrame([("A",)], "id string"))
    assert retrieval.retrieve(vectors, after, queries, k=2).count() == 0  # M9: fewer than k


def test_width_check_rejects_whole_document(spark):
    v = spark.createDataFrame(
        [(0, "A", [1.0, 2.0]), (1, "A", [1.0]), (2, "B", [3.0, 4.0])], vec.VECTOR_SCHEMA
    )
    kept, bad = vec.check_width(v, 2)
    assert sorted(r.pos for r in kept.collect()) == [2]
    assert [r.doc_id for r in bad.collect()] == ["A"]


def test_document_offsets_distributed_prefix(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, f"d{i}", rnd.randint(1, 9)) for i in rnd.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "o long, d string, n long").repartition(5)
    got = {r.d: r.first_pos for r in vec.document_offsets(df, ["o"], "n", 10, carry=("d",)).collect()}
    acc, want = 10, {}
    for o, d, n in sorted(rows):
        want[d] = acc
        acc += n
    assert got == want


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_document_offsets_are_dense_beyond_the_range_sample(spark, reuse):
    """More rows than a range partitioning samples, and a carried column, so
    that the two branches differ; the result is written before it is checked."""
    import tempfile

    from pyspark.sql import Window

    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(400_000).selectExpr("xxhash64(id) as o", "concat('d', id) as d", "1L as n")
        path = tempfile.mkdtemp(prefix="docsift-offsets-")
        vec.document_offsets(df, ["o"], "n", 0, carry=("d",)).write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    got = spark.read.parquet(path)
    want = df.select("d", (F.row_number().over(Window.orderBy("o")) - 1).alias("at"))
    assert got.select("first_pos").distinct().count() == 400_000
    assert got.join(want, "d").where("first_pos <> at").isEmpty()


def test_checked_featurizer_path_rejects_bad_width(spark):
    """A featurizer without a declared fixed width goes through the checked
    path: documents with a wrong-width vector get no positions and no row."""
    def fz(text):
        # width 3, except 2 for chunks containing 'bad'
        return F.when(text.contains("bad"), F.array(F.lit(1.0), F.lit(2.0))).otherwise(
            F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
        )

    files = _files(spark, [("kb/1.txt", 1, "good one"), ("kb/2.txt", 2, "bad one"), ("kb/3.txt", 3, "good two")])
    cfg = __import__("docsift.config", fromlist=["EngineConfig"]).EngineConfig(dim=3)
    res = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), cfg, featurizer=fz, base=0)
    assert sorted(r.file_path for r in res.registry_rows.collect()) == ["kb/1.txt", "kb/3.txt"]
    assert sorted(r.pos for r in res.vectors.collect()) == [0, 1]
    assert [r.path for r in res.rejected.collect()] == ["kb/2.txt"]


def test_null_vector_fails_its_document(spark):
    v = spark.createDataFrame([(0, "A", None), (1, "A", [1.0, 2.0]), (2, "B", [3.0, 4.0])], vec.VECTOR_SCHEMA)
    kept, bad = vec.check_width(v, 2)
    assert sorted(r.pos for r in kept.collect()) == [2]
    assert [r.doc_id for r in bad.collect()] == ["A"]


def test_ingest_split_path_equals_default(spark):
    """Huge-document path (cells across tasks), forced by a low threshold,
    gives the same registry, positions and chunks as the default path."""
    from docsift.config import EngineConfig
    from docsift.plans import fixtures

    files = fixtures.files(spark, "/root/testdata/sf0.001")
    a = ingest.ingest(files, None, vec.empty_vectors(spark), EngineConfig(dim=32), base=0)
    b = ingest.ingest(files, None, vec.empty_vectors(spark), EngineConfig(dim=32, split_doc_chars=500), base=0)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(a.registry_rows) == key(b.registry_rows)
    assert key(a.vectors.select("pos", "doc_id")) == key(b.vectors.select("pos", "doc_id"))
    assert key(a.chunks) == key(b.chunks)
