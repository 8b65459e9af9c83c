"""Streams end in the same tables as the batch jobs; replay is safe."""

import os
import tempfile

import duckdb
from pyspark.sql import functions as F

from docsift.config import APOLOGY
from docsift.operators import registry as reg
from docsift.operators import vectors as vec
from docsift.plans import catalog, fixtures, ingest
from docsift.streaming import jobs, late

from .conftest import SF001


def _split_documents(spark, n_files=4):
    """The documents table cut by doc_id range into files of one folder, so
    the file stream delivers them in listing order over several batches."""
    d = tempfile.mkdtemp(prefix="docsift-stream-src-")
    rows = duckdb.sql(f"select * from '{SF001}/documents.parquet' order by doc_id").fetchall()
    step = (len(rows) + n_files - 1) // n_files
    for i in range(n_files):
        duckdb.sql(
            f"copy (select * from '{SF001}/documents.parquet' where doc_id >= {i * step} and doc_id < {(i + 1) * step}) "
            f"to '{d}/part-{i:03d}.parquet' (format parquet)"
        )
    return d


def _key(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_ingest_equals_batch_over_several_batches(spark):
    src = _split_documents(spark)
    schema = fixtures.table(spark, SF001, "documents").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = tempfile.mkdtemp(prefix="docsift-stream-")
    store = jobs.ingest_stream(spark, stream, f"{root}/store", f"{root}/ckpt", fixtures.files_of)
    ops = {r.op for r in spark.read.parquet(f"{root}/store/registry").select("op").distinct().collect()}
    assert len(ops) >= 2
    batch = ingest.ingest(fixtures.files(spark, SF001), reg.empty_registry(spark), vec.empty_vectors(spark), base=0)
    assert _key(store.registry()) == _key(batch.registry_rows)
    # positions: dense 0..n-1 over all batches, no duplicates
    pos = sorted(r.pos for r in store.vectors().select("pos").collect())
    assert pos == list(range(len(pos)))
    assert len(pos) == batch.vectors.count()


def test_replayed_batch_does_not_append_twice(spark):
    root = tempfile.mkdtemp(prefix="docsift-replay-")
    store = jobs.Store(spark, f"{root}/store")
    files = fixtures.files(spark, SF001)
    first, second = files.where(F.col("list_order") < 100), files.where(F.col("list_order") >= 100)
    jobs.ingest_batch(store, first, 0)
    jobs.ingest_batch(store, second, 1)
    before = (_key(store.registry()), store.vectors().count())
    jobs.ingest_batch(store, second, 1)  # replay of batch 1 after a crash
    assert (_key(store.registry()), store.vectors().count()) == before


def test_stream_routing_equals_batch(spark):
    got = _key(jobs.stream_routing(spark, SF001))
    assert got == _key(catalog.route_queries(spark, SF001))


def test_stream_writes_answers_listing_and_prompts(spark):
    """Two micro-batches of questions; the listing only where it is asked for."""
    src = tempfile.mkdtemp(prefix="docsift-questions-")
    root = tempfile.mkdtemp(prefix="docsift-answers-")
    schema = "query_id long, text string"
    vectors = spark.createDataFrame([(0, "d", [1.0, 0.0])], "pos long, doc_id string, embedding array<float>")
    registry = spark.createDataFrame([("d", "Title d", "kb/d.txt", "processed")], reg.REGISTRY_SCHEMA)
    files = spark.createDataFrame([("kb/d.txt", "Text of d")], "path string, text string")
    for i, rows in enumerate([[(1, "the one"), (2, "hello")], [(3, "list documents"), (4, "the other")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/b{i}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    )
    out = jobs.answer_stream(
        spark, stream, vectors, lambda: registry, f"{root}/out", f"{root}/ckpt",
        embed=lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")),
        respond=lambda h: h.select("query_id", "doc_id", F.lit("Found it.").alias("response")),
        converse=lambda q: q.select("query_id", F.lit(None).cast("string").alias("response")),
        files=files, keywords=("the",), dim=2,
    )
    got = {r.query_id: r for r in spark.read.parquet(f"{out}/answers").collect()}
    assert {q: r.route for q, r in got.items()} == {1: "retrieve", 2: "converse", 3: "list", 4: "retrieve"}
    assert "Found it." in got[1].answer and "kb/d.txt" in got[4].answer
    assert got[2].answer == APOLOGY and got[2].listing is None
    assert got[3].answer is None and got[3].listing == "titles"
    listing = spark.read.parquet(f"{out}/listing").collect()
    assert len({r.batch for r in listing}) == 1
    assert [r.line for r in sorted(listing, key=lambda r: r.line_no)][1:] == ["Title d"]
    assert all("Text of d" in r.prompt for r in spark.read.parquet(f"{out}/prompts").collect())


def test_cli_delete_and_clear(spark, capsys):
    from docsift.__main__ import main
    from docsift.sources.store import Store

    root = tempfile.mkdtemp(prefix="docsift-cli-del-")
    store = Store(spark, root)
    docs = [("kb/a.txt", 0, "Alpha\nbody"), ("kb/b.txt", 1, "Beta\nbody")]
    jobs.ingest_batch(store, spark.createDataFrame(docs, "path string, list_order long, text string"))
    ids = {r.title: r.id for r in store.registry().collect()}
    main(["delete", root, ids["Alpha"]])
    main(["list", root])
    assert capsys.readouterr().out.split("\t")[1] == "Beta"
    main(["clear", root])
    assert store.registry().count() == 0 and store.vectors().count() == 0


def test_folder_stream_skips_seen_files_and_seen_content(spark):
    """T1 over a real folder: the checkpoint skips files already read, the
    anti-join skips content already registered (a copy under a new name)."""
    src = tempfile.mkdtemp(prefix="docsift-folder-")
    root = tempfile.mkdtemp(prefix="docsift-fstore-")

    def put(name, text):
        with open(os.path.join(src, name), "w", encoding="utf-8") as f:
            f.write(text)

    def run():
        wrap = lambda c: F.concat(F.lit("<p>"), c, F.lit("</p>"))
        return jobs.ingest_folder(spark, src, f"{root}/store", f"{root}/ckpt", md_to_html=wrap)

    put("one.txt", "First doc\n" + "alpha " * 80)
    put("empty.txt", "")
    put("_list.txt", "Under doc")
    put("two.md", "Second doc\n\nbody text here")
    store = run()
    listed = lambda: sorted(r.file_path.rsplit("/", 1)[-1] for r in store.registry().collect())
    assert listed() == ["_list.txt", "one.txt", "two.md"]
    assert {r.path.rsplit("/", 1)[-1]: r.reason for r in store.rejected().collect()} == {"empty.txt": "empty text"}
    n_vec = store.vectors().count()
    put("copy.txt", "First doc\n" + "alpha " * 80)  # same content, new file
    put("three.txt", "Third doc\nshort")
    put(".dot.txt", "Dot doc")
    store = run()
    assert listed() == [".dot.txt", "_list.txt", "one.txt", "three.txt", "two.md"]
    pos = sorted(r.pos for r in store.vectors().collect())
    assert pos == list(range(len(pos))) and len(pos) == n_vec + 2


def test_repeated_questions_are_answered_once_a_batch(spark):
    root = tempfile.mkdtemp(prefix="docsift-repeat-")
    schema = "query_id long, text string"
    vectors = spark.createDataFrame([(i, f"d{i}", [1.0, float(i)]) for i in range(4)], "pos long, doc_id string, embedding array<float>")
    registry = spark.createDataFrame([(f"d{i}", f"T{i}", f"kb/{i}.txt", "processed") for i in range(4)], reg.REGISTRY_SCHEMA)
    asked = [(1, "the one"), (1, "the one"), (1, "the one"), (2, "hello"), (2, "hello"), (3, "the third")]
    spark.createDataFrame(asked, schema).repartition(3).write.parquet(f"{root}/in")
    out = jobs.answer_stream(
        spark, spark.readStream.schema(schema).parquet(f"{root}/in"), vectors, lambda: registry, f"{root}/out", f"{root}/ckpt",
        embed=lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")),
        respond=lambda h: h.select("query_id", "doc_id", F.lit("Yes.").alias("response")),
        converse=lambda q: q.select("query_id", F.lit("Hi.").alias("response")), keywords=("the",), dim=2,
    )
    routes = spark.read.parquet(f"{out}/routes").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in routes} == {1: 1, 2: 1, 3: 1}
    hits = sorted((r.query_id, r["rank"], r.id) for r in spark.read.parquet(f"{out}/retrieved").collect())
    assert hits == [(q, i + 1, f"d{i}") for q in (1, 3) for i in range(3)]
    assert sorted(r.query_id for r in spark.read.parquet(f"{out}/answers").collect()) == [1, 2, 3]


def test_late_answers_settle_once(spark):
    """An answer in time, in a later batch, twice, after the limit, failed and
    never: one reply per question, when its last document is settled."""
    root = tempfile.mkdtemp(prefix="docsift-late-")
    hit = "query_id long, doc_id string, rank long, n_hits int, file_path string, asked_at string"
    reply = "query_id long, doc_id string, response string, answered_at string"
    at = lambda minute: f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00"

    def feed(hits, replies):
        for name, schema, rows, when in (("hits", hit, hits, "asked_at"), ("replies", reply, replies, "answered_at")):
            df = spark.createDataFrame(rows, schema)
            df.withColumn(when, F.col(when).cast("timestamp")).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(spark.read.parquet(f"{root}/{n}").schema).parquet(f"{root}/{n}") for n in ("hits", "replies")]
        late.late_answer_stream(spark, *streams, f"{root}/out", f"{root}/ckpt", "10 minutes", "1 minute")
        return {r.query_id: r.answer for r in spark.read.parquet(f"{root}/out/answers").collect()}

    got = feed(
        [(1, "a", 1, 2, "fa", at(0)), (1, "b", 2, 2, "fb", at(0)), (2, "a", 1, 1, "fa", at(1)), (3, "a", 1, 1, "fa", at(1)),
         (4, "c", 1, 1, "fc", at(1)), (5, "a", 1, 1, "fa", at(1))],
        [(1, "a", "A1", at(2)), (5, "a", None, at(2)), (9, "z", "nobody asked", at(2))],
    )
    assert set(got) == {5} and APOLOGY in got[5]  # 1 waits for b
    got = feed([(6, "a", 1, 1, "fa", at(4))], [(1, "a", "A1", at(3)), (1, "b", "B1", at(4)), (2, "a", "A2", at(4))])
    assert set(got) == {1, 2, 5} and got[1].index("A1") < got[1].index("B1") and got[1].count("A1") == 1
    got = feed([(7, "a", 1, 1, "fa", at(30))], [(3, "a", "too late", at(30)), (6, "a", "A6", at(12))])
    got = feed([(8, "a", 1, 1, "fa", at(31))], [(8, "a", "A8", at(31))])
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}  # 7 is still open
    assert APOLOGY in got[3] and APOLOGY in got[4] and "A6" in got[6]
    answers = spark.read.parquet(f"{root}/out/answers")
    assert answers.count() == answers.select("query_id").distinct().count() == 7
    waiting = spark.read.parquet(f"{root}/out/pending").where("batch = 0")
    assert {r.query_id for r in waiting.collect()} == {1}


def test_late_answers_state_is_dealt_by_cores(spark):
    """Each state partition costs every batch the same, rows or not: one a core,
    however many shuffle partitions the session has; those are left as they were."""
    hits = spark.createDataFrame([(i, "d", 1, 1, "f") for i in range(40)], "query_id long, doc_id string, rank long, n_hits int, file_path string")
    hits = hits.withColumn("asked_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    replies = hits.select("query_id", "doc_id", F.lit("Yes.").alias("response"), F.col("asked_at").alias("answered_at"))
    cores, was = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")

    def run(root, **given):
        for name, df in (("hits", hits), ("replies", replies)):
            df.write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(df.schema).parquet(f"{root}/{n}") for n, df in (("hits", hits), ("replies", replies))]
        late.late_answer_stream(spark, *streams, f"{root}/out", f"{root}/ckpt", **given)
        ids = [r.query_id for r in spark.read.parquet(f"{root}/out/answers").collect()]
        return sorted(ids), len([p for p in os.listdir(f"{root}/ckpt/state/0") if p.isdigit()])

    many = str(3 * cores)
    spark.conf.set("spark.sql.shuffle.partitions", many)
    try:
        assert run(tempfile.mkdtemp(prefix="docsift-cores-")) == (list(range(40)), cores)
        root = tempfile.mkdtemp(prefix="docsift-given-")
        assert run(root, state_partitions=2) == (list(range(40)), 2)
        assert run(root)[1] == 2  # as the first run had them
        assert spark.conf.get("spark.sql.shuffle.partitions") == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_cli_ingest_and_ask(spark, capsys):
    from docsift.__main__ import main

    src = tempfile.mkdtemp(prefix="docsift-cli-")
    with open(os.path.join(src, "keys.txt"), "w", encoding="utf-8") as f:
        f.write("Golden keys\nThe little golden key opened the lock.\n")
    with open(os.path.join(src, "rain.txt"), "w", encoding="utf-8") as f:
        f.write("Weather\nRain and wind all week.\n")
    store = tempfile.mkdtemp(prefix="docsift-cli-store-")
    main(["ingest", src, store])
    main(["ask", store, "List Documents", "explain the golden key in the lock"])
    out = capsys.readouterr().out
    assert "Here are the available documents:" in out
    assert "[retrieve] explain the golden key in the lock" in out
    assert "1. Golden keys" in out


def test_cli_list_on_empty_store(spark, capsys):
    from docsift.__main__ import main

    store = tempfile.mkdtemp(prefix="docsift-cli-empty-")
    main(["ask", store, "  SHOW DOCUMENTS  ", "what is this"])
    out = capsys.readouterr().out
    assert "[list]   SHOW DOCUMENTS  " in out and "No documents found in the database." in out
    assert "[converse] what is this" in out


def test_streams_read_tables_that_are_folders(spark):
    """A table may be a folder of part files; its stream reads all of them."""
    root = tempfile.mkdtemp(prefix="docsift-folders-")
    for name in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"{SF001}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    n = spark.read.parquet(f"{SF001}/conversations.parquet").where("role = 'user'").count()
    assert jobs.stream_routing(spark, root).count() == jobs.stream_answers(spark, root).count() == n
    # of equal texts the first to arrive is registered: the same ids, whatever the order of the files
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(jobs.stream_ingest(spark, root)) == ids(catalog.ingest_end_to_end(spark, SF001))
