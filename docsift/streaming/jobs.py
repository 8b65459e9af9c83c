"""Streaming jobs.

T1 ``ingest_stream``: a file stream feeds ``foreachBatch``; each micro-batch
runs the batch ingest job against the tables written by *earlier* operations
and appends its output under its own operation number:

  * the stream checkpoint skips files already seen, the anti-join skips
    content already registered: both are needed;
  * a replayed batch finds its operation number again, overwrites exactly
    what it wrote and reads only earlier operations, so a replay never
    appends twice;
  * vectors are written first, registry rows last and only for documents
    whose vectors are on disk, so a crash between the two leaves no
    registered document without vectors.

T2 ``answer_stream``: arriving questions are routed and answered; retrieval
uses the index as it was when the stream started, metadata is live.

Folders default to subfolders of the session's checkpoint directory, the
shared location a cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.config import DEFAULT, NO_RELEVANT_ANSWER, EngineConfig
from docsift.functions import features as fx
from docsift.operators import answers as ans
from docsift.operators import retrieval
from docsift.plans import fixtures as fxt
from docsift.plans import ingest
from docsift.plans.catalog import nonzero_entries, retrieve_questions
from docsift.session import ensure_checkpoint_dir, materialize
from docsift.sources import files as src
from docsift.sources.store import Store
from docsift.streaming.late import late_answer_stream


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ingest_batch(
    store: Store, files: DataFrame, batch_id: int | None = None, cfg: EngineConfig = DEFAULT, featurizer=None
) -> int:
    """One micro-batch of T1 (without ``batch_id``: a plain batch run, never
    a replay): vectors first, then the next free position, registry rows last
    and only for documents whose vectors are on disk. Returns the operation
    number."""
    store.ensure_width(cfg.dim)
    op = store.begin_ingest(batch_id)
    base = store.next_position(before=op)
    res = ingest.ingest(
        files, store.registry(before=op), store.vectors(before=op), cfg, featurizer, base=base,
        staging_path=store.staging(op),
    )
    store.write("vectors", res.vectors, op)
    store.record_ingest(op, base)
    ids = store.op_vectors(op).select(F.col("doc_id").alias("id")).distinct()
    store.write("registry", res.registry_rows.join(ids, "id", "left_semi"), op)
    store.write("rejected", res.rejected, op)
    store.drop_staging(op)
    return op


def ingest_stream(
    spark: SparkSession,
    source: DataFrame,
    store_root: str,
    checkpoint: str,
    to_files,
    cfg: EngineConfig = DEFAULT,
    featurizer=None,
):
    """``source`` is a streaming frame; ``to_files`` maps a micro-batch to
    (path, list_order, text). Runs until the available input is consumed."""
    store = Store(spark, store_root)

    def run(batch_df: DataFrame, batch_id: int) -> None:
        ingest_batch(store, to_files(batch_df), batch_id, cfg, featurizer)

    q = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return store


BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def folder_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """File stream of a folder of documents (binaryFile source, direct
    children only); each micro-batch takes at most ``max_files_per_trigger``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(folder)
    )


def ingest_folder(
    spark: SparkSession, folder: str, store_root: str, checkpoint: str, cfg: EngineConfig = DEFAULT, featurizer=None,
    md_to_html=None,
) -> Store:
    """T1 over a folder, re-runnable: the file stream takes what is new since
    the last run. Files that Spark's file sources never list (empty ones, dot
    and underscore names) follow in a batch of their own, so each file of the
    folder is ingested or rejected; the anti-join drops those known already."""
    to_files = lambda raw: ingest.files_from_folder_batch(raw, md_to_html)
    store = ingest_stream(spark, folder_stream(spark, folder), store_root, checkpoint, to_files, cfg, featurizer)
    left = src.read_folder(spark, folder, skipped_only=True)
    if not left.isEmpty():
        ingest_batch(store, to_files(left), cfg=cfg, featurizer=featurizer)
    return store


def answer_stream(
    spark: SparkSession,
    questions: DataFrame,
    vectors: DataFrame,
    registry,
    out_root: str,
    checkpoint: str,
    embed,
    respond,
    converse,
    files: DataFrame | None = None,
    cfg: EngineConfig = DEFAULT,
    keywords=None,
    dim: int | None = None,
):
    """Every arriving question (query_id, text) is routed and answered.

    ``embed`` maps a question frame to (query_id, embedding). The index is
    the ``vectors`` frame given at start (its file listing is fixed then);
    ``registry`` may be a callable, re-read for every micro-batch, so
    metadata is live (M17). The chat model enters as two frames per batch:
    ``respond(hits)`` -> (query_id, doc_id, response) for the retrieved
    documents (query_id, doc_id, rank, file_path) and ``converse(questions)``
    -> (query_id, response) for the others; a NULL or missing response is a
    failed call. A question id that a batch holds several times is answered
    once in it (with the smallest text, should they differ).

    Each step is written once under ``out_root/<table>/batch=<id>`` (a replay
    replaces it) and read back by the next: ``routes``, ``retrieved``,
    ``prompts`` (with ``files``, the current texts by path), ``answers`` and,
    when the batch asks for it, ``listing`` (line_no, line): the reply that
    'list' answers of this batch name."""

    def run(batch_df: DataFrame, batch_id: int) -> None:
        def put(name: str, df: DataFrame) -> DataFrame:
            path = f"{out_root}/{name}/batch={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        current = registry() if callable(registry) else registry
        # text travels with the route: later steps do not read the source again
        asked = batch_df.groupBy("query_id").agg(F.min("text").alias("text"))
        routed = put("routes", asked.withColumn("route", ans.route_of("text", cfg, keywords=keywords)))
        routes = routed.select("query_id", "route")
        wanted = routed.where(F.col("route") == "retrieve").select("query_id", "text")
        hits = put("retrieved", retrieval.retrieve(vectors, current, embed(wanted), cfg.retrieve_k, cfg, dim=dim))
        if files is not None:
            put("prompts", ans.build_prompts(hits, wanted, files, cfg))
        keyed = hits.select("query_id", F.col("id").alias("doc_id"), "rank", "file_path")
        formatted = ans.format_answers(ans.keep_informative(keyed, respond(keyed)), wanted)
        talk = routed.where(F.col("route") == "converse").select("query_id", "text")
        put("answers", ans.answer(routes, formatted, converse(talk)))
        if not routes.where(F.col("route") == "list").isEmpty():
            put("listing", ans.title_message_lines(current))

    q = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return out_root


# -- registered queries -------------------------------------------------------

def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over the documents table: the final registry (equals the batch
    ingest's registry, so the registry SQL is its oracle)."""
    root = _scratch(spark, "stream-ingest")
    store = ingest_stream(
        spark, fxt.table_stream(spark, sf_dir, "documents"), f"{root}/store", f"{root}/checkpoint", fxt.files_of
    )
    return store.registry()


def _answered(spark: SparkSession, sf_dir: str) -> str:
    """The question stream over user turns; its output folder. The index and the
    registry are written once, not worked out anew for every batch."""
    root = _scratch(spark, "stream-answers")
    width = fxt.embedding_width(spark, sf_dir)
    index = materialize(fxt.vectors(spark, sf_dir), "index")
    registry = materialize(fxt.registry(spark, sf_dir), "registry")
    return answer_stream(
        spark,
        fxt.questions_of(fxt.table_stream(spark, sf_dir, "conversations")).select("query_id", "text"),
        index,
        lambda: registry,
        f"{root}/out",
        f"{root}/checkpoint",
        embed=lambda df: materialize(fx.featurize(df, "text", width).select("query_id", "embedding"), "question-vectors"),
        respond=lambda hits: fxt.responses(spark, sf_dir, hits),
        converse=lambda _questions: fxt.converse_responses(spark, sf_dir),
        keywords=fxt.FIXTURE_KEYWORDS,
        dim=width,
    )


def stream_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + F12: the routes written by the stream."""
    return spark.read.parquet(f"{_answered(spark, sf_dir)}/routes").select("query_id", "route")


def stream_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + C2: the documents the stream retrieved."""
    return spark.read.parquet(f"{_answered(spark, sf_dir)}/retrieved").drop("batch")


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + C5: the answers the stream wrote."""
    return spark.read.parquet(f"{_answered(spark, sf_dir)}/answers").drop("batch")


#: Rounds of ten minutes in which the fixture questions are asked.
ANSWER_ROUNDS = 2


def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + F16 + T2 with late answers: hits and answers come in rounds of ten
    minutes, two rounds a batch. Answers arrive in the round of their question or
    the next ones, a third of them twice; of the failed calls a half report NULL, a quarter never
    come and a quarter come after the limit. The answers of all questions
    equal those of ``format_answers``."""
    root = _scratch(spark, "late-answers")
    hits = materialize(retrieve_questions(spark, sf_dir), "retrieved")
    keyed = hits.select("query_id", F.col("id").alias("doc_id"), "rank", "file_path")
    answered = materialize(keyed.join(fxt.responses(spark, sf_dir, keyed), ["query_id", "doc_id"]), "responses")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    key = F.pmod(F.xxhash64("query_id"), F.lit(600 * ANSWER_ROUNDS))
    asked_at = F.timestamp_add("SECOND", key.cast("int"), start)
    per_query = keyed.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_hits"))
    asked = materialize(
        keyed.join(per_query, "query_id").withColumns({"asked_at": asked_at, "round": (key / 600).cast("int")}), "asked"
    )
    kind = F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(12))
    delay = F.pmod(F.xxhash64("doc_id", "query_id"), F.lit(540)).cast("int")
    late = F.col("response").isNull() & (kind % 4 == 1)  # 20 minutes: after the limit
    came = answered.withColumns({
        "answered_at": F.timestamp_add("SECOND", delay + F.when(late, 1200).otherwise(0), asked_at),
        "copies": F.when(F.col("response").isNull() & (kind % 4 == 0), F.array().cast("array<int>"))
        .when(kind % 3 == 0, F.array(F.lit(0), F.lit(1))).when(kind % 3 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0))),
    })
    came = came.withColumn("response", F.when(late, F.lit("too late")).otherwise(F.col("response")))
    seconds = F.unix_timestamp("answered_at") - F.unix_timestamp(start)
    came = came.select("query_id", "doc_id", "response", "answered_at", F.explode("copies").alias("again"))
    came = materialize(came.withColumn("round", (seconds / 600 + F.col("again")).cast("int")).drop("again"), "came")
    last = ANSWER_ROUNDS + 4
    folders = {"hits": asked, "responses": came}
    schemas = {name: df.drop("round").schema for name, df in folders.items()}
    end = spark.range(2).select((F.lit(-1) - F.col("id")).alias("query_id"), F.timestamp_add("DAY", F.lit(30), start).alias("at"))
    ticks = {
        "hits": end.selectExpr("query_id", "'' AS doc_id", "1L AS rank", "1 AS n_hits", "'' AS file_path", "at AS asked_at"),
        "responses": end.selectExpr("query_id", "'none' AS doc_id", "'' AS response", "at AS answered_at"),
    }
    for turn in range(0, last + 3, 2):  # two rounds a turn; the last two turns only move the clock
        for name, df in folders.items():
            new = df.where(F.col("round").between(turn, turn + 1)).drop("round") if turn < last else ticks[name]
            new.select(schemas[name].names).write.mode("append").parquet(f"{root}/{name}")
        read = lambda name: spark.readStream.schema(schemas[name]).parquet(f"{root}/{name}")
        late_answer_stream(spark, read("hits"), read("responses"), f"{root}/out", f"{root}/checkpoint")
    given = spark.read.parquet(f"{root}/out/answers").select("query_id", "answer").where("query_id >= 0")
    no_hits = fxt.questions(spark, sf_dir).select("query_id").join(per_query, "query_id", "left_anti")
    return given.unionByName(no_hits.withColumn("answer", F.lit(NO_RELEVANT_ANSWER)))


def _loaded_store(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """A store after: even files, two deletes (list order by 5, then by 7)."""
    store = Store(spark, f"{_scratch(spark, 'store')}/store")
    files = fxt.files(spark, sf_dir)
    ingest_batch(store, files.where(F.col("list_order") % 2 == 0), 0)
    for every in (5, 7):
        store.delete(files.where(F.col("list_order") % every == 0).select(F.md5("text").alias("id")))
    return store, files


def _documents_of(store: Store, step: str) -> DataFrame:
    per_doc = store.vectors().groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).cast("bigint").alias("n_vectors"))
    rows = store.registry().join(per_doc, "id").select(F.lit(step).alias("step"), "file_path", "id", "n_vectors")
    return materialize(rows, "store-state")


def store_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, P7, P8, U1, M8-M11 on the persisted tables: ingest, two deletes,
    all files in the next batch, clear, ingest. Registered documents and their
    stored vectors after each step (after the clear: one row with the number of
    rows left in both tables)."""
    store, files = _loaded_store(spark, sf_dir)
    states = [_documents_of(store, "after deletes")]
    ingest_batch(store, files, 1)
    states.append(_documents_of(store, "after second load"))
    store.clear()
    left = store.registry().select("id").unionByName(store.vectors().select(F.col("doc_id").alias("id")))
    none = F.lit(None).cast("string")
    states.append(
        materialize(
            left.agg(F.count(F.lit(1)).cast("bigint").alias("n_vectors")).select(
                F.lit("after clear").alias("step"), none.alias("file_path"), none.alias("id"), "n_vectors"
            ),
            "store-state",
        )
    )
    ingest_batch(store, files.where(F.col("list_order") % 2 == 1), 2)
    states.append(_documents_of(store, "after third load"))
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + U1: stored vectors read back after two ingests with deletes between
    them, as non-zero entries (pos, doc_id, bucket, weight)."""
    store, files = _loaded_store(spark, sf_dir)
    ingest_batch(store, files, 1)
    return nonzero_entries(store.vectors(), "pos", "doc_id")


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + S9 on the stored vectors: positions (also some past the end) looked
    up among the operations, then again after the past ones were merged."""
    store, files = _loaded_store(spark, sf_dir)
    ingest_batch(store, files, 1)
    asked = fxt.table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 7).alias("pos"))
    found = []
    for step in ("operations", "merged"):
        if step == "merged":
            store.merge()
        found.append(materialize(store.lookup_positions(asked).select(F.lit(step).alias("step"), "pos", "doc_id"), "positions"))
    return found[0].unionByName(found[1])


def registry_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored registry and vectors before and after a
    clear."""
    store = Store(spark, f"{_scratch(spark, 'store')}/store")
    ingest_batch(store, fxt.files(spark, sf_dir))
    sizes = []
    for step in ("before", "after"):
        if step == "after":
            store.clear()
        for tbl, df in (("registry", store.registry()), ("vectors", store.vectors())):
            n = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
            sizes.append(n.select(F.lit(step).alias("step"), F.lit(tbl).alias("tbl"), "n_rows"))
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_routing": stream_routing,
    "stream_retrieved": stream_retrieved,
    "stream_answers": stream_answers,
    "late_answers": late_answers,
    "store_lifecycle": store_lifecycle,
    "store_vectors": store_vectors,
    "stored_positions": stored_positions,
    "registry_clear": registry_clear,
}
