"""Answers that arrive after their question.

A question's retrieved documents and the model's answers are two streams. Both
have watermarks; they meet in a stream-stream left join with a time limit: an
answer counts from the question on until ``patience`` is over. A document whose
answer never comes leaves the join when the watermark passes its limit, with
the apology (F16). An answer that comes twice is taken once: the repeats are
dropped while the first is remembered, for as long as the join could still
match them. Answers to nothing asked, or after the limit, are dropped.

A question is answered when all its documents are settled. Until then its rows
wait in ``pending``: a batch reads what the batch before left, so a replayed
batch rewrites its own output and nothing else. What waits is bounded by the
questions that are open, and the join's state by the time limit.

Every batch opens and commits the state of every partition, five stores each,
however few rows it has: that, not the rows, is what many partitions cost. So the
state has a partition a core; their number is fixed by a checkpoint's first run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from docsift.operators import answers as ans

PATIENCE = "10 minutes"
LATENESS = "15 minutes"
PARTITIONS = "spark.sql.shuffle.partitions"


def settled(hits: DataFrame, responses: DataFrame, patience: str = PATIENCE, lateness: str = LATENESS) -> DataFrame:
    """hits (query_id, doc_id, rank, n_hits, file_path, asked_at) left-joined
    with responses (query_id, doc_id, response, answered_at), both streams:
    every hit once, with its answer or NULL. ``lateness``: how much older than
    the newest a row may be when it arrives."""
    asked = hits.withWatermark("asked_at", lateness)
    # Remembered as long as a repeat could still be within some question's limit.
    spans = f"{lateness} {patience}"
    came = responses.select(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d"), "response", "answered_at")
    came = came.withWatermark("answered_at", spans).dropDuplicatesWithinWatermark(["_q", "_d"])
    in_time = F.expr(f"answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {patience}")
    joined = asked.join(came, (F.col("query_id") == F.col("_q")) & (F.col("doc_id") == F.col("_d")) & in_time, "left")
    return joined.select("query_id", "doc_id", "rank", "n_hits", "file_path", "response")


def late_answer_stream(
    spark: SparkSession, hits: DataFrame, responses: DataFrame, out_root: str, checkpoint: str, patience: str = PATIENCE,
    lateness: str = LATENESS, state_partitions: int | None = None,
) -> str:
    """Answers every question whose documents are settled, once: ``answers``
    (query_id, answer) under ``out_root``, a folder per batch. Runs until the
    available input is consumed; called again with the same folders, it goes on
    with what has come since. Questions without hits are not part of ``hits``
    (their answer is known when they are asked). ``state_partitions`` counts in
    the first run (default: one a core, the session's shuffle partitions at most)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        def put(name: str, df: DataFrame) -> DataFrame:
            path = f"{out_root}/{name}/batch={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        rows = put("settled", batch)
        if batch_id > 0:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{out_root}/pending/batch={batch_id - 1}"))
        done = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_hits").alias("n_hits"))
        done = put("done", done.where("n >= n_hits").select("query_id"))
        put("pending", rows.join(done, "query_id", "left_anti"))
        complete = rows.join(done, "query_id", "left_semi").drop("n_hits")
        put("answers", ans.format_answers(ans.informative(complete), done))

    q = settled(hits, responses, patience, lateness).writeStream.foreachBatch(run)
    q = q.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    _start(q, hits.sparkSession, state_partitions).awaitTermination()
    return out_root


def _start(writer: DataStreamWriter, session: SparkSession, partitions: int | None) -> StreamingQuery:
    """Starts with so many state partitions. A stream takes a copy of its session's
    settings when it starts, so the session has its own back at once."""
    was = session.conf.get(PARTITIONS)
    session.conf.set(PARTITIONS, partitions or min(session.sparkContext.defaultParallelism, int(was)))
    try:
        return writer.start()
    finally:
        session.conf.set(PARTITIONS, was)
