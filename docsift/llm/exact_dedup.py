"""Exact dedup with a stateful stream.

Texts are equal when they are identical after deleting ASCII white space.

1. A Structured Streaming aggregation reads the files. Its state is keyed by
   the SHA-256 digest of the normalised text, lives in RocksDB on disk, has no
   watermark and so never expires. Per digest it retains the number of rows,
   the identifier of the row that stays (most code points in the original,
   then smallest id) and that row's content locator (file, row in the file).
   A later run with the same state folder only reads new files.
2. The state is read back as a table. Rows whose digest was hit more than
   once are compared in full with the bytes found at the locator.
3. Should bytes differ under one digest, the rows of that digest are grouped
   by the normalised text itself; otherwise the state's groups are the result.

The micro-batch aggregation combines before its shuffle, so a group that
holds a third of all rows loads no single task.

Edge cases: a null text counts as empty, and empty and blank texts form one
group; a null id loses to any other id of the same length; of repeated rows
exactly one is kept (the smallest locator); of a very long text the state holds
digest and locator only; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import materialize, scratch_path, text_or_empty
from docsift.operators.sizing import broadcast_if_small

#: State on disk; without preallocated files, of which every partition would have some.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Most digests whose group has several rows that are broadcast to find hits.
MAX_BROADCAST_DIGESTS = 500_000


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _texts(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty(docs[f"`{text_col}`"])
    rows = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"),
        normalise(text).alias("norm"),
        F.length(text).alias("chars"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return rows.withColumn("digest", digest(F.col("norm")))


def _stays() -> Column:
    """The row that stays is the smallest: longest, then id, then locator."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"))


def stream_state(
    spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Runs the stream over the files not yet seen; the state as a table
    (digest, n, keep)."""
    session = spark.newSession()  # the state store provider is a setting of the session
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in STATE_STORE.items():
        session.conf.set(name, value)
    table = session.read.parquet(path)
    reader = session.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # a stream takes a file by its folder only
        reader, path = reader.option("pathGlobFilter", name), folder
    source = reader.parquet(path)
    state = (
        _texts(source, id_col, text_col, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), _stays().alias("keep"))
    )
    run = (
        state.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", state_dir).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    kept = session.read.format("statestore").option("path", state_dir).load()
    n, keep = kept.schema["value"].dataType.names
    return kept.select("key.digest", F.col(f"value.`{n}`").alias("n"), F.col(f"value.`{keep}`").alias("keep"))


def exact_groups(
    spark: SparkSession, path: str, state_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, max_files_per_trigger: int = 1000,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, and
    the content locator (file, row) of the row that stays."""
    state_dir = state_dir or scratch_path(spark, "dedup-state")
    stored = stream_state(spark, path, state_dir, id_col, text_col, digest, max_files_per_trigger)
    folder = scratch_path(spark, "dedup-groups")
    stored.write.parquet(folder)
    state = spark.read.parquet(folder)  # in the caller's session
    texts = _texts(spark.read.parquet(path), id_col, text_col, digest)
    several = state.where("n > 1").select("digest", F.col("keep.file").alias("at_file"), F.col("keep.row").alias("at_row"))
    hits = texts.join(broadcast_if_small(several, MAX_BROADCAST_DIGESTS), "digest")
    hits = materialize(
        hits.select("digest", "norm", ((F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).alias("retained")),
        "dedup-hits",
    )
    retained = hits.where("retained").select("digest", F.col("norm").alias("content"))
    # Distinct only after the join is written: so a hot digest can be split in the join.
    collided = hits.join(retained, "digest").where(F.col("norm") != F.col("content")).select("digest")
    collided = materialize(collided, "dedup-collided").distinct()
    narrow = texts.select("doc_id", "chars", "file", "row", "digest")
    if collided.isEmpty():
        return _members(narrow.join(state, "digest"))
    collided = broadcast_if_small(collided)
    own = texts.join(collided, "digest", "left_semi")
    groups = own.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), _stays().alias("keep"))
    plain = narrow.join(collided, "digest", "left_anti").join(state, "digest")
    return _members(plain).unionByName(_members(own.join(groups, ["digest", "norm"])))


def _members(rows: DataFrame) -> DataFrame:
    here = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), here.alias("kept"), "digest",
        F.col("keep.file").alias("file"), F.col("keep.row").alias("row"),
    )
