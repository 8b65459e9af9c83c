"""Persistent registry and vector tables (S7, S9, P7, P8; M8-M12).

Every ingest, delete and clear takes one **operation number** from the store
itself: the next one after all that were ever taken (``ops`` logs them, one
row each). All tables are parquet folders ``<table>/op=<number>``; a write
replaces exactly its own folder, also with no rows, and a reader at operation
N sees only numbers below N. A stream's batch id is only a key into the log:
a replayed batch finds its old number and overwrites its own output, however
many deletes or clears came in between.

  registry, vectors, rejected   rows written by ingests
  deletes(id)     a registry row is hidden when its id was deleted by a later
                  operation than the one that wrote it; vectors stay (orphans,
                  M8) and a later ingest registers the id again (M10)
  clears          rows of operations before the latest clear are hidden
                  (M11); positions restart at 0
  meta(first_pos, next_pos)  the positions of each ingest: the next one needs no
                  scan of the vectors, and a lookup opens only the operations
                  whose range holds a position asked for
  merges          ``merge`` rewrites the folders of past operations as one table
                  sorted by id (registry) and position (vectors) in files of
                  bounded size, each row with its operation number; readers take
                  it in place of those folders

One writer at a time. Folders live where the caller says: on a cluster, a
shared location (``spark.checkpoint.dir`` is the default for scratch stores).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.operators import registry as reg
from docsift.operators import sizing
from docsift.operators import vectors as vec

REJECTED_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType())])
DELETES_SCHEMA = T.StructType([T.StructField("id", T.StringType())])
CLEARS_SCHEMA = T.StructType([T.StructField("cleared", T.BooleanType())])
META_SCHEMA = T.StructType([T.StructField("first_pos", T.LongType()), T.StructField("next_pos", T.LongType())])
MERGES_SCHEMA = T.StructType([T.StructField("through", T.LongType())])
OPS_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("batch_id", T.LongType())])
#: What a merge rewrites: table, its schema, and the column its rows are sorted by.
MERGED = {
    "registry": (reg.REGISTRY_SCHEMA, "id"), "vectors": (vec.VECTOR_SCHEMA, "pos"), "meta": (META_SCHEMA, "next_pos"),
    "rejected": (REJECTED_SCHEMA, "path"), "ops": (OPS_SCHEMA, "batch_id"),
}
#: Tables of which a clear hides the rows before it.
CLEARED = ("registry", "vectors", "meta")
#: Rows of a merged file at most.
MERGED_FILE_ROWS = {"vectors": 200_000}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- raw partitioned tables ---------------------------------------------
    def _fs(self, path: str):
        """Hadoop FileSystem and Path of ``path`` (any scheme)."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _raw(self, name: str, schema: T.StructType) -> DataFrame:
        with_op = T.StructType([*schema.fields, T.StructField("op", T.LongType())])
        path = f"{self.root}/{name}"
        fs, p = self._fs(path)
        if not fs.exists(p):  # nothing written yet
            return self.spark.createDataFrame([], with_op)
        rows = self.spark.read.schema(with_op).parquet(path)
        merge, through = self._last_merge() if name in MERGED else (None, None)
        if merge is None:
            return rows
        merged = self.spark.read.schema(with_op).parquet(self._merged(name, merge))
        return rows.where(F.col("op") > through).unionByName(merged)

    def _merged(self, name: str, merge: int) -> str:
        return f"{self.root}/_merged/{name}/merge={merge}"

    def _last_merge(self) -> tuple[int | None, int | None]:
        """The latest merge and the last operation it covers."""
        path = f"{self.root}/merges"
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None, None
        with_op = T.StructType([*MERGES_SCHEMA.fields, T.StructField("op", T.LongType())])
        row = self.spark.read.schema(with_op).parquet(path).agg(F.max(F.struct("op", "through")).alias("m")).first()["m"]
        return int(row["op"]), int(row["through"])

    def write(self, name: str, df: DataFrame, op: int) -> None:
        """Replace the rows operation ``op`` wrote to ``name``."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/op={op}")

    # -- operation numbers ----------------------------------------------------
    def _log(self, kind: str, batch_id: int | None = None) -> int:
        last = self._raw("ops", OPS_SCHEMA).agg(F.max("op").alias("n")).first()["n"]
        op = 0 if last is None else int(last) + 1
        self.write("ops", self.spark.createDataFrame([(kind, batch_id)], OPS_SCHEMA).coalesce(1), op)
        return op

    def begin_ingest(self, batch_id: int | None = None) -> int:
        """Operation number of an ingest. A ``batch_id`` seen before gives
        the number it had then (a replay); None always gives a new one."""
        if batch_id is not None:
            seen = self._raw("ops", OPS_SCHEMA).where((F.col("kind") == "ingest") & (F.col("batch_id") == batch_id))
            row = seen.agg(F.max("op").alias("n")).first()
            if row["n"] is not None:
                return int(row["n"])
        return self._log("ingest", batch_id)

    def _last_clear(self, before: int | None) -> int:
        c = self._raw("clears", CLEARS_SCHEMA)
        if before is not None:
            c = c.where(F.col("op") < before)
        row = c.agg(F.max("op").alias("n")).first()
        return -1 if row["n"] is None else int(row["n"])

    def _visible(self, name: str, schema: T.StructType, before: int | None) -> DataFrame:
        df = self._raw(name, schema).where(F.col("op") > self._last_clear(before))
        return df if before is None else df.where(F.col("op") < before)

    # -- current state --------------------------------------------------------
    def registry(self, before: int | None = None) -> DataFrame:
        return self._undeleted(self._visible("registry", reg.REGISTRY_SCHEMA, before), before).drop("op")

    def _undeleted(self, rows: DataFrame, before: int | None) -> DataFrame:
        dels = self._visible("deletes", DELETES_SCHEMA, before)
        merge, through = self._last_merge()
        if merge is not None:  # deletes before it are done
            dels = dels.where(F.col("op") > through)
        dels = dels.groupBy(F.col("id").alias("_did")).agg(
            F.max("op").alias("_dop")
        )
        # hidden when deleted by a later operation than the one that wrote it
        cond = (rows["id"] == dels["_did"]) & (dels["_dop"] > rows["op"])
        return rows.join(dels, cond, "left_anti")

    def vectors(self, before: int | None = None) -> DataFrame:
        return self._visible("vectors", vec.VECTOR_SCHEMA, before).drop("op")

    def rejected(self) -> DataFrame:
        return self._raw("rejected", REJECTED_SCHEMA).drop("op")

    def next_position(self, before: int) -> int:
        """First free position after the visible operations before ``before``."""
        row = self._visible("meta", META_SCHEMA, before).agg(F.max("next_pos").alias("n")).first()
        return 0 if row["n"] is None else int(row["n"])

    def op_vectors(self, op: int) -> DataFrame:
        return self._raw("vectors", vec.VECTOR_SCHEMA).where(F.col("op") == op).drop("op")

    # -- mutations ------------------------------------------------------------
    def delete(self, ids: DataFrame, id_col: str = "id") -> int:
        """Hide registry rows of ``ids``; vectors are kept (M8)."""
        op = self._log("delete")
        self.write("deletes", ids.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()), op)
        return op

    def clear(self) -> int:
        """Empty registry and vectors (positions restart at 0)."""
        op = self._log("clear")
        self.write("clears", self.spark.createDataFrame([(True,)], CLEARS_SCHEMA).coalesce(1), op)
        return op

    def width(self, before: int | None = None) -> int | None:
        """Width of the stored vectors (one row read), None when empty."""
        row = self.vectors(before).select(F.size("embedding").alias("w")).first()
        return None if row is None else int(row["w"])

    def ensure_width(self, dim: int) -> bool:
        """A store holding vectors of another width is cleared (a
        chosen deviation: the reproduced system kept a stale mapping)."""
        w = self.width()
        if w is not None and w != dim:
            self.clear()
            return True
        return False

    def record_ingest(self, op: int, base: int) -> None:
        last = F.coalesce(F.max("pos") + 1, F.lit(base)).cast("bigint")
        stats = self.op_vectors(op).agg(F.lit(base).cast("bigint").alias("first_pos"), last.alias("next_pos"))
        self.write("meta", stats, op)

    # -- lookups and merging ----------------------------------------------------
    def lookup_positions(self, positions: DataFrame, pos_col: str = "pos", before: int | None = None) -> DataFrame:
        """Position -> document, NULL where there is none. ``meta`` is a zone
        map: its ranges name the operations that hold a position asked for (a
        range join with one row an operation), and only their folders are read;
        in the merged table the bounds of the positions prune row groups."""
        asked = positions.select(F.col(pos_col).cast("bigint").alias("_pos")).where(F.col("_pos").isNotNull())
        zones = self._visible("meta", META_SCHEMA, before).where("next_pos > first_pos")
        hit = sizing.broadcast_if_small(zones).join(asked, (F.col("_pos") >= F.col("first_pos")) & (F.col("_pos") < F.col("next_pos")))
        needed = hit.groupBy("op").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).collect()  # a row an operation
        rows = self._visible("vectors", vec.VECTOR_SCHEMA, before)
        if needed:
            lo, hi = min(r["lo"] for r in needed), max(r["hi"] for r in needed)
            rows = rows.where(F.col("op").isin([r["op"] for r in needed]) & F.col("pos").between(lo, hi))
        else:
            rows = rows.where(F.lit(False))
        return vec.position_lookup(positions, rows, pos_col)

    def merge(self, keep_last: int = 1) -> int | None:
        """Rewrites all operations but the last ``keep_last`` ingests (a stream
        may replay its last batch) as one sorted table, without the rows that a
        clear or a delete up to there has hidden. Returns its operation number;
        None when there is nothing to merge. Folders that the merge before it
        had already replaced are removed: a reader that began since keeps its
        files."""
        before_merge, before_through = self._last_merge()
        ops = self._raw("ops", OPS_SCHEMA)
        ingests = [r["op"] for r in ops.where("kind = 'ingest'").orderBy(F.desc("op")).limit(keep_last).collect()]
        last = ops.agg(F.max("op").alias("n")).first()["n"]
        if last is None:
            return None
        through = int(min(ingests)) - 1 if len(ingests) == keep_last and ingests else int(last) if keep_last == 0 else -1
        if through < 0 or through == before_through:
            return None
        op = self._log("merge")
        for name, (schema, key) in MERGED.items():
            past = self._visible(name, schema, through + 1) if name in CLEARED else self._raw(name, schema)
            rows = past.where(F.col("op") <= through)
            if name == "registry":
                rows = self._undeleted(rows, through + 1)
            rows = rows.repartitionByRange(key).sortWithinPartitions(key)
            out = rows.write.mode("overwrite").option("maxRecordsPerFile", MERGED_FILE_ROWS.get(name, 4_000_000))
            out.option(f"parquet.bloom.filter.enabled#{key}", str(name == "registry").lower()).parquet(self._merged(name, op))
        self.write("merges", self.spark.createDataFrame([(through,)], MERGES_SCHEMA).coalesce(1), op)
        if before_merge is not None:
            for name in MERGED:
                self._remove(self._merged(name, before_merge))
                self._remove_operations(name, before_through)
            self._remove_operations("deletes", before_through)
        return op

    def _remove_operations(self, name: str, through: int) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            number = folder.getPath().getName().removeprefix("op=")
            if number.isdigit() and int(number) <= through:
                fs.delete(folder.getPath(), True)

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # -- staging ----------------------------------------------------------------
    def staging(self, op: int) -> str:
        return f"{self.root}/_staging/op={op}"

    def drop_staging(self, op: int) -> None:
        """Remove the staged chunks of a finished ingest."""
        for path in (self.staging(op), f"{self.staging(op)}-features"):
            self._remove(path)
