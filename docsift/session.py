"""Session helpers: local sessions for tests/bench, checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "docsift", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. Cluster jobs use the session
    the cluster provides; nothing here is required for them."""
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DOCSIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    it is only invented (under /tmp) in a local session that has none, as in
    tests; elsewhere a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="docsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_PKG_DIR = os.path.dirname(os.path.abspath(__file__))


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers of a *local* session
    wherever the driver runs from: zip it once per SparkContext into the
    session's checkpoint directory and ``addPyFile`` it. On a cluster the
    package is installed on the executors or passed with ``--py-files``;
    nothing is written to a machine-local folder there."""
    sc = spark.sparkContext
    if getattr(sc, "_docsift_shipped", False) or not sc.master.startswith("local"):
        return
    import zipfile

    folder = ensure_checkpoint_dir(spark)
    local = folder[len("file:"):] if folder.startswith("file:") else folder
    if "://" in local:  # not a local path: leave shipping to the deployment
        return
    target = os.path.join(local, f"docsift-code-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(_PKG_DIR):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PKG_DIR)))
    sc.addPyFile(target)
    sc._docsift_shipped = True


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet (default: a fresh folder under the session's
    checkpoint directory) and read it back: cuts lineage, survives executor
    loss, and later readers get column pruning."""
    spark = df.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
