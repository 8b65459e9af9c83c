"""Broadcast bounds: rows and bytes."""

from pyspark.sql import functions as F

from docsift.config import EngineConfig
from docsift.operators import sizing


def _is_broadcast(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_rows_and_bytes_are_both_bounded(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit(1)).alias("a"))
    assert _is_broadcast(sizing.broadcast_if_small(df))
    assert not _is_broadcast(sizing.broadcast_if_small(df, max_rows=99))
    assert not _is_broadcast(sizing.broadcast_if_small(df, cfg=EngineConfig(max_broadcast_bytes=100_000)))
    assert _is_broadcast(sizing.broadcast_if_small(df.select("id"), cfg=EngineConfig(max_broadcast_bytes=100_000)))
    assert _is_broadcast(sizing.broadcast_if_small(df.where("id < 0")))
