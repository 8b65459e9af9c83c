"""Checked broadcasts: a side is broadcast only after its rows and bytes are
known to be within a bound; otherwise the join stays a shuffle join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.config import DEFAULT, EngineConfig


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row: 8 a number, and what strings and nested values take."""
    fixed, varying = 8, []
    for field in df.schema.fields:
        c = df[f"`{field.name}`"]
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            varying.append(F.octet_length(c))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            varying.append(F.octet_length(F.to_json(F.struct(c))))
        fixed += 8
    return sum((F.coalesce(c, F.lit(0)).cast("bigint") for c in varying), F.lit(fixed).cast("bigint"))


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows and
    ``max_broadcast_bytes`` bytes (one aggregate, which prunes the columns of
    fixed width), else ``df`` unchanged."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    bound = cfg.max_broadcast_rows if max_rows is None else max_rows
    return F.broadcast(df) if rows <= bound and size <= cfg.max_broadcast_bytes else df
