"""Shared helpers of the corpus operators: character classes, packing, staging."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import ensure_checkpoint_dir, materialize, ship_code

__all__ = [
    "NON_SPACE_RUN", "SPACE_CHARS", "ascii_lower", "materialize", "pack", "prepare", "scratch_path", "table",
    "text_or_empty", "word_count",
]

#: The six ASCII white-space characters (0x20, 0x09-0x0D) and a run of anything else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
NON_SPACE_RUN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and Python code in place; safe to call again."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Text of ASCII characters alone takes the faster
    ``lower``, which does the same there."""
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(slow)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: Column) -> Column:
    """Number of runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(NON_SPACE_RUN)), F.lit(0)).cast("bigint")


def pack(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``doc``: working columns added beside it
    cannot clash with whatever else the table carries; ``select("doc.*")``
    gives the table back."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
