"""Line dedup: lines found in many documents are dropped from all but one.

1. Lines are exploded with their position; a line's key is the line without
   ASCII white space at both ends and with A-Z lower-cased. Keys of at least
   ``min_chars`` code points are hashed (MD5, 128 bits) and written once as
   narrow rows (document, position, hash); no line text is shuffled.
2. Distinct documents are counted per hash. The distinct step is keyed by
   (hash, document) and the count is combined before its shuffle, so a line
   that stands in every document loads no single task.
3. Hashes in at least ``min_docs`` documents lose their lines except in the
   largest doc_id that holds them. The positions to drop are gathered per
   document and the text is put together again from the other lines.

Edge cases: a null or empty text is one empty line; lines keep their own
spelling and white space; a document made of dropped lines only becomes the
empty text; rows of one doc_id count as one document; a null doc_id counts
as one document and as smaller than any other; equal rows are treated alike
and all kept; very long texts are exploded like others and put together whole;
lines of one key are one line, whatever their spelling; further columns are kept and cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import SPACE_CHARS, ascii_lower, materialize, text_or_empty
from docsift.operators.sizing import broadcast_if_small

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Narrow rows (doc_id, text_hash, pos, line_hash) of the lines long enough."""
    text = text_or_empty(docs[f"`{text_col}`"])
    lines = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    keyed = lines.where(F.length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(SPACE_CHARS)))
    keyed = keyed.where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.unhex(F.md5(ascii_lower(F.col("key")))).alias("line_hash"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(line_hash, n_docs, keeper) of the hashes in at least ``min_docs`` documents."""
    held = lines.select("line_hash", "doc_id").distinct()
    counted = held.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """One row per input row: ``doc`` (its columns but the text), ``n_lines``,
    ``n_dropped`` and ``kept`` (the text without the dropped lines)."""
    lines = materialize(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    frequent = materialize(frequent_lines(lines, min_docs), "frequent-lines")
    hit = lines.join(broadcast_if_small(frequent), "line_hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # As many rows as documents with drops: joined by a shuffle at every size.
    drops = hit.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))
    # The lines are split before the join, so that the pieces below refer to a column.
    text = text_or_empty(docs[f"`{text_col}`"])
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col])
    rows = docs.select(others.alias("doc"), F.xxhash64(text).alias("hash"), F.split(text, "\n", -1).alias("lines"))
    on = F.col(f"doc.`{id_col}`").eqNullSafe(drops["doc_id"]) & (rows["hash"] == drops["text_hash"])
    joined = rows.join(drops, on, "left").select(
        "doc", "lines", F.sort_array(F.coalesce("drops", F.array().cast("array<int>"))).alias("drops")
    )
    first = F.concat(F.array(F.lit(0)), F.transform("drops", lambda p: p + 1))
    end = F.concat("drops", F.array(F.size("lines")))
    runs = F.zip_with(first, end, lambda a, b: F.slice("lines", a + 1, b - a))
    return joined.select(
        "doc",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("drops").cast("bigint").alias("n_dropped"),
        F.array_join(F.flatten(runs), "\n").alias("kept"),
    )
