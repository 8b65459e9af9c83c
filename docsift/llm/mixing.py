"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. The
documents of a source stand in a fixed pseudo-random order within size
classes; the expected copies are prefix-summed in that order, one random
offset is added, and a document is emitted once for each integer boundary
its interval crosses. So each size class of a source is taken in proportion,
and the words taken come near the target.

All documents of a source expect the same number of copies, so the prefix
sum at a document is its rank times that number. The rank is built from
three bounded steps and never sorts a whole source in one task: counts of
(source, class), counts of (source, class, cell) and a row number inside a
cell. A cell is a prefix of the order key, so the order and the result do
not depend on how many cells there are.

Edge cases: a null text has size 0; a null source is a source of its own and
comes last; a source without words has target 0 and takes nothing; documents
of size 0 are drawn like the others of their source and count 0 words;
repeated rows are separate documents; very long texts are drawn whole; documents
that tie in size go by a hash of id and text; an empty table gives an empty result;
further columns of the input are kept and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import materialize, pack, text_or_empty, word_count
from docsift.operators.sizing import broadcast_if_small

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_COPIES = 2.0
SEED = "mix-1"
#: Documents of one (source, class) are numbered in 16 ** CELL_DIGITS cells.
CELL_DIGITS = 2


def size_class(size: Column) -> Column:
    """Orders sizes in eight classes an octave: bit length, then the leading bits."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_copies: float = MAX_COPIES
) -> DataFrame:
    """(source, source_size) -> the same with ``target``: ``budget`` times all
    sizes shared by weight, no source above ``max_copies`` times its size.

    The common level L with sum(min(weight * L, cap)) = budget is the largest
    of the levels that result when the first sources by cap / weight are full.
    One row per source, so the windows without a key see only that."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    caps = sizes.select(
        "source", "source_size", weight.alias("w"), (F.lit(max_copies) * F.col("source_size")).alias("cap")
    )
    by_need = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(budget) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    leveled = caps.withColumn("level", level)
    return leveled.select(
        "source", "source_size", F.least(F.col("w") * F.max("level").over(everything), F.col("cap")).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_copies: float = MAX_COPIES,
    seed: str = SEED,
    cell_digits: int = CELL_DIGITS,
) -> DataFrame:
    """One row per document: ``doc`` (the input row), ``size``,
    ``source_size``, ``target`` and ``copies`` (0 to ceil(max_copies))."""
    doc_id, text = F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")
    key = F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text_or_empty(text)))
    )
    rows = pack(docs).select(
        "doc", F.col(f"doc.`{source_col}`").alias("source"), word_count(text).alias("size"), key.alias("key")
    )
    rows = rows.withColumns({"cls": size_class(F.col("size")), "cell": F.substring("key", 1, cell_digits)})
    cells = materialize(
        rows.groupBy("source", "cls", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-cells"
    )
    classes = cells.groupBy("source", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(
        classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_copies
    )
    by_class = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = Window.partitionBy("source", "cls").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = classes.select(
        "source", "cls", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("class_start")
    )
    starts = cells.select("source", "cls", "cell", F.coalesce(F.sum("n").over(by_cell), F.lit(0)).alias("cell_start"))

    def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        on = [left[k].eqNullSafe(right[k]) for k in keys]
        return left.join(right, on).select(*[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys])

    starts = joined(joined(starts, first, "source", "cls"), targets, "source")
    in_cell = Window.partitionBy("source", "cls", "cell").orderBy("key", "size")
    # A row per source, size class and cell: broadcast if small, so that the texts are dealt out only for their ranks.
    starts = broadcast_if_small(materialize(starts, "mix-starts"))
    ranked = joined(rows.withColumn("at", F.row_number().over(in_cell)), starts, "source", "cls", "cell")
    rank = F.col("class_start") + F.col("cell_start") + F.col("at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    u = offset.cast("bigint") / F.lit(4294967296.0)
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return ranked.select(
        "doc", "size", "source_size", "target", F.least(copies, F.ceil(rate)).cast("int").alias("copies")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each input row as often as it was drawn."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
