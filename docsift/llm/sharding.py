"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that no shard boundary cuts; the law is
``bytes``: shard sizes as near to each other as the groups allow.

1. Group sizes come from one aggregate over narrow rows (digest, bytes).
2. Groups are dealt into buckets of about ``groups_per_bucket`` by digest. In
   each bucket differencing partitions the groups into packs of equal bytes. A
   group larger than a pack is one by itself.
3. While the buckets are more than ``shards * packs_per_shard``, their packs
   (a tenth as many as groups) are the groups of a further level of buckets. The
   packs of the last level, at most ``2 * shards * packs_per_shard`` plus its
   buckets, are differenced into the shards.

Differencing keeps a heap of partial partitions and always combines the two
of largest spread, one in falling and the other in rising order.

Slots are numbered by shard from counts of (shard, cell) and a row number
inside a cell, so no task sorts a shard.

Edge cases: a null text counts as empty and groups with empty texts; a group
larger than an even share leaves its shard above the others, since it cannot
be cut; repeated rows stay together and get slots of their own; a null id is
kept; of a very long text only digest and length are used; packs of equal size
are placed in the order of their numbers, groups in that of their digests; an
empty table gives an empty result; other columns, also of clashing names, are
ignored.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty

N_SHARDS = 24
PACKS_PER_SHARD = 128
GROUPS_PER_BUCKET = 500
ROWS_PER_CELL = 50_000
MIN_CELLS = 16


def difference(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp: the part (0 to k-1) of each size.

    A partial partition lists its occupied parts (sum, node) in falling
    order. Two parts that meet become one node; the labels of the last
    partition then flow back down to the sizes."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return [0] * n
    children: list[tuple[int, int]] = []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        free = k - len(b)
        merged = a[:free]
        for i in range(free, len(a)):  # a falls while b rises from its end
            (sa, na), (sb, nb) = a[i], b[k - 1 - i]
            merged.append((sa + sb, n + len(children)))
            children.append((na, nb))
        merged += b[: k - max(len(a), free)]
        merged.sort(reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    label = [0] * (n + len(children))
    for part, (_, node) in enumerate(heap[0][2]):
        label[node] = part
    for j in range(len(children) - 1, -1, -1):
        for child in children[j]:
            label[child] = label[n + j]
    return label[:n]


def _pack_bucket(pack_bytes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "gid"], ascending=[False, True], kind="stable")
        ways = max(1, math.ceil(int(pdf["bytes"].sum()) / pack_bytes))
        parts = pd.Series(difference(pdf["bytes"].tolist(), ways), index=pdf.index, dtype="int64")
        return pdf.assign(pack=pdf["bucket"] * (1 << 32) + parts)[["gid", "bytes", "pack"]]

    return run


def shard_groups(
    groups: DataFrame, n_shards: int = N_SHARDS, packs_per_shard: int = PACKS_PER_SHARD,
    groups_per_bucket: int = GROUPS_PER_BUCKET,
) -> DataFrame:
    """(gid binary, bytes long) -> (gid, shard). Only pack sizes, whose
    number the parameters bound, meet on the driver."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    most_packs = n_shards * packs_per_shard
    n_buckets = max(1, math.ceil(n / groups_per_bucket))
    last = n_buckets <= most_packs
    pack_bytes = max(1, int(total) // (most_packs if last else n_buckets * max(1, groups_per_bucket // 10)))
    small = groups.where(F.col("bytes") <= pack_bytes).withColumn(
        "bucket", F.pmod(F.xxhash64("gid"), F.lit(n_buckets))
    )
    packed = materialize(
        small.groupBy("bucket").applyInPandas(_pack_bucket(pack_bytes), "gid binary, bytes bigint, pack bigint"), "packs"
    )
    large = groups.where(F.col("bytes") > pack_bytes)
    if not last:  # the packs are the groups of the next level
        name = F.encode(F.format_string("pack-%020d", "pack"), "utf-8")
        packs = packed.groupBy(name.alias("gid")).agg(F.sum("bytes").alias("bytes"))
        placed = materialize(
            shard_groups(packs.unionByName(large), n_shards, packs_per_shard, groups_per_bucket), "packs-placed"
        )
        of_pack = placed.select(F.col("gid").alias("of"), "shard")
        inside = packed.join(of_pack, name == of_pack["of"]).select("gid", "shard")
        return inside.unionByName(placed.join(large.select("gid"), "gid", "left_semi"))
    packs = [(r.pack, r.bytes) for r in packed.groupBy("pack").agg(F.sum("bytes").alias("bytes")).collect()]
    large = [(bytes(r.gid), r.bytes) for r in large.collect()]
    packs.sort(key=lambda x: (-x[1], x[0]))
    large.sort(key=lambda x: (-x[1], x[0]))
    shards = difference([b for _, b in large + packs], n_shards)
    of_large = spark.createDataFrame(
        [(g, s) for (g, _), s in zip(large, shards)], "gid binary, shard int"
    )
    of_pack = spark.createDataFrame(
        [(p, s) for (p, _), s in zip(packs, shards[len(large):])], "pack bigint, shard int"
    )
    return packed.join(F.broadcast(of_pack), "pack").select("gid", "shard").unionByName(of_large)


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow rows sharding works on: doc_id, size, text_crc32, gid."""
    text = text_or_empty(docs[f"`{text_col}`"])
    return docs.select(
        docs[f"`{id_col}`"].alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("gid"),
    )


def assign_shards(
    docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, gid, shard, slot."""
    rows = materialize(shard_rows(docs, id_col, text_col), "shard-rows")
    groups = rows.groupBy("gid").agg(F.sum("size").alias("bytes"))
    placed = materialize(rows.join(shard_groups(groups, n_shards), "gid"), "shard-placed")
    n_cells = max(MIN_CELLS, math.ceil(placed.count() / (n_shards * rows_per_cell)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "gid"), F.lit(n_cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "gid")
    numbered = placed.withColumn("at", F.row_number().over(in_cell) - 1).join(starts, ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "gid", "shard", (F.col("start") + F.col("at")).cast("bigint").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, text_col: str = "text") -> None:
    """Writes whole documents under ``path/shard=N``, several files a shard."""
    rows = shard_rows(docs.withColumn("_none", F.lit(None)), "_none", text_col)
    groups = materialize(rows.groupBy("gid").agg(F.sum("size").alias("bytes")), "shard-groups")
    of_group = shard_groups(groups, n_shards)
    gid = F.unhex(F.md5(text_or_empty(docs[f"`{text_col}`"])))
    docs.join(of_group, gid == of_group["gid"]).drop(of_group["gid"]).write.mode("overwrite").partitionBy("shard").parquet(path)
