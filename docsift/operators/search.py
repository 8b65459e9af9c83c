"""Exact k-nearest-vector search.

Plan, per query block:

    vectors scan (pos, doc_id, embedding)            -- pruned parquet scan
      -> mapInArrow: tiles of the distance matrix in numpy,
         running top-k per query inside the partition  -- no pair rows emitted
      -> merge of the tasks' results in ``top_k_fan_in`` groups per query
      -> row_number() over (query_id order by dist, pos) <= k

A few queries (``FEW_ROWS``, and within ``max_query_block_bytes``) reach every
task through a broadcast variable, and so does an index of few vectors. Else
query blocks meet stripes of the vectors on the executors, in as many groups
as the distances to compute ask for: a task holds one block and streams one
stripe past it, and nothing passes through the driver. Distances are squared
L2 in float64; candidates are preselected with ``|v|^2 - 2 q.v`` in float32
against the query's k-th distance so far, and every candidate within that
product's error bound is scored exactly, so the selection is exact. Ties are
broken by position.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.config import DEFAULT, EngineConfig

#: Rows of a tile of vectors, entries of its distance matrix, and values of the
#: pairs scored at once: what a task holds beside its queries and one batch.
TILE_ROWS, TILE_CELLS, PAIR_CELLS = 2048, 1 << 20, 1 << 19
OUT_ROWS = 100_000
#: Up to so many rows one side is broadcast and the other scanned where it is.
FEW_ROWS = 4096
#: Distances that a group of the grid computes (some ten seconds); fewer when
#: the cores would not all have work.
GROUP_CELLS, GROUPS_PER_CORE = 1 << 33, 3
_NO_POS = np.iinfo(np.int64).max
#: A stripe of the vectors is streamed, not held: this many query blocks in size.
STRIPE_BLOCKS = 8

HIT_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("dist", T.DoubleType()),
    ]
)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List<float|double> arrow column -> (n, dim) matrix of its type (width checked)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, dim), dtype=np.float32)
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"vector width differs from {dim}; filter with check_width() first")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)


def _group_topk(qi, pos, dist, k):
    """Indices of the k best (dist, pos) rows per query index; inputs are aligned."""
    order = np.lexsort((pos, dist, qi))
    if len(order) == 0:
        return order
    qi = qi[order]
    starts = np.r_[0, np.flatnonzero(qi[1:] != qi[:-1]) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    return order[(np.arange(len(qi)) - group_start) < k]


def _first_copies(vmat: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among anyone's k best: of equal vectors the k first by
    position, as the others only tie with them and come later."""
    order = np.argsort(pos, kind="stable")
    rows = np.ascontiguousarray(vmat[order])
    same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by_copy = np.argsort(same, kind="stable")
    kept = _group_topk(same[by_copy], np.arange(len(same)), np.zeros(len(same)), k)
    return order[np.sort(by_copy[kept])]


def _extended(mat: np.ndarray, factor: float, last: np.ndarray, dtype) -> np.ndarray:
    """``factor * mat`` with one more column."""
    out = np.empty((mat.shape[0], mat.shape[1] + 1), dtype=dtype)
    np.multiply(mat, factor, out=out[:, :-1], casting="same_kind")
    out[:, -1] = last
    return out


class _Best:
    """The k best (distance, position, source row) of each query so far, kept
    in order; distances are exact."""

    def __init__(self, qmat: np.ndarray, k: int):
        n = len(qmat)
        self.q, self.k = qmat, k
        self.d = np.full((n, k), np.inf)
        self.p = np.full((n, k), _NO_POS)
        self.doc = pa.nulls(n * k, pa.string())
        self._begin()

    def _begin(self) -> None:
        # Rows of the batch, or where the document stood before it (below 0).
        self.src = -1 - np.arange(self.d.size).reshape(self.d.shape)

    def offer(self, qi: np.ndarray, rows: np.ndarray, pos: np.ndarray, vmat: np.ndarray) -> None:
        """Scores the pairs (query, row), ordered by query, and keeps the best."""
        step = max(1, PAIR_CELLS // self.q.shape[1])
        for at in range(0, len(qi), step):
            q, v = qi[at : at + step], rows[at : at + step]
            diff = self.q[q].astype(np.float64) - vmat[v]
            dist = np.einsum("ij,ij->i", diff, diff)
            near = dist <= self.d[q, -1]
            q, v, dist = q[near], v[near], dist[near]
            if not len(q):
                continue
            who = q[np.r_[True, q[1:] != q[:-1]]]
            all_q = np.r_[np.repeat(who, self.k), q]
            all_d, all_p = np.r_[self.d[who].ravel(), dist], np.r_[self.p[who].ravel(), pos[v]]
            all_src = np.r_[self.src[who].ravel(), v]
            won = _group_topk(all_q, all_p, all_d, self.k)
            for held, now in ((self.d, all_d), (self.p, all_p), (self.src, all_src)):
                held[who] = now[won].reshape(-1, self.k)

    def end(self, doc: pa.Array) -> None:
        """End of a batch: document ids stay in Arrow; only those of the winners are taken."""
        src = self.src.ravel()
        if (src >= 0).any():
            self.doc = pa.concat_arrays([self.doc, doc]).take(pa.array(np.where(src < 0, -1 - src, src.size + src)))
            self._begin()


def _partition_topk(qids: np.ndarray, qmat: np.ndarray, k: int, dim: int):
    """The k best of a stream of batches for every query. The matrix of a tile
    is ``|v|^2 - 2 q.v``, one product in float32 (float64 beyond its range);
    what is within its rounding bound of the query's k-th distance so far is
    scored exactly. A tile, and the pairs scored at once, have a fixed size."""
    qnorm = np.einsum("ij,ij->i", qmat, qmat, dtype=np.float64)
    q_top = np.abs(qmat).max(initial=0)
    left: dict = {}

    def run(batches):
        best = _Best(qmat, k)
        for batch in batches:
            if batch.num_rows == 0 or len(qids) == 0:
                continue
            pos = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            vmat = _matrix(batch.column("embedding"), dim)
            vnorm = np.einsum("ij,ij->i", vmat, vmat, dtype=np.float64)
            first = _first_copies(vmat, pos, k)
            dtype = np.float32 if max(q_top, np.abs(vmat).max()) < 1e15 else np.float64
            if dtype not in left:
                left[dtype] = _extended(qmat, 1.0, 1.0, dtype)
            least = 1e-30 if dtype is np.float32 else 1e-300
            # the same memory for every tile
            matrix, mask = np.empty(TILE_CELLS, dtype=dtype), np.empty(TILE_CELLS, dtype=bool)
            for lo in range(0, len(first), TILE_ROWS):
                rows = first[lo : lo + TILE_ROWS]
                right = _extended(vmat[rows], -2.0, vnorm[rows], dtype).T
                # rounding of the product is below 2(dim+4)eps(|q|^2+|v|^2)
                tol = 4.0 * (dim + 4) * np.finfo(dtype).eps * (qnorm + np.fmax.reduce(vnorm[rows])) + least
                for at in range(0, len(qids), step := TILE_CELLS // len(rows)):
                    part = slice(at, at + step)
                    upto = best.d[part, -1] - qnorm[part] + tol[part]
                    shape = (len(upto), len(rows))
                    approx, near = matrix[: len(upto) * len(rows)].reshape(shape), mask[: len(upto) * len(rows)].reshape(shape)
                    np.matmul(left[dtype][part], right, out=approx)
                    np.less_equal(approx, _above(upto, dtype)[:, None], out=near)
                    if len(rows) > k and np.count_nonzero(near) > 4 * k * len(upto):
                        # entries that could be among the tile's own k best
                        kth = np.partition(approx, k - 1, axis=1)[:, k - 1]
                        np.less_equal(approx, _above(np.fmin(upto, kth + 2.0 * tol[part]), dtype)[:, None], out=near)
                    qi, vi = np.divmod(np.flatnonzero(near), len(rows))
                    if len(qi):
                        best.offer(at + qi, rows[vi], pos, vmat)
            best.end(batch.column("doc_id").cast(pa.string()))
        found = np.flatnonzero(best.p.ravel() != _NO_POS)
        for at in range(0, len(found), OUT_ROWS):
            some = found[at : at + OUT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(qids[some // k], type=pa.int64()),
                    pa.array(best.p.ravel()[some], type=pa.int64()),
                    best.doc.take(pa.array(some)),
                    pa.array(best.d.ravel()[some], type=pa.float64()),
                ],
                schema=pa.schema(
                    [("query_id", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.string()), ("dist", pa.float64())]
                ),
            )

    return run


def _above(x: np.ndarray, dtype) -> np.ndarray:
    """``x`` in ``dtype``, not rounded down."""
    return np.nextafter(x.astype(dtype), dtype(np.inf))


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    cfg: EngineConfig = DEFAULT,
    *,
    dim: int | None = None,
    pad: bool = False,
    info: dict | None = None,
) -> DataFrame:
    """Exact top-k by squared L2.

    vectors: (pos bigint, doc_id string, embedding array<float|double>)
    queries: (query_id bigint, embedding array<float|double>)
    returns: (query_id, rank, pos, doc_id, dist); with ``pad`` every query
    gets ranks 1..k and missing slots carry pos -1, doc_id NULL (K2).
    ``info``, when given, receives the number of searchable queries.
    """
    k = k or cfg.top_k
    spark = vectors.sparkSession
    # a NULL vector can be neither searched nor found
    q = _vector_rows(queries, F.col("query_id").cast("bigint"))
    # size check before anything is collected: the count prunes the vector
    # column (a computed embedding is not evaluated); the width is read from
    # one row when not given
    n_q = q.select("query_id").count()
    if info is not None:
        info["n_queries"] = n_q  # callers bound their own broadcasts with it
    if dim is None and n_q > 0:
        dim = int(q.select(F.size("embedding").alias("w")).first()["w"])
    d = dim or cfg.dim
    # the vector side keeps its scan partitioning (no shuffle, no count):
    # large tables arrive in many splits, each a task of the block kernel
    v = _vector_rows(vectors, F.col("pos").cast("bigint"), F.col("doc_id").cast("string"))

    bytes_needed = n_q * d * 8
    if n_q == 0:
        hits = spark.createDataFrame([], HIT_SCHEMA)
    elif n_q <= FEW_ROWS and bytes_needed <= cfg.max_query_block_bytes:
        hits = merge_top_k(_stream_vectors(q, v, k, d), F.spark_partition_id(), k, cfg.top_k_fan_in)
    elif (n_v := v.count()) <= FEW_ROWS and n_v * (d * 8 + 64) <= cfg.max_query_block_bytes:
        # many queries, small index: the index is the side of proven size
        hits = _stream_queries(q, v, k, d)
    else:
        n_blocks, n_stripes = _grid(n_q, n_v, d, k, cfg, spark.sparkContext.defaultParallelism)
        hits = _blocks_by_stripes(q, v, k, d, n_blocks, n_stripes)
        if n_stripes > cfg.top_k_fan_in:  # a query has k rows a stripe
            hits = merge_top_k(hits, F.pmod(F.xxhash64("pos"), F.lit(n_stripes)), k, cfg.top_k_fan_in)
    w = Window.partitionBy("query_id").orderBy("dist", "pos")
    top = hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    top = top.select("query_id", "rank", "pos", "doc_id", "dist")
    if pad:
        top = pad_hits(top, q.select("query_id"), k)
    return top


def _vector_rows(df: DataFrame, *cols) -> DataFrame:
    """The columns and ``embedding``, as it is when made of floats (tasks widen
    it, so half the bytes travel), else of doubles; rows without one left out."""
    element = df.schema["embedding"].dataType.elementType
    vector = F.col("embedding") if isinstance(element, T.FloatType) else F.col("embedding").cast("array<double>").alias("embedding")
    return df.select(*cols, vector).where(F.col("embedding").isNotNull())


def merge_top_k(hits: DataFrame, part: Column, k: int, fan_in: int) -> DataFrame:
    """W1 as an associative merge: the k best of each query in each of
    ``fan_in`` groups of partial results. However many tasks scanned, the
    window that ranks a query gets at most fan_in x k of its rows; Spark limits
    each task's rows before either shuffle."""
    grouped = hits.withColumn("_group", F.pmod(part, F.lit(fan_in)).cast("int"))
    w = Window.partitionBy("query_id", "_group").orderBy("dist", "pos")
    return grouped.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_group", "_rank")


def _stream_queries(q: DataFrame, v: DataFrame, k: int, d: int) -> DataFrame:
    """Roles swapped: the (small, checked) index is broadcast once, each
    query batch is scored against all of it inside one task."""
    spark = q.sparkSession
    tbl = v.toArrow()
    index = pa.RecordBatch.from_arrays(
        [tbl.column("pos").combine_chunks(), tbl.column("doc_id").combine_chunks(),
         tbl.column("embedding").combine_chunks()],
        names=["pos", "doc_id", "embedding"],
    )
    bc = spark.sparkContext.broadcast(index)

    def run(batches):
        idx = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            qids = batch.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
            qmat = _matrix(batch.column("embedding"), d)
            yield from _partition_topk(qids, qmat, k, d)([idx])

    return q.mapInArrow(run, HIT_SCHEMA)


def _stream_vectors(q: DataFrame, v: DataFrame, k: int, d: int) -> DataFrame:
    """The (checked) query set is broadcast, the vector scan streams past it."""
    tbl = q.toArrow()
    qids = tbl.column("query_id").to_numpy(zero_copy_only=False).astype(np.int64)
    bc = q.sparkSession.sparkContext.broadcast((qids, _matrix(tbl.column("embedding"), d)))

    def run(batches):
        qids, qmat = bc.value
        yield from _partition_topk(qids, qmat, k, d)(batches)

    return v.mapInArrow(run, HIT_SCHEMA)


def _grid(n_q: int, n_v: int, d: int, k: int, cfg: EngineConfig, cores: int) -> tuple[int, int]:
    """Query blocks and vector stripes: groups of bounded work, and the split
    between the two sides that shuffles least. A further stripe sends every
    query and its k rows once more, a further block every vector. A block is
    held by a task, so its bytes are bounded."""
    groups = max(math.ceil(n_q * n_v / GROUP_CELLS), min(GROUPS_PER_CORE * cores, math.ceil(n_q * n_v / (FEW_ROWS * FEW_ROWS))))
    per_stripe, per_block = n_q * (d * 4 + k * 100), max(1, n_v) * (d * 4 + 50)
    n_blocks = max(1, round(math.sqrt(groups * per_stripe / per_block)), math.ceil(n_q * d * 8 / cfg.max_query_block_bytes))
    n_stripes = max(math.ceil(groups / n_blocks), math.ceil(n_v * (d * 8 + 64) / (cfg.max_query_block_bytes * STRIPE_BLOCKS)), 1)
    return n_blocks, n_stripes


def _blocks_by_stripes(q: DataFrame, v: DataFrame, k: int, d: int, n_blocks: int, n_stripes: int) -> DataFrame:
    """Every (query block, vector stripe) is a group of one shuffle, sorted so
    that the block's queries come before the stripe's vectors. A task keeps the
    queries of its current group and their running top-k; a query gives at most
    k rows per stripe."""
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    same = q.schema["embedding"].dataType == v.schema["embedding"].dataType
    vector = F.col("embedding") if same else F.col("embedding").cast("array<double>").alias("embedding")
    left = q.select(
        number("query_id", n_blocks).alias("block"), every(n_stripes).alias("stripe"), F.lit(0).alias("side"),
        F.col("query_id").alias("pos"), F.lit(None).cast("string").alias("doc_id"), vector,
    )
    right = v.select(
        every(n_blocks).alias("block"), number("pos", n_stripes).alias("stripe"), F.lit(1).alias("side"), "pos", "doc_id", vector
    )
    # A task holds many groups, one after the other: their number is no number of tasks.
    spark = q.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out by number, so that no task gets several by chance while others have none.
    n_tasks = min(n_blocks * n_stripes, most)
    met = left.unionByName(right).repartitionById(n_tasks, F.pmod(F.col("block") * n_stripes + F.col("stripe"), F.lit(n_tasks)).cast("int"))
    return met.sortWithinPartitions("block", "stripe", "side").mapInArrow(_group_scan(k, d), HIT_SCHEMA)


def _runs(batches):
    """Batches cut where (block, stripe, side) changes, with that key."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "stripe", "side")])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield tuple(keys[:, lo].tolist()), batch.slice(lo, hi - lo)


def _group_scan(k, d):
    def run(batches):
        for _, group in itertools.groupby(_runs(batches), key=lambda r: r[0][:2]):
            held, rest = [], []
            for (_, _, side), batch in group:
                if side:
                    rest = [batch]
                    break
                held.append(batch)
            if not held or not rest:  # a block without queries, or a stripe without vectors
                continue
            qids = np.concatenate([b.column("pos").to_numpy(zero_copy_only=False).astype(np.int64) for b in held])
            qmat = np.concatenate([_matrix(b.column("embedding"), d) for b in held])
            yield from _partition_topk(qids, qmat, k, d)(itertools.chain(rest, (b for _, b in group)))

    return run


def pad_hits(hits: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """K2: ranks 1..k per query; empty slots get pos -1 and no document."""
    slots = query_ids.select("query_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rank"))
    return (
        slots.join(hits, ["query_id", "rank"], "left")
        .select(
            "query_id",
            "rank",
            F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"),
            "doc_id",
            "dist",
        )
    )
