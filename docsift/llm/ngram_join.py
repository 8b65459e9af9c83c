"""N-gram Jaccard join over a prefix tree.

Two documents link when the sets of their distinct n-grams (words are runs
without ASCII white space, A-Z lower-cased; five words) have a Jaccard
similarity of ``percent`` / 100 or more.

1. Frequencies. A task hashes the n-grams of its documents (XXH64), keeps equal
   sets once, and cuts about ``FLUSH_GRAMS`` n-grams in slices of the hash
   range. A slice's n-grams of all tasks meet in one place, are counted, and
   those that at least two sets have go back to the task's flush. The rest can
   take part in no link; only their number matters. An n-gram that many sets of
   a flush share is sent once with its count, so a common passage is no hot key.
2. Global order. Back in its flush, a set's shared n-grams are ordered by (how
   many sets have it, hash): rare first. A set with fewer shared n-grams than
   the overlap any link needs is done.
3. Families. Linked sets share an n-gram among the first (size - needed overlap
   + 1) of this order. Sets that share one there are joined to the smallest of
   them, and the connected components are families: links stay inside.
4. Prefix tree. The ordered sets of a family are stored in a tree whose edges
   are runs of n-grams. All sets walk down together: the overlap with the path
   so far is computed once and shared by the sets below. A walker leaves a
   subtree when the overlap so far plus the smaller of what remains of either
   side cannot reach the share needed, and nobody enters it when all have left.
   A family of more than ``max_grams`` n-grams is cut in blocks, and every pair
   of blocks is a task of its own.
5. Components of the links by star steps.

A task of step 4 emits a row for each linked set: the smallest it reaches here
and the number of its links, never all pairs.

Edge cases: fewer words than n are one n-gram; a text without words (null,
empty, blank) has the empty set and links with nothing, its component is its
own id; equal sets are one class (repeated rows, copies that differ in white
space or case); null ids never become a component id unless all ids of the
component are null; very long texts are hashed in pieces; a similarity of
exactly the threshold links; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialize
from docsift.llm.simhash import _hashes, _word_pieces, star_components
from docsift.operators.sizing import broadcast_if_small

WORDS = 5
PERCENT = 80
FLUSH_GRAMS = 1 << 21
MAX_GRAMS = 1 << 20
#: Cells of the table (walkers x n-grams of a block) that a task holds.
TABLE_CELLS = 1 << 23
#: Marks, in a slice, an n-gram that several sets of the flush have.
_SEVERAL = np.uint32(0xFFFFFFFF)
_TABLE_ROW, _SLICE_ROW, _SEVERAL_ROW = 0, 1, 2


def gram_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct n-gram hashes of a text, rising."""
    found, carry = [], []
    for piece in _word_pieces((text or "").encode().lower()):  # bytes.lower() changes A-Z only
        words = carry + piece
        if len(words) >= k:
            found.append(np.unique(_hashes(words, k)))
            words = words[len(words) - k + 1 :]
        carry = words
    if not found:
        return _hashes(carry, len(carry)) if carry else np.zeros(0, np.uint64)
    return np.unique(np.concatenate(found))


def needed(n, percent: int):
    """The overlap that any link of a set of n needs: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _pack(x: np.ndarray) -> bytes:
    """Bytes by significance, so that the zeros of small numbers stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _gaps(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


# --- 1. frequencies --------------------------------------------------------


def _row_schema(id_type: str) -> str:
    return f"slice int, flush bigint, kind int, ids array<{id_type}>, a binary, b binary, c binary"


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _flush_rows(schema: pa.Schema, flush: int, ids: list, of: list[int], sets: list[np.ndarray], slices: int):
    """A flush's table of sets, and its n-grams by slice."""
    keys = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    sizes = np.array([len(s) for s in sets], np.uint64)
    home = flush % slices
    yield _row(schema, home, flush, _TABLE_ROW, ids, np.array(of, np.uint32).tobytes(), sizes.tobytes(), keys)
    grams = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, at = grams[order], at[order]
    first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0) if len(grams) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(grams))).astype(np.uint64)
    several = np.repeat(count > 1, count.astype(np.int64))
    yield _row(schema, home, flush, _SEVERAL_ROW, None, _gaps(grams[several]), None, _pack(at[several]))
    once = np.where(count > 1, _SEVERAL, at[first])
    grams = grams[first]
    part = ((grams >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    edges = np.searchsorted(part, np.arange(slices + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(edges)):
        own = slice(edges[s], edges[s + 1])
        own_counts = count[own]
        yield _row(
            schema, int(s), flush, _SLICE_ROW, None, _gaps(grams[own]), _pack(own_counts[own_counts > 1]), _pack(once[own])
        )


def _flush_batches(schema: pa.Schema, k: int, slices: int, flush_grams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 32
        ids, of, sets, known, held = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                grams = gram_set(text.as_py(), k)
                key = xxhash.xxh3_128_digest(grams.tobytes())
                if key not in known:
                    known[key] = len(sets)
                    sets.append(grams)
                    held += len(grams)
                ids.append(doc_id.as_py())
                of.append(known[key])
                if held >= flush_grams or len(ids) >= flush_grams:
                    yield from _flush_rows(schema, flush, ids, of, sets, slices)
                    flush += 1
                    ids, of, sets, known, held = [], [], [], {}, 0
        if ids:
            yield from _flush_rows(schema, flush, ids, of, sets, slices)

    return run


def count_slice(blobs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, counts of those that several sets have, places) of each flush
    -> the n-grams that two sets or more have, their counts over all, places."""
    counts = []
    for _, many, at in blobs:
        c = np.ones(len(at), np.uint64)
        c[at == _SEVERAL] = many
        counts.append(c)
    grams = np.concatenate([g for g, _, _ in blobs])
    known, which = np.unique(grams, return_inverse=True)
    total = np.zeros(len(known), np.uint64)
    np.add.at(total, which, np.concatenate(counts))
    total = total[which]
    out, start = [], 0
    for g, _, at in blobs:
        t = total[start : start + len(g)]
        start += len(g)
        out.append((g[t > 1], t[t > 1], at[t > 1]))
    return out


def _count_batches(schema: pa.Schema):
    def counted(flushes: list[int], blobs: list) -> Iterator[pa.RecordBatch]:
        for flush, (grams, total, at) in zip(flushes, count_slice(blobs)):
            if len(grams):
                yield _row(schema, 0, flush, _SLICE_ROW, None, _gaps(grams), _pack(total), _pack(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, flushes, blobs = None, [], []  # the rows of a slice stand together
        for batch in batches:
            other = pa.compute.not_equal(batch.column("kind"), _SLICE_ROW)
            passed = batch.filter(other)
            if passed.num_rows:
                yield passed
            batch = batch.filter(pa.compute.invert(other))
            for s, flush, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("slice", "flush", "a", "b", "c"))):
                if s != here and blobs:
                    yield from counted(flushes, blobs)
                    flushes, blobs = [], []
                here = s
                flushes.append(flush)
                blobs.append((_rising(a), _unpack(b, np.uint64), _unpack(c, np.uint32)))
        if blobs:
            yield from counted(flushes, blobs)

    return run


# --- 2. global order -------------------------------------------------------


def _ordered_batches(schema: pa.Schema, percent: int):
    def sets_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        (ids, of, sizes, keys) = next(
            (i, np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint64).astype(np.int64), c) for kind, i, a, b, c in rows if kind == _TABLE_ROW
        )
        several_grams, several_at = next((_rising(a), _unpack(c, np.uint32)) for kind, _, a, _, c in rows if kind == _SEVERAL_ROW)
        blobs = [(_rising(a), _unpack(b, np.uint64), _unpack(c, np.uint32)) for kind, _, a, b, c in rows if kind == _SLICE_ROW]
        grams, total, at = (np.concatenate([*x, np.zeros(0, t)]) for x, t in zip(
            zip(*blobs) if blobs else ([], [], []), (np.uint64, np.uint64, np.uint32)
        ))
        many = at == _SEVERAL
        by_gram = np.argsort(grams[many])
        of_many = total[many][by_gram][np.searchsorted(grams[many][by_gram], several_grams)] if len(several_grams) else total[:0]
        grams = np.concatenate([grams[~many], several_grams])
        total = np.concatenate([total[~many], of_many])
        at = np.concatenate([at[~many], several_at]).astype(np.int64)
        shared = np.bincount(at, minlength=len(sizes))
        stays = (shared >= needed(sizes, percent)) & (sizes > 0)
        inside = stays[at]
        grams, total, at = grams[inside], total[inside], at[inside]
        order = np.lexsort((grams, total, at))
        grams, total = grams[order].view(np.int64), total[order].view(np.int64)
        lengths = np.where(stays, shared, 0)
        start = np.concatenate(([0], np.cumsum(lengths)))
        first = np.zeros(len(of), bool)
        first[np.unique(of, return_index=True)[1]] = True
        for lo in range(0, len(of), 1024):
            mine = range(lo, min(lo + 1024, len(of)))
            has = [first[i] and stays[of[i]] for i in mine]
            spans = [slice(start[of[i]], start[of[i] + 1]) if h else None for i, h in zip(mine, has)]
            columns = [
                pa.array(ids[lo : lo + 1024], schema.field(0).type),
                pa.array(sizes[of[lo : lo + 1024]]),
                pa.array([keys[16 * of[i] : 16 * of[i] + 16] for i in mine], pa.binary()),
                *(pa.array([None if s is None else x[s] for s in spans], pa.list_(pa.int64())) for x in (grams, total)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []  # the rows of a flush stand together
        for batch in batches:
            for flush, *row in zip(*(batch.column(x).to_pylist() for x in ("flush", "kind", "ids", "a", "b", "c"))):
                if flush != here and held:
                    yield from sets_of(held)
                    held = []
                here = flush
                held.append(row)
        if held:
            yield from sets_of(held)

    return run


def ordered_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    flush_grams: int = FLUSH_GRAMS,
) -> DataFrame:
    """doc_id, n (size of the set), key (of equal sets); and once a flush and
    set that may have a link: its shared n-grams in the global order and how
    many sets (copies in several flushes count again) have each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    slices = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = _row_schema(id_type)
    # Arrow schemas from the declared types, so that ids keep theirs.
    arrow = lambda s: to_arrow_schema(rows.sparkSession.createDataFrame([], s).schema)
    shape, out = arrow(ddl), f"doc_id {id_type}, n bigint, key binary, grams array<bigint>, sets array<bigint>"
    sliced = rows.mapInArrow(_flush_batches(shape, words, slices, flush_grams), ddl)
    counted = sliced.repartition("slice").sortWithinPartitions("slice").mapInArrow(_count_batches(shape), ddl)
    return counted.repartition("flush").sortWithinPartitions("flush").mapInArrow(_ordered_batches(arrow(out), percent), out)


# --- 3. families -----------------------------------------------------------


def families(sets: DataFrame, percent: int) -> DataFrame:
    """(key, family) of the sets that share an early n-gram with another set."""
    early = F.slice("grams", F.lit(1), (F.size("grams") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    keyed = materialize(sets.select("key", F.explode(early).alias("gram")), "early-grams")
    least = materialize(keyed.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").drop("high"), "early-least")
    edges = keyed.join(least, "gram").where(F.col("key") != F.col("low"))
    found = star_components(edges.select(F.col("key").alias("a"), F.col("low").alias("b")).distinct())
    found = found.select(F.col("node").alias("key"), F.col("root").alias("family"))
    return found.unionByName(found.select(F.col("family").alias("key"), "family").distinct())


# --- 4. prefix tree --------------------------------------------------------


class PrefixTree:
    """Ordered sets of numbers; the order of the sets is that of their sequences."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.lengths = np.array([len(s) for s in self.sets])
        # Numbers that each set shares with the one before it, from the left.
        self.common = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def walk(self, table: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
        """(walkers, set) of every link. ``table``: walkers x numbers, which they have."""
        after = np.zeros((table.shape[0], table.shape[1] + 1), np.int32)  # numbers of a walker from here on
        after[:, :-1] = np.cumsum(table[:, ::-1], axis=1, dtype=np.int32)[:, ::-1]
        everyone = np.arange(table.shape[0])
        todo = [(0, len(self.sets), 0, everyone, np.zeros(len(everyone), np.int64))]
        while todo:
            lo, hi, depth, walkers, overlap = todo.pop()
            # The edge: what all sets of this subtree share beyond the path so far.
            end = self.lengths[lo] if hi == lo + 1 else self.common[lo + 1 : hi].min()
            edge = self.sets[lo][depth:end]
            if len(edge):
                overlap = overlap + np.count_nonzero(table[np.ix_(walkers, edge)], axis=1)
            left = after[walkers, edge[-1] + 1] if len(edge) else after[walkers, self.sets[lo][end - 1] + 1 if end else 0]
            most = overlap + np.minimum(left, self.lengths[lo:hi].max() - end)
            stays = (100 + percent) * most >= percent * (sizes[walkers] + self.sizes[lo:hi].min())
            walkers, overlap = walkers[stays], overlap[stays]
            if not len(walkers):
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo + 1 : hi] == end)).tolist(), hi]
            for a, b in zip(cuts, cuts[1:]):
                if b == a + 1 and self.lengths[a] == end:
                    links = (100 + percent) * overlap >= percent * (sizes[walkers] + self.sizes[a])
                    if links.any():
                        yield walkers[links], self.order[a]
                else:
                    todo.append((a, b, end, walkers, overlap))


def tree_links(grams: list[np.ndarray], sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray | None, percent: int):
    """Links (i, j) between different sets; with ``sides`` only from a set of
    side 0 to one of side 1."""
    flat = np.concatenate(grams)
    known, at = np.unique(flat, return_index=True)
    rank = np.empty(len(known), np.uint32)
    rank[np.lexsort((known.view(np.uint64), np.concatenate(sets)[at]))] = np.arange(len(known), dtype=np.uint32)
    lengths = np.cumsum([len(g) for g in grams])[:-1]
    numbers = np.split(rank[np.searchsorted(known, flat)], lengths)
    walkers = np.arange(len(grams)) if sides is None else np.flatnonzero(sides == 0)
    stored = np.arange(len(grams)) if sides is None else np.flatnonzero(sides == 1)
    if not len(walkers) or not len(stored):
        return walkers[:0], walkers[:0]
    tree = PrefixTree([numbers[i] for i in stored], sizes[stored])
    step = max(1, TABLE_CELLS // max(1, len(known)))
    left, right = [], []
    for lo in range(0, len(walkers), step):
        group = walkers[lo : lo + step]
        table = np.zeros((len(group), len(known)), bool)
        for row, i in enumerate(group):
            table[row, numbers[i]] = True
        for who, j in tree.walk(table, sizes[group], percent):
            left.append(group[who])
            right.append(np.full(len(who), stored[j]))
    i, j = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
    return (i[i != j], j[i != j]) if sides is None else (i, j)


def _smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def _link_batches(percent: int):
    def links(rows: list[tuple], within: bool) -> pa.RecordBatch:
        rows = list({r[0]: r for r in rows}.values())  # a set comes once a flush that has it
        rows.sort(key=lambda r: r[0])
        keys = [r[0] for r in rows]
        sizes = np.array([r[1] for r in rows])
        sides = None if within else np.array([r[4] for r in rows])
        i, j = tree_links([r[2] for r in rows], [r[3] for r in rows], sizes, sides, percent)
        low = _smallest_reached(len(rows), i, j)
        number = np.bincount(i, minlength=len(rows))
        if not within:
            number = number + np.bincount(j, minlength=len(rows))
        out = np.flatnonzero(number)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[x] for x in out], pa.binary()), pa.array([keys[low[x]] for x in out], pa.binary()), pa.array(number[out], pa.int64())],
            ["key", "low", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []  # the rows of a task (family, part, other) stand together
        for batch in batches:
            parts = [batch.column(x).to_pylist() for x in ("family", "part", "other", "key", "n", "side")]
            grams, sets = batch.column("grams"), batch.column("sets")
            for row, (family, part, other, key, n, side) in enumerate(zip(*parts)):
                if (family, part, other) != here and held:
                    yield links(held, here[1] == here[2])
                    held = []
                here = (family, part, other)
                held.append((key, n, grams[row].values.to_numpy(), sets[row].values.to_numpy(), side))
        if held:
            yield links(held, here[1] == here[2])

    return run


def links(sets: DataFrame, percent: int = PERCENT, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(key, low, links): the sets linked with another, a smaller one that they
    reach, and their links; several rows a set, whose links add up."""
    sets = sets.where("grams IS NOT NULL")
    of = materialize(families(sets, percent), "families")
    members = materialize(sets.join(of, "key").select("key", "family", "n", "grams", "sets"), "family-sets")
    weight = members.groupBy("family").agg(F.sum(F.size("grams")).alias("weight")).where(F.col("weight") > max_grams)
    large = broadcast_if_small(materialize(weight, "large-families"))
    parts = F.coalesce(F.ceil(F.col("weight") / max_grams), F.lit(1)).cast("int")
    dealt = members.join(large, "family", "left").withColumn("parts", parts).drop("weight")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    dealt = dealt.select(
        "family", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"),
        (F.col("own") > F.col("with")).cast("int").alias("side"), "key", "n", "grams", "sets",
    )
    dealt = dealt.repartition("family", "part", "other").sortWithinPartitions("family", "part", "other", "key")
    return dealt.mapInArrow(_link_batches(percent), "key binary, low binary, links bigint")


# --- 5. components ---------------------------------------------------------


def join_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    max_grams: int = MAX_GRAMS, flush_grams: int = FLUSH_GRAMS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key (equal for equal sets),
    n_links (other sets it is linked with), component_id."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be 1 to 100")
    found = materialize(ordered_sets(docs, id_col, text_col, words, percent, flush_grams), "ordered-sets")
    rows = found.select("doc_id", "n", "key")
    linked = materialize(links(found, percent, max_grams), "links")
    roots = star_components(linked.where(F.col("key") != F.col("low")).select(F.col("key").alias("a"), F.col("low").alias("b")))
    degree = linked.groupBy("key").agg(F.sum("links").alias("n_links"))
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    classes = classes.join(roots, classes["key"] == roots["node"], "left").join(degree, "key", "left")
    classes = materialize(classes.select("key", "first", "n_links", F.coalesce("root", "key").alias("root")), "classes")
    component = materialize(classes.groupBy("root").agg(F.min("first").alias("component_id")), "class-components")
    of_class = materialize(classes.join(component, "root").select("key", "n_links", "component_id"), "class-members")
    out = rows.join(of_class, "key", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
