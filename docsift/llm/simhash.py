"""SimHash near-duplicates with bit-sliced comparison.

1. A fingerprint per document: words (runs without ASCII white space, A-Z
   lower-cased), shingles of ``shingle`` words, XXH64 with seed 42 of each; a
   bit is set when more than half of the hashes set it.
2. Equal fingerprints are one node. The fingerprint is cut into ``radius + 2``
   blocks; two fingerprints within the radius agree on at least two blocks,
   so every linked pair meets under one of the keys made of two blocks.
3. The nodes of a key are compared bit-sliced: their bits are stored as 64
   vertical planes, a carry-save adder sums the differing planes of 64 lanes a
   word, and words whose lanes are all beyond the radius are abandoned. Only a
   forest of links (node, smallest node it reaches here) leaves the task,
   never all pairs. Within a key, a search that only looks at nodes not yet
   reached keeps dense groups cheap. A key with more than ``max_group`` nodes
   is cut in sub-groups and every pair of sub-groups is a task of its own.
4. Components come from alternating large-star and small-star steps over the
   links, each written to the checkpoint folder.

Edge cases: a text without words (null, empty, blank) has fingerprint zero
and is linked like any other; fewer words than a shingle make one shingle;
very long texts are hashed in pieces; repeated rows share a component; null
ids never become a component id unless the whole component has none; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty
from docsift.operators.sizing import broadcast_if_small

SHINGLE = 4
RADIUS = 4
SEED = 42
PIECE = 1 << 20
MAX_GROUP = 16_384
#: Groups up to this size are compared by lags of the sorted rows, larger ones by search.
LAG_GROUP = 256
_BYTE_OFFSET = np.arange(8) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ----------------------------------------------------------


def _word_pieces(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()  # bytes.split() cuts at the six ASCII white-space characters
        at = end


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    ones, n, carry = np.zeros(64, dtype=np.int64), 0, []
    for piece in _word_pieces(text.encode().lower()):  # bytes.lower() changes A-Z only
        words = carry + piece
        if len(words) >= k:
            hashes = _hashes(words, k)
            # How often each value stands at each byte, times the bits of the values.
            places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET
            ones += (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
            n += len(hashes)
            words = words[len(words) - k + 1 :]
        carry = words
    if n == 0 and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint_column(text: Column, k: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        out = np.array([fingerprint(t.as_py() or "", k) for t in texts], dtype=np.uint64)
        return pa.array(out.view(np.int64))

    return run(text)


# --- bit-sliced comparison -------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane b holds bit b of 64 fingerprints a word."""
    n = len(fps)
    padded = np.zeros((n + 63) // 64 * 64, dtype=np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and the carry planes of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (planes, lowest first) is above the radius."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for b in range(len(counter) - 1, -1, -1):
        if radius >> b & 1:
            equal &= counter[b]
        else:
            above |= equal & counter[b]
            equal &= ~counter[b]
    return above


def within(a: np.ndarray, b: np.ndarray | int, n: int, radius: int) -> np.ndarray:
    """Which of n lanes differ in at most ``radius`` bits. ``b`` is a second
    set of planes or one fingerprint for all lanes."""
    one = not isinstance(b, np.ndarray)
    alive = np.arange(a.shape[1])
    counter = [np.zeros(a.shape[1], dtype=np.uint64) for _ in range(7)]
    beyond = np.zeros(a.shape[1], dtype=np.uint64)
    for first in range(0, 64, 8):
        part = a[first : first + 8] if len(alive) == a.shape[1] else a[first : first + 8, alive]
        if one:
            flip = [np.uint64(0xFFFFFFFFFFFFFFFF if b >> (first + i) & 1 else 0) for i in range(8)]
            d = [part[i] ^ flip[i] for i in range(8)]
        else:
            d = part ^ (b[first : first + 8] if len(alive) == a.shape[1] else b[first : first + 8, alive])
        ones, twos, fours, *high = counter
        ones, t0 = _add(ones, d[0], d[1])
        ones, t1 = _add(ones, d[2], d[3])
        twos, f0 = _add(twos, t0, t1)
        ones, t0 = _add(ones, d[4], d[5])
        ones, t1 = _add(ones, d[6], d[7])
        twos, f1 = _add(twos, t0, t1)
        fours, carry = _add(fours, f0, f1)
        for i, h in enumerate(high):
            high[i], carry = h ^ carry, h & carry
        counter = [ones, twos, fours, *high]
        beyond = _beyond(counter, radius)
        left = beyond != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not left.all():  # abandon the words without a lane inside the radius
            alive, beyond, counter = alive[left], beyond[left], [c[left] for c in counter]
            if not len(alive):
                return np.zeros(n, dtype=bool)
    out = np.zeros(a.shape[1], dtype=np.uint64)
    out[alive] = ~beyond
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:n].astype(bool)


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each index reaches through the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        for side in (label[i], label[j]):
            np.minimum.at(label, side, low)
        label = label[label]
        while (label[label] != label).any():
            label = label[label]


def _by_lag(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside small groups of rows that stand together."""
    left, right, lag = [], [], 1
    rows = np.arange(len(fps))
    while len(rows) > lag:
        same = np.flatnonzero(group[rows[:-lag]] == group[rows[lag:]])
        if not len(same):
            break
        i, j = rows[same], rows[same + lag]
        near = within(planes(fps[i]), planes(fps[j]), len(i), radius)
        left.append(i[near])
        right.append(j[near])
        lag += 1
        if lag % 16 == 0:  # leave out the groups that have no pair at this lag
            rows = rows[np.bincount(group[rows], minlength=group[-1] + 1)[group[rows]] > lag]
    return np.concatenate([*left, rows[:0]]), np.concatenate([*right, rows[:0]])


def _by_search(fps: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index each index of one group reaches, level by level from
    seeds; only nodes not reached yet are looked at."""
    label = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            if len(front) <= len(left):
                sliced = planes(fps[left])
                for x in fps[front].tolist():
                    near |= within(sliced, x, len(left), radius)
            else:
                sliced = planes(fps[front])
                for at, x in enumerate(fps[left].tolist()):
                    near[at] = within(sliced, x, len(front), radius).any()
            front, left = left[near], left[~near]
            label[front] = root
    return label


def link_groups(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint reached in its group). Rows of
    a group stand together in rising order of the fingerprint."""
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    label = np.arange(len(fps))
    small = np.flatnonzero((size[group] <= LAG_GROUP) & (size[group] > 1))
    if len(small):
        i, j = _by_lag(fps[small], group[small], radius)
        label[small] = small[_smallest(len(small), i, j)]
    for g in np.flatnonzero(size > LAG_GROUP):
        rows = np.flatnonzero(group == g)
        label[rows] = rows[_by_search(fps[rows], radius)]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table) -> pa.RecordBatch:
            keys = np.stack([rows.column(c).to_numpy() for c in ("key", "part", "other")])
            changes = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            a, b = link_groups(rows.column("fp").to_numpy().view(np.uint64), changes, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = [rows.column(c).to_numpy() for c in ("key", "part", "other")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group of the batch begins
            if first or (held and any(h.column(c)[0] != rows.column(c)[0] for h in held[-1:] for c in ("key", "part", "other"))):
                done = pa.concat_tables([*held, rows.slice(0, first)])
                held = []
                if done.num_rows:
                    yield links(done)
            held.append(rows.slice(first))
        if held:
            yield links(pa.concat_tables(held))

    return run


def block_keys(fp: Column, radius: int) -> Column:
    """The keys of a fingerprint: one for each two of its radius + 2 blocks."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])
    ]
    pairs = list(itertools.combinations(range(radius + 2), 2))
    keys = []
    for at, (i, j) in enumerate(pairs):
        width = edges[j + 1] - edges[j]
        keys.append((F.shiftleft(blocks[i], width) + blocks[j]) * F.lit(len(pairs)) + F.lit(at))
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = RADIUS, max_group: int = MAX_GROUP) -> DataFrame:
    """(fp) distinct -> links (a, b), a > b, that connect what the radius connects."""
    if not 0 <= radius <= 30:
        raise ValueError("the radius must be 0 to 30")
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    large = materialize(keyed.groupBy("key").count().where(F.col("count") > max_group), "simhash-large-keys")
    parts = F.ceil(F.coalesce("count", F.lit(1)) / max_group).cast("int")
    dealt = keyed.join(broadcast_if_small(large), "key", "left").select("fp", "key", parts.alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).select(
        "fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    )
    tasks = dealt.select("key", F.least("own", "with").alias("part"), F.greatest("own", "with").alias("other"), "fp")
    tasks = tasks.repartition("key", "part", "other").sortWithinPartitions("key", "part", "other", "fp")
    return tasks.mapInArrow(_link_batches(radius), "a bigint, b bigint")


# --- components ------------------------------------------------------------


def star_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root) for every node that has a smaller root."""
    step = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    step = materialize(step, "components")
    # The minima are written, so that both sides of a join are plain shuffles,
    # of which the hot partitions (hubs) are split at run time.
    while not _is_forest_of_stars(step):
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("low")), "components")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = materialize(large.distinct(), "components")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "components")
        small = large.join(least, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step = materialize(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "components")
    return step.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_forest_of_stars(step: DataFrame) -> bool:
    ends = step.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        step.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, max_group: int) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) of every document."""
    text = text_or_empty(docs[f"`{text_col}`"])
    fps = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text, shingle).alias("fp")
    )
    fps = materialize(fps, "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = star_components(materialize(links(nodes.select("fp"), radius, max_group), "links"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    component = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = rooted.join(component, "root").select("fp", "component_id", "root")
    return fps.join(of_node, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the
    smallest id of the documents it is linked with)."""
    return _members(docs, id_col, text_col, shingle, radius, max_group).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest id (rows without
    an id last; of texts under one id, that with the smallest hash)."""
    found = materialize(_members(docs, id_col, text_col, shingle, radius, MAX_GROUP), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    stays = materialize(found.groupBy("root").agg(F.min(order).alias("stays")), "near-duplicates-stay")
    found = found.join(stays, "root").withColumn("here", order.eqNullSafe(F.col("stays")))
    leaves = materialize(found.where("not here").select("doc_id", "text_hash").distinct(), "leaves")
    id_, hash_ = docs[f"`{id_col}`"], F.xxhash64(text_or_empty(docs[f"`{text_col}`"]))
    leaves = broadcast_if_small(leaves)
    kept = docs.join(leaves, id_.eqNullSafe(leaves["doc_id"]) & (hash_ == leaves["text_hash"]), "left_anti")
    # Rows are only dealt out again where a kept one repeats as a whole.
    if found.where("here").groupBy("root").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
