"""Benchmark decontamination: SimHash over item-sized windows.

Words are runs of ASCII letters and digits and of characters beyond ASCII,
A-Z lower-cased. For an item of n words:

1. Windows. A passage of similarity 0.8 lacks at most a ninth of the item's
   n - 4 shingles (a fifth if the document ends inside it), and each place
   edited inside costs four or more, so a run of ``clean_run`` words of the item
   stays whole. The stride s is a power of two
   near a sixth of that run and the window the largest multiple of s with
   window + s - 1 <= the run, so the run holds, wherever it begins, a whole
   window of the document's grid, at distance 0. The item is fingerprinted at every offset, so that window's fingerprint is
   among them. Items of equal window size share one pass; sums of words are
   kept per stride and a window is the difference of two prefix sums.
2. Multi-index Hamming search. A fingerprint has four blocks of 16 bits;
   within ``radius`` bits at least one block differs in at most radius // 4
   bits. All block values that near are stored per block, so a look-up of the
   four blocks meets every item fingerprint within the radius.
3. Verification. A candidate aligns item and document; the windows of n words
   there and a few words either way are compared by the weighted Jaccard of
   their shingles of five words (weight: occurrences). From 0.8 on the
   document is contaminated.

Items go to the tasks in blocks of about ``max_items`` and ``MAX_CHARS``; each block is a further pass
over the documents, so a benchmark of any size is compared in whole.

Edge cases: a null or empty text has no hits; items of fewer than five words
have no shingle and match nothing; equal items are all reported; null item
texts are ignored; repeated rows are treated alike; of places of equal similarity the
first is reported; documents are scanned
whole, in pieces if long; other columns are kept and cannot clash; empty
tables give no hits.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 7
MAX_ITEMS = 50_000
MAX_CHARS = 5_000_000  # of the items of a block: each word may begin a window
PIECE = 1 << 20
SEGMENT = 1 << 15
BATCH = 1 << 21
HIT_TYPE = "array<struct<item_id:bigint,start:bigint,similarity:double>>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("similarity", pa.float64())]))
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_MUL2 = np.uint64(0x94D049BB133111EB)


def _byte_table() -> np.ndarray:
    """0 for separators, else the lower-cased byte."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table


_BYTES = _byte_table()


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = 0x100000001B3
    factors = np.ones((2, 2 * PIECE + 1), dtype=np.uint64)
    factors[:, 1:] = np.array([[base], [pow(base, -1, 1 << 64)]], dtype=np.uint64)
    return tuple(np.cumprod(factors, axis=1, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MUL
    h = (h ^ (h >> np.uint64(27))) * _MUL2
    return h ^ (h >> np.uint64(31))


def _hash_piece(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word: the difference of two prefix sums of
    the weighted bytes, brought back to the word's own beginning."""
    power, inverse = _powers()
    byte = _BYTES[piece]
    inside = np.zeros(len(byte) + 2, dtype=bool)
    np.greater(byte, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    sums = np.zeros(len(byte) + 1, dtype=np.uint64)
    np.cumsum(byte * power[: len(byte)], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverse[first]), first


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text in UTF-8, a 64-bit hash of each of its words."""
    data = b"\n".join(texts)
    hashes, firsts, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        cut = _SEPARATOR.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        if end - at > 2 * PIECE:  # a word longer than a piece is cut, alike wherever it stands
            end = at + 2 * PIECE
        found, first = _hash_piece(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at))
        hashes.append(found)
        firsts.append(first + at)
        at = end
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), ends[:-1]))


def clean_run(n: int, similarity: float = SIMILARITY) -> int:
    """Words of an item of n words that stand together unchanged in any passage
    of the similarity, also where the document ends inside the passage."""
    size = max(1, n - SHINGLE + 1)
    runs = []
    for absent in range(size):  # shingles beyond the document's end
        common = math.ceil((2 * size - absent) * similarity / (1 + similarity) - 1e-9)
        if common <= size - absent:
            gaps = (size - absent - common) // (SHINGLE - 1)
            runs.append(-(-common // (gaps + 1)))
    return min(runs, default=size) + SHINGLE - 1


@lru_cache(maxsize=4096)
def window_of(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(window, stride) in words for an item of n words."""
    run = clean_run(n, similarity)
    stride = 1 << max(0, run.bit_length() - 3)
    return (run - stride + 1) // stride * stride, stride


def _steps(hashes: np.ndarray, stride: int) -> np.ndarray:
    """Set bits per place in each run of ``stride`` words, as 64 columns."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    n = len(bits) // stride * stride
    steps = bits[:n:stride].astype(np.uint8 if stride < 32 else np.uint32)  # a window has up to seven steps
    for i in range(1, stride):
        steps += bits[i:n:stride]
    return steps


def _windows(steps: np.ndarray, windows: list[int], stride: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each window size, rising, the fingerprint of the windows that begin
    at a multiple of ``stride``: a bit is set when more than half of the
    words' hashes set it."""
    sums, m = steps, 1
    for window in windows:
        while m < window // stride:
            m += 1
            sums = sums[:-1] + steps[m - 1 :] if len(steps) >= m else steps[:0]
        yield window, np.packbits(sums > window // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """The fingerprints of the windows at every word."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 64), dtype=np.int64), np.cumsum(ones, axis=0, dtype=np.int64)))
    more = sums[window:] - sums[:-window] > window // 2
    return np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of five words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out = mix(out * _MUL2 + hashes[i : i + n])
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles: sum of the smaller over sum of the larger counts."""
    if not len(a) or not len(b):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


@lru_cache(maxsize=4)
def _flips(distance: int) -> np.ndarray:
    """All 16-bit masks with at most ``distance`` bits."""
    masks = [sum(1 << b for b in bits) for d in range(distance + 1) for bits in itertools.combinations(range(16), d)]
    return np.array(masks, dtype=np.int64)


class Index:
    """The fingerprints of the items, by window size and block value."""

    def __init__(self, items: list[tuple[int, str]], radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.items, grouped = [], defaultdict(list)
        for (item_id, _), hashes in zip(items, word_hashes([text.encode() for _, text in items]) if items else []):
            if len(hashes) < SHINGLE:
                continue
            window, stride = window_of(len(hashes), similarity)
            grouped[window, stride].append(len(self.items))
            self.items.append((item_id, len(hashes), shingles(hashes), hashes))
        self.sets = [frozenset(x[2].tolist()) for x in self.items]
        self.classes = {key: self._tables(key, numbers) for key, numbers in grouped.items()}

    def _tables(self, key: tuple[int, int], numbers: list[int]):
        window, _ = key
        fps, item, offset = [], [], []
        for number in numbers:
            own = fingerprints(self.items[number][3], window)
            fps.append(own)
            item += [number] * len(own)
            offset += range(len(own))
        fps = np.concatenate(fps)
        blocks = []
        for b in range(4):
            value = (fps >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
            near = (value[:, None] ^ _flips(self.radius // 4)[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            count = np.bincount(near, minlength=1 << 16)
            start = np.concatenate(([0], np.cumsum(count)))[:-1]
            blocks.append((count > 0, count, start, np.repeat(np.arange(len(fps)), len(_flips(self.radius // 4)))[order]))
        return fps, np.array(item), np.array(offset), blocks

    def _segments(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of about ``SEGMENT`` words: the hashes and, as columns, the
        text, its first word there, where that stands and where it ends. Every
        piece begins at a multiple of the largest stride of the batch and of
        its text, so the windows of a text do not depend on its neighbours;
        pieces of a long text overlap by the largest window."""
        grid = max(stride for _, stride in self.classes)
        overlap = max(window for window, _ in self.classes)
        step = max(1, SEGMENT // grid) * grid
        held, places, at = [], [], 0
        for number, hashes in enumerate(texts):
            for first in range(0, max(1, len(hashes) - overlap + 1), step):
                piece = hashes[first : first + step + overlap]
                held += [piece, np.zeros(-len(piece) % grid, dtype=np.uint64)]
                places.append((number, first, at, at + len(piece)))
                at += len(piece) + len(held[-1])
                if at >= SEGMENT:
                    yield np.concatenate(held), np.array(places)
                    held, places, at = [], [], 0
        if at:
            yield np.concatenate(held), np.array(places)

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int, int]]:
        """(text, item number, word the item would begin at) within the radius."""
        out: set[tuple[int, int, int]] = set()
        for hashes, places in self._segments(texts) if self.classes else ():
            for stride in sorted({s for _, s in self.classes}):
                sizes = sorted(w for w, s in self.classes if s == stride)
                for window, own in _windows(_steps(hashes, stride), sizes, stride):
                    for at, fp in self._near(own, *self.classes[window, stride][::3]):
                        _, item, offset, _ = self.classes[window, stride]
                        begin = at * stride
                        place = np.searchsorted(places[:, 2], begin, side="right") - 1
                        inside = begin + window <= places[place, 3]  # not across two texts
                        first = places[place, 1] + begin - places[place, 2] - offset[fp]
                        out.update(zip(places[place, 0][inside].tolist(), item[fp][inside].tolist(), first[inside].tolist()))
        return out

    def _near(self, own: np.ndarray, fps: np.ndarray, blocks: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window, item fingerprint) within the radius, by block."""
        values = own.view(np.uint16).reshape(-1, 4)  # little-endian: column b holds bits 16 b and up
        for b, (held, count, start, entry) in enumerate(blocks):
            value = np.ascontiguousarray(values[:, b])
            met = np.flatnonzero(held[value])
            if not len(met):
                continue
            n = count[value[met]]
            which = np.repeat(met, n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            fp = entry[np.repeat(start[value[met]], n) + nth]
            near = np.flatnonzero(np.bitwise_count(own[which] ^ fps[fp]) <= self.radius)
            if len(near):
                yield which[near], fp[near]

    def hits(self, texts: list[str]) -> list[list[dict]]:
        """Per text the best match of each item from the threshold on."""
        hashes = word_hashes([t.encode() for t in texts]) if texts else []
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for text, of_text in itertools.groupby(sorted(self.candidates(hashes)), key=lambda c: c[0]):
            own, found = shingles(hashes[text]), best[text]
            for _, number, begin in of_text:
                if number in found and found[number][0] == 1.0:
                    continue
                _, n, wanted, _ = self.items[number]
                size, slack = n - SHINGLE + 1, max(2, n // 8)
                low, high = max(0, begin - slack), min(begin + slack, len(own) - 1)
                if high < low or sum(map(self.sets[number].__contains__, own[low : high + size].tolist())) < self.similarity * size:
                    continue  # not enough of the item's shingles around there
                for at in sorted(range(low, high + 1), key=lambda a: (abs(a - begin), a)):
                    share = weighted_jaccard(own[at : at + size], wanted)
                    if share >= self.similarity and (number not in found or (share, -at) > (found[number][0], -found[number][1])):
                        found[number] = (share, at)
                    if share == 1.0:
                        break
        return [
            [{"item_id": self.items[k][0], "start": at, "similarity": s} for k, (s, at) in sorted(found.items())] for found in best
        ]


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...], radius: int, similarity: float) -> Index:
    return Index(list(items), radius, similarity)


def _hit_column(text: Column, items: list[tuple[int, str]], radius: int, similarity: float) -> Column:
    held = tuple(items)

    @F.arrow_udf(HIT_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        index = _index(held, radius, similarity)
        hits, waiting, size = [], [], 0
        for text in texts:  # a few MB of text at a time
            waiting.append(text.as_py())
            size += len(waiting[-1])
            if size >= BATCH:
                hits += index.hits(waiting)
                waiting, size = [], 0
        return pa.array(hits + index.hits(waiting), _HIT_ARROW)

    return run(text)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    radius: int = RADIUS, similarity: float = SIMILARITY, max_items: int = MAX_ITEMS,
) -> Column:
    """A column for ``docs``: the items each text repeats, as (item_id, start,
    similarity). The items go to the tasks in blocks of about ``max_items``."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where(
        F.col("text").isNotNull()
    ).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-size.n // max_items), -(-size.chars // MAX_CHARS))
    text = text_or_empty(docs[f"`{text_col}`"])
    parts = []
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts.append(_hit_column(text, rows, radius, similarity))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that repeat no benchmark item."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), benchmark_hits(docs, benchmark, text_col).alias("hits"))
    return rows.where(F.size("hits") == 0).select("doc.*")
