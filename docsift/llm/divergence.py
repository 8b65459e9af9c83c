"""Source divergence audit by single-pass in-memory indexing.

1. Each task reads its documents once into a block: an entry for each term of
   a document. When the block holds ``BLOCK_ENTRIES`` entries (and at the end)
   they are summed to postings (term, language and source, count, documents)
   and spilled as a run: its terms are dealt out to shards by hash, each
   shard's part a term-sorted row.
2. A shard merges its runs with a heap, term by term, into frequencies; terms
   of fewer than ``min_docs`` documents go. A common term is one posting a
   source in each run, whatever its count.
3. Smoothed probabilities are integers, p = 1 + floor(SCALE * (count + 1) / (N + V)).
   The divergence of two sources, f = floor((p - q)^2 / q) over all V kept terms,
   starts from the value that all terms would give if both sources lacked them;
   the frequencies are streamed once and each task sums corrections: one for
   the terms one source has, one for the terms that both have. No row per term
   and pair of sources is made, and a task holds a square of at most ``TILE``
   sources at a time.
4. The terms that a source uses most above its language are ranked per source;
   Spark limits each task's rows before they are shuffled.

A count of 10^13 is exact: floor(SCALE * x / y) is a long division with digits
of 1,000, and everything else fits in 63 bits while N + V < 9 * 10^15.

The tasks of step 3 know each group's N (one row a source and language). That
table's square is the size of the result; above ``MAX_GROUPS`` the operator
refuses to run.

Edge cases: a null text, language or source is the empty string; groups
without terms take part (N = 0); a language without kept terms gives pairs of
value 0 and no terms; an empty table gives an empty result; very long texts
are read in pieces, and a repeated row counts each time; ties go by the item
in byte order; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty
from docsift.operators.sizing import broadcast_if_small

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
BLOCK_ENTRIES = 1 << 22
#: Postings that a task of step 3 holds before it turns them into corrections.
HELD_POSTINGS = 4_000_000
MAX_GROUPS = 1_000_000
TILE = 1024
PIECE = 1 << 20
#: Bytes of a term: letters and all bytes of characters beyond ASCII; the rest separates.
_TABLE = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b >= 0x80 else 0x20 for b in range(256)
)
RUN_SCHEMA = (
    "shard int, terms array<binary>, sizes array<int>, groups array<int>, counts array<bigint>, docs array<bigint>, "
    "langs array<string>, sources array<string>"
)
FREQUENCY_SCHEMA = "lang string, term string, total bigint, sources array<string>, counts array<bigint>"


# --- runs ------------------------------------------------------------------


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data, at = text.encode().translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _edges(changes: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(changes[1:] != changes[:-1]) + 1, [len(changes)]))


class Block:
    """The terms of the documents seen since the last spill, numbered."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.groups: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []  # group << 32 | term, once a document
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str, lang: str, source: str) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        ids = [np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms)) for terms in term_lists(text)]
        if ids:
            key, count = np.unique(np.concatenate(ids), return_counts=True)
            self.keys.append(key | group << 32)
            self.counts.append(count)
            self.held += len(key)

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """A row for each shard: its terms in order, and their postings by term."""
        if not self.held:
            return
        key = np.concatenate(self.keys)
        order = np.argsort(key, kind="stable")
        first = _edges(key[order])
        counts = np.add.reduceat(np.concatenate(self.counts)[order], first[:-1])
        docs, key = np.diff(first), key[order][first[:-1]]
        group, term = key >> 32, key & 0xFFFFFFFF
        terms = pa.array(list(self.number), pa.binary())
        rank = np.empty(len(terms), np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        shard = np.fromiter((xxhash.xxh64_intdigest(t) % shards for t in self.number), np.int64, len(terms))
        postings = np.lexsort((group, rank[term], shard[term]))
        by_shard = np.lexsort((rank, shard))
        sizes = np.bincount(term, minlength=len(terms))[by_shard]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        langs, sources = zip(*self.groups)
        edges = _edges(shard[by_shard])
        for lo, hi in zip(edges, edges[1:]):
            own = postings[starts[lo] : starts[hi]]
            row = [
                [shard[by_shard[lo]]], [terms.take(pa.array(by_shard[lo:hi]))], [sizes[lo:hi]], [group[own]], [counts[own]],
                [docs[own]], [langs], [sources],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _RUN)], schema=_RUN)


_RUN = pa.schema([
    ("shard", pa.int32()), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("groups", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
])


def _spill_runs(shards: int, block_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for rows in batches:
            for text, lang, source in zip(*rows.columns):
                block.add(text.as_py(), lang.as_py(), source.as_py())
                if block.held >= block_entries:
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    return run


# --- merge -----------------------------------------------------------------


class Shard:
    """The runs of a shard, merged by a heap over their terms."""

    def __init__(self, runs: list[pa.RecordBatch]) -> None:
        lists = lambda name: [r.column(name)[0].values for r in runs]
        whole = lambda name: np.concatenate([x.to_numpy() for x in lists(name)]).astype(np.int64)
        self.terms = lists("terms")
        self.first = np.concatenate(([0], np.cumsum([len(t) for t in self.terms])))  # of each run, among all runs' terms
        self.sizes, self.counts, self.docs = whole("sizes"), whole("counts"), whole("docs")
        self.starts = np.cumsum(self.sizes) - self.sizes
        known: dict[tuple[str, str], int] = {}
        names = [list(zip(a.to_pylist(), b.to_pylist())) for a, b in zip(lists("langs"), lists("sources"))]
        self.groups = np.concatenate([
            np.array([known.setdefault(n, len(known)) for n in own])[g.to_numpy()] for own, g in zip(names, lists("groups"))
        ])
        # Groups numbered by language and source, so that sorting by number sorts by both.
        order = sorted(known)
        renumber = np.empty(len(known), np.int64)
        renumber[[known[n] for n in order]] = np.arange(len(known))
        self.groups = renumber[self.groups]
        self.langs = [lang for lang, _ in order]
        self.sources = pa.array([source for _, source in order], pa.string())
        self.lang_of = np.cumsum([0] + [a != b for a, b in zip(self.langs, self.langs[1:])])

    def _run(self, number: int) -> Iterator[tuple[bytes, int, int]]:
        for at in range(0, len(self.terms[number]), 1024):
            for i, term in enumerate(self.terms[number].slice(at, 1024).to_pylist(), at):
                yield term, number, i

    def merged(self, min_docs: int, chunk: int = 8192) -> Iterator[pa.RecordBatch]:
        terms, number, at = [], [], []
        for term, run, i in heapq.merge(*(self._run(r) for r in range(len(self.terms)))):
            if not terms or term != terms[-1]:
                if len(at) >= chunk:
                    yield self._frequencies(terms, number, at, min_docs)
                    terms, number, at = [], [], []
                terms.append(term)
            number.append(len(terms) - 1)
            at.append(self.first[run] + i)
        if terms:
            yield self._frequencies(terms, number, at, min_docs)

    def _frequencies(self, terms: list[bytes], number: list[int], at: list[int], min_docs: int) -> pa.RecordBatch:
        """Postings of equal term and group summed; terms that enough documents of a language hold."""
        size = self.sizes[at]
        ends = np.cumsum(size)
        postings = np.repeat(self.starts[at] - (ends - size), size) + np.arange(ends[-1])
        key = np.repeat(number, size) * len(self.langs) + self.groups[postings]
        order = np.argsort(key, kind="stable")
        first = _edges(key[order])[:-1]
        counts = np.add.reduceat(self.counts[postings][order], first)
        docs = np.add.reduceat(self.docs[postings][order], first)
        key = key[order][first]
        term, group = np.divmod(key, len(self.langs))
        lang = self.lang_of[group]
        row = _edges(term * len(self.langs) + lang)  # postings of a row (term, language) stand together
        kept = np.add.reduceat(docs, row[:-1]) >= min_docs
        inside = np.repeat(kept, np.diff(row))
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.diff(row)[kept]))), pa.int32())
        lead = row[:-1][kept]
        columns = [
            pa.array([self.langs[g] for g in group[lead]], pa.string()),
            pa.array([terms[t].decode() for t in term[lead]], pa.string()),
            pa.array(np.add.reduceat(counts, row[:-1])[kept], pa.int64()),
            pa.ListArray.from_arrays(offsets, self.sources.take(pa.array(group[inside]))),
            pa.ListArray.from_arrays(offsets, pa.array(counts[inside], pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "total", "sources", "counts"])


def _merge_shards(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []  # the rows of a shard stand together
        for batch in batches:
            for row in range(batch.num_rows):
                if held and batch.column(0)[row].as_py() != shard:
                    yield from Shard(held).merged(min_docs)
                    held = []
                shard = batch.column(0)[row].as_py()
                held.append(batch.slice(row, 1))
        if held:
            yield from Shard(held).merged(min_docs)

    return run


def frequencies(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
    block_entries: int = BLOCK_ENTRIES, shards: int | None = None,
) -> DataFrame:
    """One row for each term of a language that ``min_docs`` of its documents hold."""
    shards = shards or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = zip(("text", "lang", "source"), (text_col, lang_col, source_col))
    rows = docs.select(*[text_or_empty(docs[f"`{c}`"]).alias(name) for name, c in named])
    runs = rows.mapInArrow(_spill_runs(shards, block_entries), RUN_SCHEMA)
    return runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge_shards(min_docs), FREQUENCY_SCHEMA)


# --- pairs -----------------------------------------------------------------


def scaled(x: np.ndarray, y: int) -> np.ndarray:
    """floor(SCALE * x / y) for x <= y < 9 * 10^15, without a product beyond 63 bits."""
    whole, rest = np.divmod(np.asarray(x, np.int64), y)
    for _ in range(3):  # SCALE is 1,000^3
        digit, rest = np.divmod(rest * 1000, y)
        whole = whole * 1000 + digit
    return whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tile_corrections(size: int, totals: np.ndarray, kept: int, rows: np.ndarray, at: np.ndarray, counts: np.ndarray,
                     left: slice, right: slice) -> np.ndarray:
    """What the postings (row of a term, source, count) add to the value of
    each pair (source in ``left``, source in ``right``) over that of absent terms."""
    absent = np.array([1 + scaled(1, n + kept) for n in totals])
    p = np.empty(len(at), np.int64)
    for s in np.unique(at):
        mine = at == s
        p[mine] = 1 + scaled(counts[mine] + 1, int(totals[s]) + kept)
    own = [np.flatnonzero(at == s) for s in range(size)]
    a, b = range(size)[left], range(size)[right]
    out = np.zeros((len(a), len(b)), np.int64)
    value = np.zeros(rows.max() + 1 if len(rows) else 0, np.int64)
    for j, t in enumerate(b):
        value[rows[own[t]]] = p[own[t]]
        q0 = absent[t]
        for i, s in enumerate(a):
            if s == t:
                continue
            p0, base = absent[s], divergence(absent[s], q0)
            ps, pt = p[own[s]], p[own[t]]
            both = value[rows[own[s]]]
            here = both > 0
            out[i, j] = (divergence(ps, q0) - base).sum() + (divergence(p0, pt) - base).sum()
            ps, qs = ps[here], both[here]
            out[i, j] += (divergence(ps, qs) - divergence(ps, q0) - divergence(p0, qs) + base).sum()
        value[rows[own[t]]] = 0
    return out


def _pair_batches(groups: dict[str, tuple[list[str], list[int], int]], tile: int):
    names = ["lang", "source", "item", "correction"]

    number = {lang: {s: i for i, s in enumerate(sources)} for lang, (sources, _, _) in groups.items()}

    def corrections(held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            rows, at, n = (np.concatenate(x) for x in zip(*parts))
            sources, totals, kept = groups[lang]
            for lo, other in itertools.product(range(0, len(sources), tile), repeat=2):
                left, right = slice(lo, lo + tile), slice(other, other + tile)
                found = tile_corrections(len(sources), np.array(totals, np.int64), kept, rows, at, n, left, right)
                i, j = np.nonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(i), pa.string()), pa.array([sources[lo + x] for x in i], pa.string()),
                        pa.array([sources[other + x] for x in j], pa.string()), pa.array(found[i, j], pa.int64()),
                    ],
                    names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms, size = defaultdict(list), Counter(), 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            sources, counts = batch.column(3), batch.column(4)
            for lang in set(langs):
                mine = [i for i, x in enumerate(langs) if x == lang]
                each = sources.take(pa.array(mine))
                sizes = each.value_lengths().to_numpy(zero_copy_only=False)
                at = np.array([number[lang][s] for s in each.flatten().to_pylist()], np.int64)
                n = counts.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                held[lang].append((np.repeat(np.arange(len(mine)) + terms[lang], sizes), at, n))
                terms[lang] += len(mine)
                size += len(at)
            if size >= HELD_POSTINGS:
                yield from corrections(held)
                held, terms, size = defaultdict(list), Counter(), 0
        yield from corrections(held)

    return run


def _scaled(x, y):
    """1 + floor(SCALE * x / y) in SQL, exact for 18 digits."""
    return F.expr(f"1 + CAST((CAST({x} AS DECIMAL(18,0)) * CAST({SCALE} AS DECIMAL(10,0))) DIV CAST({y} AS DECIMAL(18,0)) AS BIGINT)")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES, tile: int = TILE,
) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value, rank."""
    spark = docs.sparkSession
    freq = materialize(frequencies(docs, text_col, lang_col, source_col, min_docs, block_entries), "frequencies")
    occurring = docs.select(
        text_or_empty(docs[f"`{lang_col}`"]).alias("lang"), text_or_empty(docs[f"`{source_col}`"]).alias("source")
    ).distinct()
    postings = freq.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")
    )
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    of_lang = freq.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("kept"))
    groups = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = materialize(groups.na.fill(0), "groups")
    if groups.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups of language and source")
    known: dict[str, tuple[list[str], list[int], int]] = {}
    for g in groups.orderBy("lang", "source").collect():  # at most MAX_GROUPS narrow rows
        sources, totals, _ = known.setdefault(g["lang"], ([], [], g["kept"]))
        sources.append(g["source"])
        totals.append(g["group_n"])
    corrections = freq.mapInArrow(
        _pair_batches(known, tile), "lang string, source string, item string, correction bigint"
    ).groupBy("lang", "source", "item").agg(F.sum("correction").alias("correction"))

    # The value of a pair whose sources have none of the terms.
    one = groups.select("lang", "source", "kept", F.when(F.col("kept") > 0, _scaled(1, "group_n + kept")).alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.when(F.col("kept") > 0, _scaled(1, "group_n + kept")).alias("q"))
    pairs = one.join(two, "lang").where(F.col("source") != F.col("item")).join(corrections, ["lang", "source", "item"], "left")
    base = F.coalesce(F.col("kept") * F.expr("((p - q) * (p - q)) DIV q"), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("correction", F.lit(0))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    terms = postings.join(broadcast_if_small(groups), ["lang", "source"])
    terms = terms.withColumn("p", _scaled("n + 1", "group_n + kept")).withColumn("q", _scaled("total + 1", "lang_n + kept"))
    terms = terms.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) DIV q").alias("value")
    )
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
