"""Phrase collocations by top-order marginalisation.

1. Texts are cut in pieces and words. Every word opens one window: the word and
   its next ``longest - 1`` words as lead columns, padded where the piece ends.
   Only these longest windows are counted. A task numbers its words, counts the
   windows of about ``FLUSH_WORDS`` words with numpy and emits each distinct one
   once, words as 64-bit hashes.
2. Windows are summed over all tasks. A window seen fewer than ``min_count``
   times is no candidate: its last word is folded into the padding, then the
   next one if the shorter prefix is rare too. Folding moves counts to a
   shorter window and loses none, so every prefix that stays is summed exactly.
3. Spark's ROLLUP over the window columns sums the successively shorter
   prefixes: a phrase of j words is the prefix of the windows at its
   occurrences. The level of the language alone gives all word occurrences.
4. Candidates are cut at each place and scored by joins on the prefix counts,
   in decimal arithmetic; phrases inside a longer candidate that is frequent
   enough go; the first ``top`` of each language are ranked.

Hot words and phrases are counted inside a task before they are shuffled, and
windows are dealt out by their leading words together, so one common word or
pair is no hot key. Hashes of two words that meet are found in the dictionary
that the same pass emits, and the count is repeated with another seed.

Edge cases: a null text has no words; a null language is ``und``; an empty
table, or one without a frequent phrase, gives an empty result; repeated rows
count each time; very long texts are read in pieces; ties in score and count
go by the phrase in byte order; other columns are ignored.
"""

from __future__ import annotations

import itertools
import string
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty

LONGEST = 3
MIN_COUNT = 10
SUBSUMED_PERCENT = 50
TOP = 2000
UNKNOWN_LANG = "und"
#: Words that a task holds before it emits their windows: the more, the fewer windows are emitted twice.
FLUSH_WORDS = 1 << 22
PIECE = 1 << 20
#: Characters that end a piece; all of them become one mark, a word of its own.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"."
_TABLE = bytes.maketrans(
    string.ascii_uppercase.encode() + _ENDS + b"\t", string.ascii_lowercase.encode() + b"\n" * len(_ENDS) + b" "
)


def word_runs(text: str) -> Iterator[list[bytes]]:
    """The words of a text with ``_MARK`` at the ends of pieces, in bounded lists."""
    data, at = text.encode().translate(_TABLE), 0
    while at < len(data):
        end = data.find(b"\n", at + PIECE)
        space = data.find(b" ", at + PIECE)
        end = min((x for x in (end, space) if x >= 0), default=len(data))
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end
    yield [_MARK]


def word_hash(word: bytes, seed: int) -> int:
    """Signed 64-bit hash; 0 is the padding."""
    h = xxhash.xxh64_intdigest(word, seed) or 1
    return h - (1 << 64) if h >> 63 else h


class _Block:
    """The words of one language that a task holds, as numbers (0: end of a piece)."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[_MARK]
        self.ids: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def windows(self, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of the distinct padded windows (numbers), and their counts."""
        ids = np.concatenate([*self.ids, np.zeros(longest, np.int32)])
        self.ids.clear()
        columns = [ids[: len(ids) - longest]]
        for lead in range(1, longest):
            columns.append(np.where(columns[-1] == 0, np.int32(0), ids[lead : len(ids) - longest + lead]))
        opens = columns[0] != 0
        columns = [c[opens] for c in columns]
        key, span, base = np.zeros(len(columns[0]), np.int64), 1, len(self.number)
        for c in columns:
            if span * base >= 1 << 63:
                known, key = np.unique(key, return_inverse=True)
                span = len(known)
            key, span = key * base + c, span * base
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return [c[first] for c in columns], counts


def _window_batches(longest: int, seed: int, hash_word: Callable[[bytes, int], int]):
    names = ["lang", *_columns(longest), "word", "n"]

    def batch(lang: str, columns: list[np.ndarray], words: list[bytes] | None, n: np.ndarray) -> pa.RecordBatch:
        size = len(n)
        word = pa.nulls(size, pa.string()) if words is None else pa.array([w.decode() for w in words], pa.string())
        arrays = [pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32))), *map(pa.array, columns), word]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(n.astype(np.int64))], names)

    def flush(blocks: dict[str, _Block]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks.items():
            words = list(block.number)[1:]
            hashes = np.array([0] + [hash_word(w, seed) for w in words], np.int64)
            columns, n = block.windows(longest)
            for at in range(0, len(n), 1 << 16):
                yield batch(lang, [hashes[c[at : at + (1 << 16)]] for c in columns], None, n[at : at + (1 << 16)])
            pads = [np.zeros(len(words), np.int64)] * (longest - 1)
            if words:
                yield batch(lang, [hashes[1:], *pads], words, np.zeros(len(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = defaultdict(_Block)
        held = 0
        for rows in batches:
            for text, lang in zip(rows.column(0), rows.column(1)):
                for words in word_runs(text.as_py()):
                    blocks[lang.as_py()].add(words)
                    held += len(words)
                if held >= FLUSH_WORDS:
                    yield from flush(blocks)
                    blocks, held = defaultdict(_Block), 0
        yield from flush(blocks)

    return run


def _columns(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def folded_windows(
    docs: DataFrame, longest: int, min_count: int, seed: int, text_col: str, lang_col: str,
    hash_word: Callable[[bytes, int], int] = word_hash,
) -> DataFrame:
    """(lang, w1 .. wL, word, n): window counts, rare tails folded into the
    padding, and with n = 0 a row for each word under its hash."""
    w = _columns(longest)
    texts = docs.select(
        text_or_empty(docs[f"`{text_col}`"]).alias("text"), F.coalesce(docs[f"`{lang_col}`"], F.lit(UNKNOWN_LANG)).alias("lang")
    )
    schema = "lang string, " + "".join(f"{c} bigint, " for c in w) + "word string, n bigint"
    windows = texts.mapInArrow(_window_batches(longest, seed, hash_word), schema)
    lead = ["lang", *w[: max(2, longest - 1)]]
    counts = windows.repartition(*lead).groupBy("lang", *w, "word").agg(F.sum("n").alias("n"))
    rare = F.col("n") < min_count
    if longest > 2:  # all windows of a prefix are in one partition
        counts = counts.withColumn("prefix", F.sum("n").over(Window.partitionBy(*lead)))
        counts = counts.withColumn(w[-2], F.when(F.col("prefix") < min_count, 0).otherwise(F.col(w[-2])))
    counts = counts.withColumn(w[-1], F.when(rare, 0).otherwise(F.col(w[-1])))
    return counts.groupBy("lang", *w, "word").agg(F.sum("n").alias("n"))


def phrase_counts(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang",
    hash_word: Callable[[bytes, int], int] = word_hash,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase: array of word hashes, f) of all phrases seen ``min_count``
    times or more; (lang, hash, word); (lang, n)."""
    if longest < 2:
        raise ValueError("phrases have two words or more")
    w = _columns(longest)
    for seed in itertools.count():
        folded = materialize(folded_windows(docs, longest, min_count, seed, text_col, lang_col, hash_word), "windows")
        words = folded.where("word IS NOT NULL").select("lang", F.col("w1").alias("hash"), "word")
        if words.groupBy("lang", "hash").count().where("count > 1").isEmpty():
            break
    sums = folded.where("word IS NULL").rollup("lang", *w).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    sums = materialize(sums.where((F.col("f") >= min_count) | (F.col("level") == (1 << longest) - 1)), "phrases")
    total = sums.where(F.col("level") == (1 << longest) - 1).select("lang", F.col("f").alias("n"))
    # The grouping id has a bit for each column rolled up: j words leave longest - j bits.
    of_length = F.coalesce(*[
        F.when(F.col("level") == (1 << (longest - j)) - 1, F.array(*w[:j])) for j in range(1, longest + 1)
    ])
    phrases = sums.select("lang", of_length.alias("phrase"), "f").where("phrase IS NOT NULL AND NOT array_contains(phrase, 0L)")
    return phrases, words, total


def collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, subsumed_percent: int = SUBSUMED_PERCENT,
    top: int = TOP, text_col: str = "text", lang_col: str = "lang", hash_word: Callable[[bytes, int], int] = word_hash,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a (its
    count), l and r (counts of its parts at the cut that counts), n, score."""
    f, words, total = phrase_counts(docs, longest, min_count, text_col, lang_col, hash_word)
    found = f.where(F.size("phrase") > 1).withColumnRenamed("f", "a")
    # Shorter phrases inside longer candidates.
    size = F.size("phrase")
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice(F.col("phrase"), s, m)),
    ))
    longer = found.where(size > 2).select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = found.join(longer, ["lang", "phrase"], "left")
    found = found.where(F.coalesce(F.col("longer") * 100 < F.col("a") * subsumed_percent, F.lit(True))).drop("longer")
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn(
        "right", F.slice("phrase", F.col("k") + 1, size)
    )
    first = f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"])
    wide = {c: f"CAST({c} AS DECIMAL(18,0))" for c in "alr"}
    score = F.expr(f"({wide['a']} * {wide['a']} * CAST(1000000 AS DECIMAL(7,0))) DIV ({wide['l']} * {wide['r']})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spelt = best.select("*", F.posexplode("phrase").alias("at", "hash")).join(words, ["lang", "hash"])
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    spelt = spelt.groupBy("lang", "phrase", "a", "cut").agg(in_order.alias("words"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "words")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), F.col("words").alias("phrase"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
