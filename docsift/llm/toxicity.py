"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

Features are the hashed n-grams (n in ``SIZES``) of the lower-cased text; a
feature is present or absent in a text. Training:

1. At most ``max_rows`` labelled documents, drawn by a hash of their id, are
   the sample (a bound of the operator, not of the data that it scores).
2. Per feature, the documents of either label that hold it are counted on the
   executors; r = log of the ratio of the smoothed shares.
3. The ``max_features`` features with the largest |r| * sqrt(count) stay.
4. Logistic regression over the r-scaled features of the sample gives the
   weights. The driver holds max_rows rows of feature numbers, no text.

5. Calibration. Each quarter of the sample (by a hash of the text) is scored
   by a model of the other three. The cut is the logit that ``WHOLE_ALARMS`` of
   the clean texts reach there as a whole, that of windows the one that
   ``WINDOW_ALARMS`` of them reach with their best window: toxic texts are few,
   so an unweighted fit puts many of them below 0.

Scoring is one Arrow pass over whole texts, long texts in pieces that overlap
by a window. A text is scored as a whole and in windows of ``WINDOW``
characters, each half over the one before, since the many negative features of
clean prose would outvote a toxic passage. The logit is the larger of the
whole's and the best window's, each less its cut.

Edge cases: a null or empty text has no features and gets the score of the
intercept less the cut, never above 0.5 if there are clean labels; documents of several labels count as toxic if one says so; null
labels are ignored; an id that repeats is one row of the sample, and repeated
rows get equal scores; very long texts are read in pieces; without any label, or without label 1, every score is
the smoothed share of label 1 (0 without labels); labels of unknown documents
are ignored; other columns are kept and cannot clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty

SIZES = (3, 4, 5)
BITS = 18
MAX_ROWS = 8000
MAX_FEATURES = 4096
SMOOTHING = 1.0
RIDGE = 1e-3
STEPS = 400
PIECE = 1 << 20
WINDOW = 1024  # even, in characters; the median labelled text has about 1,400
PARTS = 4
WHOLE_ALARMS, WINDOW_ALARMS = 0.003, 0.001  # a long text has many windows
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _buckets(chars: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the feature number of the n-gram at each character."""
    code = chars.astype(np.uint64)
    rolled = code + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        if len(code) < n:
            return
        rolled = rolled[:-1] * _PRIME + code[n - 1 :] + np.uint64(1)
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _PRIME
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct feature numbers of a text, of those ``wanted`` (a mask)."""
    found = []
    overlap = max(SIZES) - 1
    for at in range(0, max(len(text), 1), PIECE):
        piece = text[at : at + PIECE + overlap].lower()
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for buckets in _buckets(chars):
            found.append(np.unique(buckets if wanted is None else buckets[wanted[buckets]]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Model:
    numbers: np.ndarray
    weights: np.ndarray
    intercept: float
    whole_cut: float = 0.0
    window_cut: float = 0.0

    def table(self) -> np.ndarray:
        """The weight of every feature number."""
        weight = np.zeros(1 << BITS)
        weight[self.numbers] = self.weights
        return weight


def logits(text: str, weight: np.ndarray, intercept: float) -> tuple[float, float]:
    """Logit of the whole text and of its best window."""
    wanted, hop = weight != 0, WINDOW // 2
    held, best = [], []
    for at in range(0, max(len(text) - WINDOW, 1), PIECE):
        piece = text[at : at + PIECE + WINDOW].lower()
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = max(1, -(-len(chars) // hop) - 1)
        if at + PIECE < len(text) - WINDOW:  # the next piece has the others
            n = min(n, PIECE // hop)
        keys = [np.zeros(0, dtype=np.int64)]
        for buckets in _buckets(chars):
            place = np.flatnonzero(wanted[buckets])
            feature, block = buckets[place], place // hop
            for window in (block, block - 1):  # a window is two blocks
                inside = (window >= 0) & (window < n)
                keys.append(window[inside] << BITS | feature[inside])
        keys = np.unique(np.concatenate(keys))
        feature = keys & ((1 << BITS) - 1)
        best.append(np.bincount(keys >> BITS, weight[feature], minlength=n).max())
        held.append(np.unique(feature))
    return float(weight[np.unique(np.concatenate(held))].sum() + intercept), float(max(best) + intercept)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return np.exp(-np.logaddexp(0.0, -x))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    label_id_col: str = "doc_id", max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents: ids without a
    document take no place, and an id that repeats is one row (its smallest text)."""
    ids = docs.select(docs[f"`{id_col}`"].alias("id"))
    per_id = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull())
    per_id = per_id.groupBy(F.col(label_id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = per_id.join(ids.distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), text_or_empty(docs[f"`{text_col}`"]).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id")  # bounded by max_rows
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def part(text: Column) -> Column:
    """The quarter of the sample that a text is in: equal texts are together."""
    return (F.crc32(text) % PARTS).cast("int")


_CELLS = [f"n{c}" for c in range(2 * PARTS)]  # rows of label 0 and 1 by part


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2 * PARTS, 1 << BITS), dtype=np.int32)
    rows = np.zeros(2 * PARTS, dtype=np.int32)
    for batch in batches:
        for text, label, of in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("part").to_pylist()):
            counts[2 * of + label, features(text.as_py())] += 1
            rows[2 * of + label] += 1
    held = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, -1)), *[pa.array(np.append(c[held], r)) for c, r in zip(counts, rows)]], ["feature", *_CELLS]
    )


def _feature_column(text: Column, numbers: np.ndarray) -> Column:
    """The positions in ``numbers`` of the features a text holds."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        at = np.full(1 << BITS, -1, dtype=np.int32)
        at[numbers] = np.arange(len(numbers), dtype=np.int32)
        wanted = at >= 0
        return pa.array([at[features(t.as_py(), wanted)] for t in texts], pa.list_(pa.int32()))

    return run(text)


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression over present features scaled by ``scale``: gradient
    descent with momentum on sparse rows. Returns weights and intercept."""
    n = len(rows)
    index = np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    value = scale[index]
    w, share = np.zeros(len(scale)), (labels.sum() + 0.5) / (n + 1)
    b = float(np.log(share / (1 - share)))
    vw, vb = np.zeros_like(w), 0.0
    norms = np.bincount(row, value**2, minlength=n)
    rate = 4.0 / (norms.mean() + 1.0)
    for _ in range(STEPS):
        error = sigmoid(np.bincount(row, value * w[index], minlength=n) + b) - labels
        gw = np.bincount(index, value * error[row], minlength=len(w)) / n + RIDGE * w
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * error.mean()
        w, b = w + vw, b + vb
    return w * scale, float(b)


def _best(feature: np.ndarray, counts: np.ndarray, rows: np.ndarray, max_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and log-count ratios of the features that stay."""
    r = np.log((counts[1] + SMOOTHING) / (rows[1] + 2 * SMOOTHING)) - np.log((counts[0] + SMOOTHING) / (rows[0] + 2 * SMOOTHING))
    n = counts.sum(axis=0)
    order = np.lexsort((feature, -np.abs(r) * np.sqrt(n)))
    best = order[n[order] > 0][:max_features]
    return feature[best], r[best]


def train(sample: DataFrame, max_features: int = MAX_FEATURES) -> Model:
    """Fits the model on (text, label) rows of bounded number."""
    empty = np.zeros(0, dtype=np.int64)
    sample = sample.select("text", F.col("label").cast("int").alias("label"), part(F.col("text")).alias("part"))
    counts = sample.mapInArrow(_count_batches, "feature bigint, " + ", ".join(f"{c} int" for c in _CELLS))
    counts = counts.groupBy("feature").agg(*[F.sum(c).cast("int").alias(c) for c in _CELLS]).toArrow()  # 2 ** BITS rows at most
    feature = counts.column("feature").to_numpy()
    cells = np.array([counts.column(c).to_numpy() for c in _CELLS], dtype=np.int64).reshape(PARTS, 2, len(feature))
    rows, cells, feature = cells[:, :, feature < 0].sum(axis=2), cells[:, :, feature >= 0], feature[feature >= 0]
    n0, n1 = rows.sum(axis=0).tolist()
    if n1 == 0:
        return Model(empty, np.zeros(0), float(np.log(0.5 / (n0 + 0.5))) if n0 else -1e9)
    # The model of all parts, then those that leave one out.
    chosen = [_best(feature, cells.sum(axis=0), rows.sum(axis=0), max_features)]
    chosen += [_best(feature, cells.sum(axis=0) - cells[k], rows.sum(axis=0) - rows[k], max_features) for k in range(PARTS)]
    numbers = np.unique(np.concatenate([x for x, _ in chosen]))
    if not len(numbers):
        return Model(empty, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    held = sample.select("label", "part", _feature_column(F.col("text"), numbers).alias("held")).toArrow()
    found, label, of = [np.asarray(x.values) for x in held.column("held")], held.column("label").to_numpy(), held.column("part").to_numpy()
    models = []
    for left_out, (own, scale) in enumerate(chosen, -1):
        at = np.full(len(numbers), -1, dtype=np.int32)
        at[np.searchsorted(numbers, own)] = np.arange(len(own))
        used = np.flatnonzero(of != left_out)
        weights, intercept = fit_linear([at[found[i]][at[found[i]] >= 0] for i in used], label[used].astype(float), scale)
        models.append(Model(own, weights, intercept))
    return calibrated(models[0], models[1:], sample)


def calibrated(model: Model, others: list[Model], sample: DataFrame) -> Model:
    """The model with its cuts, from the clean rows of each part as the model
    of the other parts scores them."""
    clean = sample.where("label = 0").select(_logit_column(F.col("text"), F.col("part"), others).alias("x")).select("x.*").toArrow()
    whole, window = (clean.column(c).to_numpy() for c in ("whole", "window"))
    return replace(model, whole_cut=cut(whole, WHOLE_ALARMS, model.intercept), window_cut=cut(window, WINDOW_ALARMS, model.intercept))


def cut(clean: np.ndarray, alarms: float, least: float) -> float:
    """A logit that at most a share of ``alarms`` of the clean ones is above,
    one more clean text at an even chance counted in: few clean texts leave the
    cut there, many outweigh it. No text is above for having no feature
    (``least``)."""
    if not len(clean):
        return 0.0
    high = np.quantile(np.append(clean, 0.0), 1 - alarms, method="higher")
    return float(np.nextafter(max(high, least), np.inf))


def _logit_column(text: Column, part: Column, models: list[Model]) -> Column:
    """The logits of each text under the model of its part."""

    @F.arrow_udf("struct<whole:double,window:double>")
    def run(texts: pa.Array, parts: pa.Array) -> pa.Array:
        tables = [m.table() for m in models]
        pairs = [logits(t.as_py(), tables[k], models[k].intercept) for t, k in zip(texts, parts.to_pylist())]
        columns = np.array(pairs, dtype=float).reshape(-1, 2).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["whole", "window"])

    return run(text, part)


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1 for each text, 0.5 at the cuts."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        weight = model.table()
        pairs = [logits(t.as_py(), weight, model.intercept) for t in texts]
        return pa.array(sigmoid(np.array([max(whole - model.whole_cut, window - model.window_cut) for whole, window in pairs], dtype=float)))

    return run(text_or_empty(text))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of ``documents`` and ``labels``, learned from folds 1 to 4."""
    sample = labelled_sample(docs, labels.where(fold(F.col("doc_id")) != 0), max_rows=max_rows)
    return train(materialize(sample, "toxicity-sample"))
