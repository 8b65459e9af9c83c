"""Featurisation.

The reproduced system embeds chunks with a pretrained transformer whose
weights are not available here. ``featurize`` therefore takes any
Column -> Column featurizer; the default is signed feature hashing
(Weinberger et al., 2009), which is *not* semantic similarity:

    tokens  = maximal runs of letters/digits of lower(text)
    h       = md5(token) (hex)
    bucket  = int(h[0:8], 16) mod dim
    sign    = +1 if int(h[8], 16) is even else -1
    vector  = sum of sign * e_bucket, then divided by its L2 norm

Tokenising is a native expression (JVM side). The dense form hashes each
distinct token of an Arrow batch once and adds them up in numpy (an Arrow
UDF); the sparse form is native throughout. MD5 rather than Spark's ``hash`` keeps the vector reproducible in
other engines (the DuckDB oracle rebuilds it exactly: integer sums, one
correctly rounded sqrt and division).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), F.lit(0))


def signed_buckets(text, dim: int) -> Column:
    """array<int>: (bucket + 1) * sign for every token, in token order."""

    def code(tok):
        h = F.md5(tok)
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dim))
        odd = F.pmod(F.conv(F.substring(h, 9, 1), 16, 10).cast("int"), F.lit(2)) == 1
        return F.when(odd, -(bucket + 1)).otherwise(bucket + 1).cast("int")

    return F.transform(tokens(text), code)


def sparse_features(df: DataFrame, key_cols: list[str], text: str, dim: int) -> DataFrame:
    """(keys..., bucket, weight) for every non-zero entry of the normalised
    hashed vector; the exact form used by oracle comparisons."""
    codes = df.select(*key_cols, F.explode(signed_buckets(text, dim)).alias("_c"))
    counts = codes.groupBy(*key_cols, (F.abs("_c") - 1).alias("bucket")).agg(
        F.sum(F.signum("_c")).cast("bigint").alias("_v")
    ).where(F.col("_v") != 0)
    from pyspark.sql import Window

    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(*key_cols)).cast("double"))
    return counts.select(
        *key_cols,
        F.col("bucket").cast("bigint"),
        (F.col("_v").cast("double") / norm).cast("float").cast("double").alias("weight"),
    )


def _token_codes(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each token, as ``signed_buckets`` has them."""
    digests = b"".join(hashlib.md5(w.encode()).digest() for w in words)
    code = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
    bucket = np.ascontiguousarray(code[:, :4]).view(">u4").ravel().astype(np.int64) % dim
    return bucket, 1.0 - 2.0 * ((code[:, 4] >> 4) & 1)


#: Rows that are added up at once in float64.
DENSE_ROWS = 1024


def _densify_factory(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def densify(words: pa.Array) -> pa.Array:
        """Tokens -> L2-normalised dense float32 vectors: one bincount per
        ``DENSE_ROWS`` rows, returned as a single list array."""
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        n = len(words)
        lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
        coded = words.flatten().dictionary_encode()
        bucket, sign = _token_codes(coded.dictionary.to_pylist(), dim)
        token = coded.indices.to_numpy(zero_copy_only=False)
        dense = np.empty((n, dim), dtype=np.float32)
        for lo in range(0, n, DENSE_ROWS):
            hi = min(n, lo + DENSE_ROWS)
            at = token[ends[lo] : ends[hi]]
            cells = np.repeat(np.arange(hi - lo, dtype=np.int64) * dim, lengths[lo:hi]) + bucket[at]
            out = np.bincount(cells, weights=sign[at], minlength=(hi - lo) * dim).reshape(hi - lo, dim)
            norms = np.sqrt((out * out).sum(axis=1))
            dense[lo:hi] = out / np.where(norms > 0, norms, 1.0)[:, None]
        offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(dense.ravel(), type=pa.float32()))

    return densify


def hashing_featurizer(dim: int) -> Callable[[Column], Column]:
    """Default featurizer: text Column -> array<float> of width ``dim``."""
    densify = _densify_factory(dim)

    def fz(text: Column) -> Column:
        return densify(tokens(text))

    fz.fixed_width = dim  # every output has exactly ``dim`` entries
    return fz


#: The models a worker process holds, by the featurizer that loaded them.
_LOADED: dict[str, object] = {}


def _loaded(name: str, load: Callable[[], object]) -> object:
    """Found by import in the worker, so that all its tasks see one table."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def model_featurizer(
    load: Callable[[], object], encode: Callable[[object, list[str]], np.ndarray], width: int | None = None, batch_size: int = 64
) -> Callable[[Column], Column]:
    """A featurizer with state. ``load()`` builds the model, once in a worker
    process however many tasks and batches that runs; ``encode(model, texts)``
    gives a row of floats for each text. Texts are encoded ``batch_size`` at a
    time in order of length, so that a padding model pads little, and returned
    in their own order; a NULL text gives a NULL vector. ``width``: declared
    when every vector has that many entries (else widths are checked, P6)."""
    name = uuid.uuid4().hex

    def vectors(texts: pa.Array) -> pa.Array:
        model = _loaded(name, load)
        values = texts.to_pylist()
        known = sorted((i for i, t in enumerate(values) if t is not None), key=lambda i: len(values[i]))
        out: list = [None] * len(values)
        for at in range(0, len(known), batch_size):
            part = known[at : at + batch_size]
            for i, row in zip(part, encode(model, [values[i] for i in part])):
                out[i] = np.asarray(row, dtype=np.float32)
        return pa.array(out, pa.list_(pa.float32()))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield vectors(texts)

    def fz(text: Column) -> Column:
        return run(text)

    def rows(df: DataFrame, text_col: str, out_col: str, profile) -> DataFrame:
        schema = T.StructType([f for f in df.schema.fields if f.name != out_col] + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [n for n in b.schema.names if n != out_col]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), vectors(b.column(text_col))], [*keep, out_col])

        return df.mapInArrow(each, schema, profile=profile)

    fz.fixed_width = width
    fz.rows = rows
    return fz


def featurize(df: DataFrame, text_col: str, dim: int, featurizer: Callable[[Column], Column] | None = None,
              out_col: str = "embedding", profile=None) -> DataFrame:
    """F14 + F15: add a float32 vector column. The query side must use the
    same featurizer as the index side. ``profile``: the resource profile of the
    stage that runs a ``model_featurizer`` (executors with a GPU, say)."""
    fz = featurizer or hashing_featurizer(dim)
    if profile is not None:
        return fz.rows(df, text_col, out_col, profile)
    return df.withColumn(out_col, fz(F.col(text_col)).cast(T.ArrayType(T.FloatType())))
