"""The model hook of the featurisation."""

import os
import tempfile

import numpy as np
import pyarrow as pa

from docsift.config import EngineConfig
from docsift.functions import features as fx
from docsift.operators import vectors as vec
from docsift.plans import ingest


def _model(folder):
    def load():
        with open(os.path.join(folder, f"{os.getpid()}"), "a") as f:
            f.write("x")
        return 3

    def encode(width, texts):
        lengths = [len(t) for t in texts]
        assert lengths == sorted(lengths) and len(texts) <= 4  # batches by length
        return np.array([[len(t) * (i + 1) for i in range(width)] for t in texts], float)

    return load, encode


def test_a_model_is_loaded_once_a_worker_and_vectors_stay_in_place(spark):
    folder = tempfile.mkdtemp(prefix="docsift-model-")
    hook = fx.model_featurizer(*_model(folder), width=3, batch_size=4)
    rows = [(i, "x" * (i * 7 % 23)) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(24)
    for _ in range(2):
        got = {r.id: r.embedding for r in fx.featurize(df, "text", 3, hook).collect()}
        assert got == {i: None if t is None else [float(len(t) * k) for k in (1, 2, 3)] for i, t in rows}
    loads = [os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder)]
    assert loads and set(loads) == {1}  # 48 tasks, one load a process


def test_the_hook_as_a_stage_of_its_own(spark):
    folder = tempfile.mkdtemp(prefix="docsift-model-")
    hook = fx.model_featurizer(*_model(folder), width=3, batch_size=4)
    df = spark.createDataFrame([(1, "ab", "n"), (2, None, "m")], "id int, text string, note string")
    got = sorted((r.id, r.text, r.note, r.embedding) for r in hook.rows(df, "text", "embedding", None).collect())
    assert got == [(1, "ab", "n", [2.0, 4.0, 6.0]), (2, None, "m", None)]


def test_ingest_with_a_model(spark):
    """A declared width takes the plain path, an undeclared one the checked path; vectors are the same."""
    folder = tempfile.mkdtemp(prefix="docsift-model-")
    files = spark.createDataFrame([(f"kb/{i}.txt", i, f"Doc {i}\n" + "word " * (i * 40)) for i in range(12)], "path string, list_order long, text string")
    both = []
    for width in (3, None):
        hook = fx.model_featurizer(*_model(folder), width=width, batch_size=4)
        res = ingest.ingest(files, None, vec.empty_vectors(spark), EngineConfig(dim=3), hook, base=0)
        both.append(sorted((r.pos, r.doc_id, tuple(r.embedding)) for r in res.vectors.collect()))
    assert both[0] == both[1] and len(both[0]) > 12


def test_tokens_are_hashed_once_a_batch(spark, monkeypatch):
    """The dense form equals the sparse one, no token is hashed on the JVM, and
    a batch hashes each of its distinct tokens once."""
    rows = [(i, " ".join(f"w{(i * j) % 17} Ä{j % 3}É ß" for j in range(i % 40))) for i in range(3000)] + [(3000, None), (3001, " .,")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    dense = fx.featurize(df, "text", 32)
    assert "md5" not in dense._jdf.queryExecution().toString()
    got = {(r.id, i): x for r in dense.collect() for i, x in enumerate(r.embedding) if x}
    sparse = {(r.id, r.bucket): r.weight for r in fx.sparse_features(df, ["id"], "text", 32).collect()}
    assert got == sparse and len(got) > 20000
    hashed = []
    monkeypatch.setattr(fx.hashlib, "md5", lambda b, md5=fx.hashlib.md5: hashed.append(b) or md5(b))
    words = pa.array([["a", "b", "a"], None, [], ["b"]] * 500)
    out = fx._densify_factory(8).func(words)
    assert sorted(hashed) == [b"a", b"b"] and len(out) == 2000 and out[1].as_py() == [0.0] * 8
