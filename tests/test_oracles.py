"""Every registered query with SQL: Spark result == DuckDB result (sf0.001)."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from docsift.plans import catalog, oracles
from docsift.streaming import jobs

from .conftest import SF001

TABLES = ["documents", "embeddings", "pages", "conversations", "labels", "benchmark"]
SKIP_HERE = {"stream_ingest", "stream_routing"}  # covered in test_streaming


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SKIP_HERE))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)


def test_every_query_has_an_entry():
    qs, sql = queries(), oracle_sql()
    assert set(sql) <= set(qs)
    # every query of the library itself has an oracle (corpus operators that
    # SQL cannot express are tested by brute force)
    assert {**catalog.QUERIES, **jobs.QUERIES}.keys() == oracles.ORACLES.keys()


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["query_id", "rank", "id", "title", "file_path"]
    assert df.count() > 0


def test_entry_from_another_directory(tmp_path):
    """The driver may import the entry module from anywhere: the package is
    found and shipped to the Python workers without the repo as cwd."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('e', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', e.entry(s).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS " in out.stdout and int(out.stdout.split("ROWS ")[1].split()[0]) > 0, out.stderr[-2000:]
