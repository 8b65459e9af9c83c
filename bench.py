"""Headline timings: prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is executed in full with the ``noop`` sink (no collect to the
driver). Each is run once to warm up, then BENCH_RUNS times (default 3);
the median is reported. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from docsift.functions import features as fx  # noqa: E402
from docsift.operators import vectors as vec  # noqa: E402
from docsift.plans import catalog, fixtures, ingest  # noqa: E402
from docsift.session import local_session  # noqa: E402


def chunk_features(spark, d):
    """F13 + F14 over every accepted document (dim 384)."""
    return fx.featurize(catalog._chunks(spark, d), "chunk", 384).select("doc_id", "chunk_no", "embedding")


def full_ingest_vectors(spark, d):
    """Vectors of the whole ingest (chunk, featurise, width, positions)."""
    return ingest.ingest(fixtures.files(spark, d), None, vec.empty_vectors(spark), base=0).vectors


BENCH = {
    "retrieve_top3": catalog.retrieve_top3,
    "knn_top5": catalog.knn_top5,
    "retrieve_questions": catalog.retrieve_questions,
    "chunks": catalog.chunks,
    "chunk_features": chunk_features,
    "incremental_ingest": catalog.incremental_ingest,
    "full_ingest_vectors": full_ingest_vectors,
    "format_answers": catalog.format_answers,
    "route_queries": catalog.route_queries,
    "title_message": catalog.title_message,
}


def run_once(spark, fn, d):
    t0 = time.perf_counter()
    df = fn(spark, d)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [a for a in sys.argv[1:]]
    spark = local_session(cpus, app="docsift-bench")
    results, rows = {}, {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        run_once(spark, fn, sf_dir)  # warm-up
        times = [run_once(spark, fn, sf_dir) for _ in range(runs)]
        results[name] = round(statistics.median(times), 3)
        rows[name] = fn(spark, sf_dir).count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per headline query",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "rows": rows,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
