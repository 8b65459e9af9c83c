"""Command line: ingest a folder into a store; route and retrieve questions.

    python -m docsift ingest FOLDER STORE      # re-runnable (T1 + C1)
    python -m docsift ask STORE QUESTION...    # routes (F12) + top-3 (C2)
    python -m docsift list STORE               # registered documents (P1)
    python -m docsift delete STORE ID...       # unregister documents (P7)
    python -m docsift clear STORE              # empty the store (P8)

The store is a folder of parquet tables (``sources/store.py``); the ingest
checkpoint lives inside it, so re-running skips files already read and
content already registered. No chat model is called: 'retrieve' questions
print their documents, 'list' prints the title listing.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    from docsift.session import ensure_checkpoint_dir, ship_code

    spark = SparkSession.builder.appName("docsift").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def _print_registry(store) -> None:
    """One line per document, a partition at a time (the registry is never
    collected whole)."""
    for r in store.registry().select("id", "title", "file_path").toLocalIterator():
        print(f"{r.id}\t{r.title}\t{r.file_path}")


def ingest_cmd(folder: str, store_root: str) -> None:
    from docsift.streaming import jobs

    spark = _session()
    store = jobs.ingest_folder(spark, folder, store_root, os.path.join(store_root, "_checkpoint"))
    _print_registry(store)  # the listing, as printed after ingest


def ask_cmd(store_root: str, questions: list[str]) -> None:
    from docsift.config import DEFAULT
    from docsift.functions import features as fx
    from docsift.operators import answers as ans
    from docsift.operators import retrieval
    from docsift.sources.store import Store

    spark = _session()
    store = Store(spark, store_root)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(questions)], "query_id long, text string")
    routes = {r.query_id: r.route for r in ans.route(q).collect()}
    wanted = q.where(F.col("query_id").isin([i for i, r in routes.items() if r == "retrieve"] or [-1]))
    hits = retrieval.retrieve(store.vectors(), store.registry(), fx.featurize(wanted, "text", DEFAULT.dim), DEFAULT.retrieve_k)
    by_q: dict[int, list] = {}
    for r in hits.orderBy("query_id", "rank").collect():
        by_q.setdefault(r.query_id, []).append(r)
    for i, text in enumerate(questions):
        print(f"[{routes[i]}] {text}")
        if routes[i] == "list":
            for r in ans.title_message_lines(store.registry()).orderBy("line_no").toLocalIterator():
                print(r.line)
        elif routes[i] == "retrieve":
            for r in by_q.get(i, []):
                print(f"  {r.rank}. {r.title} ({r.file_path}, {r.id})")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docsift")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("store")
    b = sub.add_parser("ask")
    b.add_argument("store")
    b.add_argument("questions", nargs="+")
    for name in ("list", "clear", "delete"):
        c = sub.add_parser(name)
        c.add_argument("store")
        if name == "delete":
            c.add_argument("ids", nargs="+")
    args = p.parse_args(argv)
    if args.cmd == "ingest":
        ingest_cmd(args.folder, args.store)
    elif args.cmd == "ask":
        ask_cmd(args.store, args.questions)
    else:
        from docsift.sources.store import Store

        spark = _session()
        store = Store(spark, args.store)
        if args.cmd == "delete":
            store.delete(spark.createDataFrame([(i,) for i in args.ids], "id string"))
        elif args.cmd == "clear":
            store.clear()
        else:
            _print_registry(store)
    return 0


if __name__ == "__main__":
    sys.exit(main())
