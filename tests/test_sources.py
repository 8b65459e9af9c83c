"""Folder scan edge files (S1, S3, S8) and text functions."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.operators import registry as reg
from docsift.operators import vectors as vec
from docsift.plans import ingest
from docsift.sources import files as src
from docsift.sources import folder as fld


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="docsift-files-")
    files = {
        "a.txt": b"Same text\nbody\n",
        "b.TXT": b"Same text\r\nbody\r\n",
        "empty.txt": b"",
        "ws.txt": b"   \n\t  ",
        "bad.txt": b"bad \xff\xfe bytes",
        "bom.txt": "\ufeffTitle with bom\nrest".encode(),
        ".hid.txt": b"hidden",
        "_und.txt": b"underscore",
        "c.docx": b"word",
        "note.md": b"Heading para\nline two\n\nSecond para",
    }
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "n.txt"), "wb") as f:
        f.write(b"nested")
    return d


def test_folder_ingest_edge_files(spark, folder):
    files = ingest.files_from_folder(spark, folder, lambda c: F.concat(F.lit("<h1>"), c, F.lit("</h1>")))
    res = ingest.ingest(files, reg.empty_registry(spark), vec.empty_vectors(spark), base=0)
    names = lambda p: p.rsplit("/", 1)[-1]
    reasons = {names(r.path): r.reason for r in res.rejected.collect()}
    assert reasons == {
        "empty.txt": "empty text", "ws.txt": "no chunks", "bad.txt": "invalid UTF-8", "c.docx": "Unsupported file type",
    }
    rows = {names(r.file_path): r for r in res.registry_rows.collect()}
    # a.txt and b.TXT are one document after newline folding; the first path wins
    assert set(rows) == {"a.txt", "bom.txt", "note.md", ".hid.txt", "_und.txt"}
    assert rows["bom.txt"].title == "\ufeffTitle with bom"  # the BOM is kept
    assert rows["note.md"].title == ">Heading para"  # tag runs keep their brackets


def test_markdown_without_renderer_is_quarantined(spark, folder):
    res = ingest.new_documents(ingest.files_from_folder(spark, folder), None, keep_text=False)
    reasons = {r.path.rsplit("/", 1)[-1]: r.reason for r in res[1].collect()}
    assert reasons["note.md"] == "no Markdown renderer given"
    assert all(not r.path.endswith(".md") for r in res[0].collect())


def test_title_and_strip_follow_python():
    samples = ["  Title 　\nx", "\nstarts with break", "a\rb", "x y", " pad ", "tab\tin\vvt"]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(tx.title("t")).collect()]
    assert got == [s.splitlines()[0].strip() for s in samples]


def test_extension_rules(spark):
    paths = ["kb/a.TXT", "kb/.txt", "kb/.hid.md", "kb/a.b.pdf", "kb/noext", "kb/a.", "kb/..txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(tx.file_extension("p")).collect()]
    assert got == [os.path.splitext(p)[1].lower() for p in paths]


def test_prefix_counts_code_points(spark):
    df = spark.createDataFrame([("a\U0001F600bc",)], "t string")
    assert df.select(tx.prefix("t", 2)).first()[0] == "a\U0001F600"


def test_blank_and_first_line_follow_python(spark):
    ws = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    samples = [ws, ws + "x", "x" + ws, "​", " 　 ", "", "a b\nc", "\x1cq\nr", "\u0085lead", "t\x0bu\nv"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select(tx.is_blank("t").alias("b"), tx.first_line("t").alias("f")).collect()
    assert [r.b for r in got] == [s.strip() == "" for s in samples]
    assert [r.f for r in got] == [s.splitlines()[0] if s else None for s in samples]


def test_read_by_path_flags_or_fails(spark):
    files = spark.createDataFrame([("kb/a.txt", "A text")], "path string, text string")
    req = spark.createDataFrame([(1, "kb/a.txt"), (2, "kb/a.txt"), (3, "kb/gone.txt")], "q long, file_path string")
    rows = sorted(tuple(r) for r in src.read_by_path(req, files).collect())
    assert rows == [(1, "kb/a.txt", "A text", False), (2, "kb/a.txt", "A text", False), (3, "kb/gone.txt", None, True)]
    with pytest.raises(FileNotFoundError):
        src.read_by_path(req, files, strict=True)


def test_scan_lists_every_file_and_opens_the_named_extensions(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in fld.scan(spark, folder, (".txt",)).collect()}
    assert set(rows) == {f for f in os.listdir(folder) if f != "sub"}
    assert rows["empty.txt"].content == b"" and rows["empty.txt"].length == 0
    assert rows["b.TXT"].content == b"Same text\r\nbody\r\n" and rows["bad.txt"].content == b"bad \xff\xfe bytes"
    assert rows["c.docx"].content is None and rows["c.docx"].length == 4 and rows["c.docx"].error is None
    assert fld.scan(spark, tempfile.mkdtemp()).collect() == []
    by_uri = fld.scan(spark, f"file:{folder}").select("path", "content").collect()
    assert len(by_uri) == len(rows) and all(r.path.startswith(f"file:{folder}/") for r in by_uri)


def test_partitions_are_planned_by_bytes_and_files():
    files = [(f"f{i:03}", 100) for i in range(50)] + [("huge", 10**9)] + [("z", 0)] * 3
    parts = fld.plan_partitions(files, 10 * fld.OPEN_BYTES)
    assert [f for p in parts for f in p] == files
    assert max(len(p) for p in parts) <= 10 and [len(p) for p in parts if p[-1][0] == "huge"] and parts[-1] == [("z", 0)] * 3
    assert fld.plan_partitions([], 10) == []


def test_unreadable_files_are_rejected_not_fatal(spark, folder):
    gone = os.path.join(folder, "gone.txt")
    content = fld.open_paths(spark.createDataFrame([(gone,), (folder,)], "path string")).collect()
    assert {r.error for r in content} == {fld.MISSING}  # a folder is no file
    raw = spark.createDataFrame([("a/x.txt", None, "OSError: broken"), ("a/y.txt", b"ok", None)], "path string, content binary, error string")
    good, bad = src.split_rejected(src.decode_files(raw))
    assert [r.path for r in good.collect()] == ["a/y.txt"]
    assert [r.reason for r in bad.collect()] == ["unreadable: OSError: broken"]


def test_only_the_asked_files_are_opened(spark):
    root = tempfile.mkdtemp(prefix="docsift-many-")
    names = spark.range(10_000).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    assert fld.write_files(names, root).count() == 10_000
    before = {f: os.stat(os.path.join(root, f)).st_atime_ns for f in os.listdir(root)}
    asked = [f"{root}/{i}.txt" for i in range(0, 10_000, 1000)]
    requests = [(i, p) for i, p in enumerate([*asked, asked[3], asked[3], f"{root}/none.txt", None])]
    req = spark.createDataFrame(requests, "n int, file_path string")
    assert fld.open_paths(req, "file_path").count() == 11  # ten files and the missing one, each asked for once
    out = {r.n: (r.content, r.missing) for r in src.read_by_path(req).collect()}
    assert out[3] == out[10] == out[11] == ("3000", False)
    assert out[12] == out[13] == (None, True) and len(out) == 14
    with pytest.raises(FileNotFoundError):
        src.read_by_path(req, strict=True)
    touched = {f for f in before if os.stat(os.path.join(root, f)).st_atime_ns != before[f]}
    assert touched <= {os.path.basename(p) for p in asked}


def test_prompts_open_the_files(spark, folder):
    from docsift.operators import answers as ans

    hits = spark.createDataFrame([(1, 1, "x", "t", f"{folder}/a.txt")], "query_id long, rank long, id string, title string, file_path string")
    asked = spark.createDataFrame([(1, "What?")], "query_id long, text string")
    prompt = ans.build_prompts(hits, asked, None).first().prompt
    assert "Same text\nbody" in prompt and "What?" in prompt


def test_documents_of_one_row_group_are_dealt_out(spark, tmp_path):
    """The texts of one split are chunked by as many tasks as there are cores."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docsift.session import materialize

    n = 2000
    table = pa.table({
        "path": [f"kb/{i}.txt" for i in range(n)], "list_order": list(range(n)), "text": [f"{i} " + "word and word " * 100 for i in range(n)],
    })
    pq.write_table(table, str(tmp_path / "one.parquet"), row_group_size=n)
    files = spark.read.parquet(str(tmp_path / "one.parquet"))
    staged = materialize(ingest.stage(files, None)[0], "staged", str(tmp_path / "staged"))
    cores = spark.sparkContext.defaultParallelism
    per_file = [r["count"] for r in staged.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) == cores and max(per_file) < 2 * n / cores and sum(per_file) == n
    # many even splits stay where they are
    files.repartition(4 * cores).write.parquet(str(tmp_path / "even"))
    even = spark.read.parquet(str(tmp_path / "even")).repartition(4 * cores, "path")
    assert "RepartitionByExpression [id" not in ingest.stage(even, None)[0]._jdf.queryExecution().logical().toString()
