"""Folders of files as a Spark data source, and files opened by path.

``folder_files`` lists the direct children of a folder once, all of them:
also empty ones and names that start with '.' or '_'. The listing, sorted by
path, is cut in partitions of about ``TARGET_BYTES`` bytes; tasks open their
files and return Arrow batches. Only the extensions asked for are opened. A
file that cannot be read becomes a row with an ``error``, never a failed job.

``open_paths`` opens the files that a table of paths names: requests are made
distinct and dealt out in path order, so a task's files lie close together,
and nothing else in the folder is touched.

Paths are local or any URI that ``pyarrow.fs`` knows (S3, GCS, HDFS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TARGET_BYTES = 64 << 20
#: What opening a file costs, in bytes read: bounds the files of a partition.
OPEN_BYTES = 256 << 10
#: A batch of contents ends at this size; a single larger file is a batch of its own.
BATCH_BYTES = 16 << 20
#: Spark's binary values end here.
MAX_FILE_BYTES = (1 << 31) - 1024
MISSING = "missing"
TOO_LARGE = "larger than 2 GiB"
_CONTENT = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
CONTENT_SCHEMA = "path string, length bigint, content binary, error string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):  # also file:/a, which Spark writes
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def list_folder(folder: str, skipped_only: bool = False) -> list[tuple[str, int]]:
    """(path as the folder is named, bytes) of the files in a folder, by path.
    ``skipped_only``: those that Spark's file sources leave out."""
    fs, root = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=False))
    files = [f for f in found if f.type == pafs.FileType.File]
    if skipped_only:
        files = [f for f in files if not f.size or f.base_name.startswith((".", "_"))]
    top = folder.rstrip("/")
    return sorted((f"{top}/{f.base_name}", f.size or 0) for f in files)


def plan_partitions(files: list[tuple[str, int]], target: int) -> list[list[tuple[str, int]]]:
    """The listing cut in runs of about ``target`` bytes, the cost of opening included."""
    out: list[list[tuple[str, int]]] = []
    size = target
    for path, length in files:
        if size >= target:
            out.append([])
            size = 0
        out[-1].append((path, length))
        size += length + OPEN_BYTES
    return out


def _target(path: str, held: dict) -> tuple[pafs.FileSystem, str]:
    """As ``filesystem``, a file system opened once a host or bucket."""
    if "://" not in path or path.startswith("file:"):
        return filesystem(path)
    host = "/".join(path.split("/", 3)[:3])
    rest = path[len(host) :]
    if host not in held:
        fs, inside = filesystem(path)
        held[host] = fs, inside[: len(inside) - len(rest)]
    fs, prefix = held[host]
    return fs, prefix + rest


def _read(path: str, held: dict) -> tuple[int | None, bytes | None, str | None]:
    """(length, content, error) of one file."""
    try:
        fs, inside = _target(path, held)
        info = fs.get_file_info(inside)
        if info.type != pafs.FileType.File:
            return None, None, MISSING
        if info.size > MAX_FILE_BYTES:
            return info.size, None, TOO_LARGE
        with fs.open_input_stream(inside, compression=None) as f:
            return info.size, f.read(), None
    except (OSError, pa.ArrowException) as e:
        return None, None, f"{type(e).__name__}: {e}"[:200]


def _batches(paths: Iterator[tuple[str, int | None]], wanted: tuple[str, ...] | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, held = 0, {}
    for path, length in paths:
        content = error = None
        if wanted is None or path.lower().endswith(wanted):
            length, content, error = _read(path, held)
        rows.append((path, length, content, error))
        size += len(content or b"") + len(path)
        if size >= BATCH_BYTES or len(rows) >= 4096:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTENT)], schema=_CONTENT)


@dataclass
class FolderPartition(InputPartition):
    files: list


class FolderReader(DataSourceReader):
    def __init__(self, folder: str, wanted: tuple[str, ...] | None, target: int, skipped_only: bool) -> None:
        self.folder, self.wanted, self.target, self.skipped_only = folder, wanted, target, skipped_only

    def partitions(self) -> list[FolderPartition]:
        files = list_folder(self.folder, self.skipped_only)
        return [FolderPartition(x) for x in plan_partitions(files, self.target)] or [FolderPartition([])]

    def read(self, partition: FolderPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(iter(partition.files), self.wanted)


class FolderFiles(DataSource):
    """``spark.read.format("folder_files").option("extensions", ".txt,.md").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return CONTENT_SCHEMA

    def reader(self, schema) -> FolderReader:
        wanted = self.options.get("extensions")
        return FolderReader(
            self.options["path"], tuple(wanted.lower().split(",")) if wanted else None,
            int(self.options.get("targetBytes", TARGET_BYTES)), self.options.get("skippedOnly", "false") == "true",
        )


def scan(
    spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None, skipped_only: bool = False
) -> DataFrame:
    """(path, length, content, error) of every file in the folder; the
    content is NULL for other extensions than those named. ``skipped_only``:
    just the files that Spark's own file sources (and streams) leave out."""
    spark.dataSource.register(FolderFiles)
    reader = spark.read.format(FolderFiles.name()).option("skippedOnly", str(skipped_only).lower())
    return (reader.option("extensions", ",".join(extensions)) if extensions else reader).load(folder)


def open_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, length, content, error) of each distinct path, opened by the
    task that has it; ``error`` is 'missing' where there is no such file."""
    wanted = paths.select(paths[path_col].alias("path")).where("path IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((p, None) for b in batches for p in b.column(0).to_pylist()), None)

    return wanted.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, CONTENT_SCHEMA)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content binary) rows as files of a folder, a task its own
    rows; lazily (name, length), to be written by the action on the result."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            names, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, content in zip(names, contents):
                with fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"name": names, "length": [len(c or b"") for c in contents]})

    return files.select("name", "content").mapInArrow(run, "name string, length bigint")
