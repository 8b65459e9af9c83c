"""WARC archives: writing, normalising to one gzip member a record, reading.

1. ``write_monolithic`` makes a record per page with Spark's text sink: each
   task writes gzip files that are one single stream, which no reader can
   enter in the middle. Pages with equal payloads are stored once; the others
   are revisit records that refer to the page with the smallest id.
2. ``normalise`` takes each such file in a task of its own, inflates the
   stream once, chunk by chunk, writes every record as its own gzip member
   and a sidecar index beside it: one JSON line a record with offset and
   length. Archive and index get their names only when complete, the index
   last; a task that runs again replaces both.
3. ``read_records`` opens the archives at the indexed offsets, inflates single
   members, and checks each stored payload against its digest.

The workers reach the files through pyarrow's file systems, so the folder may
be anything both Spark and pyarrow can open (``file:``, ``s3:``, ``hdfs:``).

Edge cases: a null html is an empty payload; a null url has no target URI;
white space and control characters in a url are written as %20; a null
page_id is written as an id of its own kind and read back as null, and is
larger than any other; rows that repeat the smallest page_id of a payload are
all responses; very long payloads are written and read whole; further columns,
also of clashing names, are ignored; an archive that ends inside a record is an error, never cut
short; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import materialize, text_or_empty
from docsift.operators.sizing import broadcast_if_small

RECORD_ID = "urn:docsift:page:"
NO_ID = "none"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
RECORDS_PER_FILE = 5000
INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, record_type string"
RECORD_SCHEMA = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def base32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit hex digest: five hex digits are four of base 32."""
    quads = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with digest, size, record type and the response they refer to."""
    html = text_or_empty(pages[f"`{html_col}`"])
    rows = pages.select(
        pages[f"`{id_col}`"].alias("page_id"), pages[f"`{url_col}`"].alias("url"), html.alias("html"),
        F.sha1(html).alias("sha1"), F.octet_length(html).cast("bigint").alias("size"),
    )
    groups = rows.groupBy("sha1", "size").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    repeated = materialize(groups.where("n > 1").drop("n").withColumn("several", F.lit(True)), "warc-groups")
    joined = rows.join(broadcast_if_small(repeated), ["sha1", "size"], "left")
    first = F.col("several").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "html", "size", base32(F.col("sha1")).alias("digest"),
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit(NO_ID)), F.lit(">"))


def record_text(planned: DataFrame) -> Column:
    """The record without the two line ends that close it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n")
    )
    stored = F.col("record_type") == "response"
    block = F.concat(http, F.when(stored, F.col("html")).otherwise(""))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), clean)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~stored, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~stored, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def write_monolithic(planned: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Whole-file gzip streams; the line separator closes each record."""
    (
        planned.select(record_text(planned).alias("value"))
        .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)
    )


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _inflated(stream) -> Iterator[bytes]:
    """The inflated chunks of a gzip file of one or more members."""
    inflater, started = zlib.decompressobj(31), False
    while chunk := stream.read(CHUNK):
        while chunk:
            started = True
            yield inflater.decompress(chunk)
            chunk = inflater.unused_data
            if inflater.eof:
                inflater, started = zlib.decompressobj(31), False
    if started:
        raise ValueError("the gzip stream ends early")


def parse_head(record: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) and where the block starts."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = bytes(record[:end]).decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    return {k.lower(): v for k, v in fields.items()}, end + 4


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (header fields, all bytes with the closing line ends)."""
    buffer, need = bytearray(), None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                if (head := parse_head(buffer)) is None:
                    break
                fields, start = head
                need = start + int(fields["content-length"]) + 4
            if len(buffer) < need:
                break
            yield fields, bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def _normalise_files(out_dir: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_fs, out_path = _open(out_dir)
        out_fs.create_dir(out_path, recursive=True)
        for batch in batches:
            for uri in batch["path"]:
                in_fs, in_path = _open(uri)
                name = uri.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
                mark = uuid.uuid4().hex
                rows, offset = [], 0
                with in_fs.open_input_stream(in_path, compression=None) as stream, out_fs.open_output_stream(
                    f"{out_path}/.{name}.{mark}", compression=None
                ) as out:
                    for fields, record in split_records(_inflated(stream)):
                        member = gzip.compress(record, mtime=0)
                        out.write(member)
                        rows.append((f"{out_dir}/{name}", offset, len(member), fields["warc-record-id"], fields["warc-type"]))
                        offset += len(member)
                index = pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id", "record_type"])
                with out_fs.open_output_stream(f"{out_path}/.{name}.idx.{mark}", compression=None) as out:
                    for row in rows:
                        out.write((json.dumps(dict(zip(index.columns[1:], row[1:]))) + "\n").encode())
                out_fs.move(f"{out_path}/.{name}.{mark}", f"{out_path}/{name}")
                out_fs.move(f"{out_path}/.{name}.idx.{mark}", f"{out_path}/{name}.idx")
                yield index

    return run


def normalise(spark: SparkSession, monolithic: str, out_dir: str) -> DataFrame:
    """Rewrites every ``*.gz`` of a folder; the index of all archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(monolithic).select("path")
    n = max(1, len(files.inputFiles()))
    return materialize(files.repartition(n).mapInPandas(_normalise_files(out_dir), INDEX_SCHEMA), "warc-index")


def _read_members(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, entries in batch.groupby("archive", sort=True):
                in_fs, in_path = _open(uri)
                with in_fs.open_input_file(in_path) as file:
                    for entry in entries.sort_values("offset").itertuples():
                        file.seek(entry.offset)
                        rows.append(parse_record(gzip.decompress(file.read(entry.length)), with_payload))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def parse_record(record: bytes, with_payload: bool) -> tuple:
    fields, start = parse_head(record)
    block = record[start : start + int(fields["content-length"])]
    http, body = parse_head(block)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    size, payload = int(http["content-length"]), block[body:]
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest and length")
    page = [fields.get(k, f"<{RECORD_ID}{NO_ID}>")[1 + len(RECORD_ID) : -1] for k in ("warc-record-id", "warc-refers-to")]
    page = [None if x == NO_ID else x for x in page]
    return page[0], size, digest, kind, page[1], payload if with_payload else None


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the indexed records; ids come back as strings. An archive's
    entries are read in its order, in as many tasks as the index has files."""
    return index.mapInPandas(_read_members(with_payload), RECORD_SCHEMA)
