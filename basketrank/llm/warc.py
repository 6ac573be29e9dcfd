"""WARC archives from a page table and back, through tables of payload chunks.

A payload is never held whole by the code that writes or reads archives, only by the
row of the page table that it is cut from, one chunk at a time. It is a run of rows (record, chunk number, bytes of at most ``CHUNK``), and each row read
back carries the SHA-1 of the payload up to and with its chunk, so the last row
has the digest of the whole.

Writing takes two passes over the pages. The first finds length and digest, and
for equal payloads the largest page id, whose record keeps the payload
(``response``); the others only refer to it (``revisit``). The second cuts the payloads
into chunk rows and streams them, in order, into archives of about
``ARCHIVE_BYTES``. Every attempt of a task writes files of its own on the shared
storage; only the files of attempts that succeeded are in the returned manifest,
so lost executors leave no half record in the result.

Reading is one task per archive of the manifest, record after record.

Defined results: a null payload is empty; payloads shorter than ``min_revisit`` bytes are
always stored; a null page id ranks below all others, and rows that repeat the
id and payload of a response are responses too; null addresses become
``urn:page:<id>``; other columns are not read; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from basketrank.functions.joins import lookup
from basketrank.functions.staging import new_path, stage
from basketrank.llm.common import named

CHUNK = 1 << 20
ARCHIVE_BYTES = 1 << 30
#: Most bytes of an outgoing batch of chunk rows.
_BATCH_BYTES = 16 << 20

RECORDS = (
    "record_id string, record_type string, page_id long, uri string, refers_to long, "
    "payload_bytes long, payload_digest string"
)
CHUNKS = (
    "record_id string, chunk_no int, record_type string, page_id long, uri string, refers_to long, "
    "bytes_so_far long, digest_so_far string, last boolean, chunk binary"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def plan_records(
    pages: DataFrame,
    min_revisit: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """(page_id, uri, payload, payload_bytes, sha1, refers_to): what will be written.

    ``refers_to`` is null for responses. Only digests that occur more than once
    are joined to the pages.
    """
    payload = F.coalesce(named(payload_col).cast("string"), F.lit("")).cast("binary")
    size = F.length(payload).cast("long")
    rows = pages.select(
        named(id_col).cast("long").alias("page_id"),
        named(url_col).cast("string").alias("uri"),
        payload.alias("payload"),
        size.alias("payload_bytes"),
        F.sha1(payload).alias("sha1"),
    )
    best = stage(
        rows.filter(F.col("payload_bytes") >= min_revisit)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha1", "best"),
        "repeated-payloads",
    )
    keeps = F.col("best").isNull() | F.col("page_id").eqNullSafe(F.col("best"))
    return (
        lookup(rows, best, "sha1", row_bytes=96, spread="page_id")
        .withColumn("refers_to", F.when(~keeps, F.col("best")))
        .drop("best")
    )


def to_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of planned records, in order within their task; revisits have one without bytes."""
    stored = F.col("refers_to").isNull()
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk).cast("int") - 1, F.lit(0))
    # Only the numbers are exploded; a chunk is cut when its row is made.
    numbers = F.sequence(F.lit(0), F.when(stored, last).otherwise(F.lit(0)))
    columns = ["page_id", "uri", "payload_bytes", "sha1", "refers_to"]
    return records.select(*columns, "payload", F.explode(numbers).alias("chunk_no")).select(
        *columns, "chunk_no", F.when(stored, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).alias("chunk")
    )


def _header(page_id, uri, size, sha1, refers_to, written: str) -> bytes:
    """Header of a record with what stands before the payload."""
    revisit = refers_to is not None
    kind = "revisit" if revisit else "response"
    name = lambda k, page: uuid.UUID(hashlib.md5(f"{k} {sha1} {page}".encode()).hexdigest())
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri or f"urn:page:{page_id}")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += "\r\n" if revisit else f"Content-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name(kind, page_id)}>",
        f"WARC-Date: {written}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{name('response', refers_to)}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join([*lines, "", http]).encode()


def write_archives(
    records: DataFrame, folder: str | None = None, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write planned records below ``folder`` and return the manifest (path, records, bytes)."""
    spark = records.sparkSession
    folder = folder or new_path(spark, "warc")
    written = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_folder(folder)
        task = TaskContext.get()
        stem = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        paths, counts, sizes = [], [], []
        out, sha, left = None, hashlib.sha1(), 0
        for batch in batches:
            names = ("page_id", "uri", "payload_bytes", "sha1", "refers_to", "chunk_no", "chunk")
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            for i in range(batch.num_rows):
                page_id, uri, size, sha1, refers_to, number, data = (c[i].as_py() for c in columns)
                if number == 0:
                    if out is None or sizes[-1] >= archive_bytes:
                        if out is not None:
                            out.close()
                        else:
                            store.create_dir(root, recursive=True)
                        paths.append(f"{folder}/{stem.rsplit('/', 1)[1]}-{len(paths):03d}.warc")
                        out = store.open_output_stream(f"{stem}-{len(paths) - 1:03d}.warc")
                        counts.append(0)
                        sizes.append(0)
                    head = _header(page_id, uri, size, sha1, refers_to, written)
                    out.write(head)
                    counts[-1] += 1
                    sizes[-1] += len(head) + 4
                    sha, left = hashlib.sha1(), size if refers_to is None else 0
                if data:
                    out.write(data)
                    sha.update(data)
                    left -= len(data)
                    sizes[-1] += len(data)
                if left == 0:
                    if refers_to is None and sha.hexdigest() != sha1:
                        raise ValueError(f"payload of page {page_id} changed between two reads")
                    out.write(b"\r\n\r\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    return stage(to_chunks(records, chunk).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _fields(file: io.BufferedReader) -> dict[str, str] | None:
    """Header fields of the next record, or None at the end of the archive."""
    line = file.readline()
    while line == b"\r\n":
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record at byte {file.tell() - len(line)}")
    out = {}
    while (line := file.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def chunks_of(file: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows as in ``CHUNKS`` of an open archive, one payload chunk at a time."""
    while (head := _fields(file)) is not None:
        left = int(head["content-length"])
        # The HTTP header before the payload.
        while left:
            line = file.readline()
            left -= len(line)
            if line == b"\r\n":
                break
        kind = head["warc-type"]
        page = int(head["x-page-id"]) if "x-page-id" in head else None
        refers = int(head["x-refers-to-page-id"]) if kind == "revisit" else None
        fixed = (kind, page, head["warc-target-uri"], refers)
        name, number, done, sha = head["warc-record-id"], 0, 0, hashlib.sha1()
        if kind == "revisit":
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            yield (name, 0, *fixed, int(head["x-payload-length"]), digest, True, None)
            continue
        while True:
            data = file.read(min(chunk, left))
            if left and not data:
                raise ValueError(f"record {name} is cut off")
            left -= len(data)
            done += len(data)
            sha.update(data)
            digest = base32_sha1(sha.digest())
            if not left and digest != head["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"record {name} is damaged")
            yield (name, number, *fixed, done, digest, not left, data)
            number += 1
            if not left:
                break


def read_chunks(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunk table of the archives in ``manifest``, without the bytes if not ``payload``."""
    kind = CHUNKS if payload else CHUNKS.removesuffix(", chunk binary")
    columns = [c.split()[0] for c in kind.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kind.split(", ")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _open_folder(path)
                rows, held = [], 0
                with io.BufferedReader(store.open_input_stream(place), 1 << 20) as file:
                    for row in chunks_of(file, chunk):
                        rows.append(row[: len(columns)])
                        held += 200 + (len(row[-1]) if payload and row[-1] else 0)
                        if held >= _BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, kind)


def read_records(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record as in ``RECORDS``, from the last row of its chunks."""
    return (
        read_chunks(manifest, chunk, payload=False)
        .filter("last")
        .select(
            "record_id",
            "record_type",
            "page_id",
            "uri",
            "refers_to",
            F.col("bytes_so_far").alias("payload_bytes"),
            F.col("digest_so_far").alias("payload_digest"),
        )
    )


def archive_and_read(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from new archives."""
    manifest = write_archives(plan_records(pages, min_revisit))
    return read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
