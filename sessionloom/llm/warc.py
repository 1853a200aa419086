"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes archives of its own below a shared folder, records compressed one by one, and returns
one index row per record: file, offset, length, URL and digest. Spark commits the index, so an archive
of a lost or repeated attempt is merely never named. Reading takes any selection of the index, sorts it by
file and offset, joins neighbouring ranges into one read, and inflates record by record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.scratch import materialise, scratch_path

ARCHIVE_BYTES = 256 << 20  # a task starts a new archive beyond it
READ_BYTES = 8 << 20  # ranges are joined up to this size
GAP_BYTES = 64 << 10  # and over holes up to this size
TASK_BYTES = 8 << 20  # what a reading task is given
DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns agree
INDEX = (
    "page_id bigint, url string, payload_digest string, record_type string, file string, offset bigint, length bigint"
)
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload string"
)
_INPUT = ("page_id", "url", "html", "refers_to")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    """Rows in the types of a column list. Ids stay whole numbers, beside nulls too."""
    fields = [c.split() for c in columns.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrays = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(a), kinds[kind]) for a, (_, kind) in zip(arrays, fields, strict=True)], names=[n for n, _ in fields]
    )


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it (file:, hdfs:, s3a:, gs:, abfss: or none)."""
    if ":" not in folder:
        return fs.LocalFileSystem(), folder
    scheme, rest = folder.split(":", 1)
    store, path = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")
    return store, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, sha: str, refers_to) -> bytes:
    """One record with its header, uncompressed. Control characters and blanks in URLs are escaped."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    block = _HTTP + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> tuple:
    """Fields of RECORD from one compressed record; checks length and digest of a stored payload."""
    data = zlib.decompress(member, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    page = fields["WARC-Record-ID"][10:-1]
    refers = fields.get("WARC-Refers-To")
    payload = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
    if not lines[0].startswith("WARC/") or payload is not None and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"damaged record of page {page}")
    return (
        int(page) if page else None, fields.get("WARC-Target-URI"), kind, int(refers[10:-1]) if refers else None,
        size, sha, None if payload is None else payload.decode(),
    )


def resolve(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that repeat a payload of at least ``least`` bytes."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sums = materialise(
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(body).alias("sha"), F.octet_length(body).alias("n"))
        .filter(F.col("n") >= least)
        .drop("n"),
        "sums",
    )
    firsts = sums.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        sums.join(firsts, "sha")
        .filter("refers_to is not null and not (page_id <=> refers_to)")
        .select("page_id", "sha", "refers_to")
        .distinct()
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write one record per page into archives below ``folder`` and return their index.

    Of equal payloads of at least ``least`` bytes the smallest page_id is a response and the others are
    revisits without payload; a null page_id always revisits a known one. Rows that repeat both page_id and
    payload count as the same page and are responses each. Null html is an empty payload, a null URL is left out.
    """
    again = resolve(pages, least).withColumnsRenamed({"page_id": "__page", "sha": "__sha"})
    body = F.coalesce("html", F.lit(""))
    slim = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"),
        F.sha1(F.encode(body, "UTF-8")).alias("sha"),
    )
    known = slim.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha") == F.col("__sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in _INPUT), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    sha = digest(payload)
                    member = _gzip(_record(page, url, payload, sha, refers))
                    out.write(member)
                    rows.append((page, url, sha, "response" if refers is None else "revisit", name, at, len(member)))
                    at += len(member)
                yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return materialise(known.select(*_INPUT).mapInArrow(run, INDEX), "index")


def _ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of sorted records that one read covers."""
    first = 0
    for n in range(1, len(offsets) + 1):
        if (
            n == len(offsets)
            or offsets[n] - (offsets[n - 1] + lengths[n - 1]) > GAP_BYTES
            or offsets[n] + lengths[n] - offsets[first] > READ_BYTES
        ):
            yield first, n
            first = n


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index name: RECORD, without the payload unless ``payloads``.

    Rows are range partitioned by file and offset in as many tasks as the bytes to be read warrant (the index
    itself is tiny), so a large archive is read by several tasks, and each task reads its ranges in order.
    """
    columns = RECORD if payloads else RECORD.rsplit(", ", 1)[0]
    width = columns.count(",") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            rows_of = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            for name, part in groupby(rows_of, lambda r: r[0]):
                _, offsets, lengths = map(list, zip(*part, strict=True))
                with store.open_input_file(f"{root}/{name}") as archive:
                    for a, b in _ranges(offsets, lengths):
                        data = archive.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a])
                        rows = [
                            parse(data[offsets[n] - offsets[a] : offsets[n] - offsets[a] + lengths[n]])[:width]
                            for n in range(a, b)
                        ]
                        yield _batch(rows, columns)

    places = index.select("file", "offset", "length")
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    ordered = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, columns)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages, then read every record: one row per page with its record's facts."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, least)
    return read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )

