"""WARC archives: a writer with revisit records, and a reader that goes on after damage.

Each record is a gzip member of its own (or stands plain).  Where a member, a length or a digest fails its check, the
reader searches for the next member or version line that starts a valid record and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import checked_broadcast, freeing, shared_path, ship, stored
from eventloom.llm.stores import attempt_name, read_whole, write_whole

FILE_BYTES = 16 << 20
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}|{url}')}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int = 5) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    plain = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    if not level:
        return plain
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(plain) + packer.flush()


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object | None, revisit: bool, date: str, level: int = 5) -> bytes:
    """A response with its payload, or a revisit with the response's headers only; both name the full payload's size and digest."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    if page_id is not None:
        headers.append(("Page-Id", quote(str(page_id))))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"))
    if revisit:
        headers.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            headers.append(("Refers-To-Page-Id", quote(str(refers_to))))
    headers.append(("Content-Type", "application/http; msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, block if revisit else block + payload, level)


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


def inflate(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The content of the gzip member at a position, and where it ends."""
    opener, out, place = zlib.decompressobj(31), [], at
    try:
        while not opener.eof:
            piece = data[place : place + step]
            if not len(piece):
                raise Damaged("member cut off")
            out.append(opener.decompress(piece))
            place += len(piece)
    except zlib.error as error:
        raise Damaged(f"gzip: {error}") from None
    return b"".join(out), place - len(opener.unused_data)


def fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at a position; its length and digests are tested."""
    if bytes(data[at : at + len(VERSION)]) != VERSION:
        raise Damaged("no version line")
    stop, window = -1, 1 << 12
    while stop < 0:
        stop = bytes(data[at : at + window]).find(b"\r\n\r\n")
        if at + window >= len(data):
            break
        window *= 16
    if stop < 0:
        raise Damaged("headers without end")
    headers = fields(bytes(data[at : at + stop]))
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no length")
    begin = at + stop + 4
    end = begin + int(headers["content-length"])
    block = bytes(data[begin:end])
    if len(block) < end - begin or bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Damaged("length does not meet the record's end")
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and digest_of(block) != want[5:]:
        raise Damaged("block digest")
    if headers.get("warc-type") == "response":
        want = headers.get("warc-payload-digest", "")
        if want.startswith("sha1:") and digest_of(block.partition(b"\r\n\r\n")[2]) != want[5:]:
            raise Damaged("payload digest")
    return headers, block, end + 4


def record_at(view: memoryview, at: int) -> Record:
    if bytes(view[at : at + 2]) == GZIP[:2]:
        plain, end = inflate(view, at)
        headers, block, used = parse(plain, 0)
        if used != len(plain):
            raise Damaged("bytes after the record in its member")
        return Record(at, end, headers, block)
    headers, block, end = parse(view, at)
    return Record(at, end, headers, block)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records in order; a gap stands for the bytes from a failed check to the next valid record or the end."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            record = record_at(view, at)
        except Damaged as damage:
            start, found = at, None
            while found is None:
                marks = [m for m in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if m >= 0]
                if not marks:
                    break
                at = min(marks)
                try:
                    found = record_at(view, at)
                except Damaged:
                    continue
            yield Gap(start, at if found else len(data), str(damage))
            if found is None:
                return
            record = found
        yield record
        at = record.end


def with_revisits(pages: DataFrame, page_id: str, html: str, least: int) -> DataFrame:
    """(page_id, payload, type, refers): of equal payloads of at least ``least`` bytes the largest id is the response."""
    rows = pages.withColumn("payload", F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")).withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.max(page_id).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(checked_broadcast(stored(groups, "equal")), "sha", "left")
    again = (F.length("payload") >= least) & F.col("top").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("top"))
    return joined.withColumn("revisit", again).withColumn("refers", F.when(again, F.col("top")))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row in gzip archives; returns the table of files (path, records).

    The payload is the html in UTF-8, null is empty.  Rows that share the largest id of equal payloads are all
    responses; rows of a group without any id are too.  A null id can be no response beside others, a null url is
    left out.  An empty table writes no file; other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    picked = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"))
    rows = with_revisits(picked, "id", "html", least).select(F.col("id").cast("string").alias("id"), "url", "payload", "revisit", F.col("refers").cast("string").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, size, number, count = attempt_name(), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder.rstrip('/')}/{name}-{number:05d}.warc.gz"
            info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            write_whole(path, info + b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for i, u, payload, revisit, refers in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                parts.append(page_record(i, u, payload, refers, revisit, date))
                size, count = size + len(parts[-1]), count + 1
                if size >= file_bytes:
                    yield close()
                    parts, size, number, count = [], 0, number + 1, 0
        if parts:
            yield close()

    return stored(rows.mapInArrow(freeing(run), "path string, records long"), "archives")


SCHEMA = "path string, start long, end long, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, gap string"


def rows_of(path: str, data: bytes) -> Iterator[tuple]:
    for r in salvage(data):
        if isinstance(r, Gap):
            yield path, r.start, r.end, None, None, None, None, None, None, r.reason
            continue
        kind = r.headers.get("warc-type", "")
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = r.block.partition(b"\r\n\r\n")
        size = fields(head).get("content-length", "") if kind == "revisit" else str(len(payload))
        opened = [None if (v := r.headers.get(k)) is None else unquote(v) for k in ("page-id", "refers-to-page-id")]
        digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or digest_of(payload)
        yield path, r.start, r.end, kind, opened[0], r.headers.get("warc-target-uri"), int(size) if size.isdigit() else None, digest, opened[1], None


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_archives(files: DataFrame, whole: bool = False) -> DataFrame:
    """Records and gaps of the archives of a table of paths; a row with ``gap`` set is a quarantined range of bytes.

    ``whole`` asks that each file has no gap and the number of page records that the table's ``records`` states; else the query fails.
    """
    spark = files.sparkSession
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *stated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(rows_of(path, read_whole(path)))
                gaps = sum(r[-1] is not None for r in rows)
                if whole and (gaps or len(rows) != stated[0]):
                    raise ValueError(f"{path}: {gaps} gaps, {len(rows) - gaps} of {stated[0]} records")
                yield to_batch(rows)

    return files.select("path", *["records"] * whole).repartition(parts, F.xxhash64("path")).mapInArrow(freeing(run), SCHEMA)


def read_foreign(spark: SparkSession, pattern: str) -> DataFrame:
    """The same for archives in any store that Spark reads, one file of at most 2 GB per row."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield to_batch(list(rows_of(path, data.as_py())))

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(freeing(run), SCHEMA)


def round_trip(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Write archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[page_id]
    back = read_archives(write_archives(pages, shared_path(spark, "warc"), page_id), whole=True)
    return back.select(F.col("page_id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
