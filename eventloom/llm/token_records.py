"""Token ids in length-delimited binary records, with an index of offsets for reads in any order.

A record is: length of the payload (u64), masked CRC-32C of these eight bytes (u32), payload, masked CRC-32C of the
payload (u32), all little-endian.  A payload is: number of bytes of the document's id (u32, all ones for null), the
id as UTF-8 text, bytes per token (u8), the tokens.  ``<file>.idx`` holds the offset of each record (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.checksums import crc32c, crc32c_many, masked
from eventloom.llm.common import freeing, shared_path, ship, stored
from eventloom.llm.stores import attempt_name, opened, write_whole

FILE_BYTES = 32 << 20
NULL_ID = 0xFFFFFFFF
END_OF_TEXT = "<|endoftext|>"


class ByteBpe:
    """Ids as the tokenizers library gives them for the byte-level vocabulary; ``ranks`` is the same vocabulary as ranks.

    The ranks library merges the words without keeping offsets and texts of tokens, in a fifth of the time.
    """

    def __init__(self, ranks: str, special: dict[str, int]):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
        self.width = 2 if max([*merges.values(), *special.values()]) < 1 << 16 else 4

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text, allowed_special=set(self.special)) if any(s in text for s in self.special) else self.coder.encode_ordinary(text)


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = crc32c_many(lengths), crc32c_many(payloads)
    return [n + struct.pack("<I", masked(int(h))) + p + struct.pack("<I", masked(int(t))) for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def payload_of(doc_id: object, ids: np.ndarray, width: int) -> bytes:
    name = None if doc_id is None else str(doc_id).encode()
    head = struct.pack("<I", NULL_ID) if name is None else struct.pack("<I", len(name)) + name
    return head + bytes([width]) + ids.astype(f"<u{width}").tobytes()


def parsed(payload: bytes) -> tuple[str | None, np.ndarray]:
    size = struct.unpack_from("<I", payload)[0]
    at = 4 + (0 if size == NULL_ID else size)
    name = None if size == NULL_ID else payload[4:at].decode()
    return name, np.frombuffer(payload, f"<u{payload[at]}", offset=at + 1)


class BadRecord(ValueError):
    pass


def records(data: memoryview | bytes) -> Iterator[bytes]:
    """Payloads in order of the file; both checksums of each are tested, those of payloads many at a time."""
    at, view, held = 0, memoryview(data), []

    def tested() -> Iterator[bytes]:
        sums = crc32c_many([p for p, _ in held])
        for (p, want), got in zip(held, sums, strict=True):
            if masked(int(got)) != want:
                raise BadRecord("checksum of a payload")
            yield p

    size = 0
    while at < len(view):
        head = bytes(view[at : at + 12])
        if len(head) < 12 or masked(crc32c(head[:8])) != struct.unpack_from("<I", head, 8)[0]:
            raise BadRecord(f"length at {at}")
        n = struct.unpack_from("<Q", head)[0]
        body = bytes(view[at + 12 : at + 12 + n])
        if len(body) < n or len(view) < at + 16 + n:
            raise BadRecord(f"end of file inside the record at {at}")
        held.append((body, struct.unpack_from("<I", view, at + 12 + n)[0]))
        at, size = at + 16 + n, size + n
        if size > 1 << 20:
            yield from tested()
            held, size = [], 0
    yield from tested()


def read_at(path: str, number: int) -> tuple[str | None, np.ndarray]:
    """One record, found by the index: a seek in each of two files."""
    system, place = opened(path)
    with system.open_input_file(place + ".idx") as index:
        index.seek(8 * number)
        offset = struct.unpack("<Q", index.read(8))[0]
    with system.open_input_file(place) as data:
        data.seek(offset)
        size = struct.unpack("<Q", data.read(8))[0]
        data.seek(offset)
        return parsed(next(records(data.read(size + 16))))


@dataclass
class Written:
    """The files in their order: partition, number, path, records, tokens, first (ids in all files before)."""

    files: DataFrame
    id_type: str


def write_records(
    documents: DataFrame, ranks: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, special: dict[str, int] | None = None,
    partitions: int | None = None, file_bytes: int = FILE_BYTES,
) -> Written:
    """Encode every whole text, append ``end_id`` and write the records in ascending order of ids.

    Null ids come first and null texts are empty (their record holds the end id).  Rows that repeat an id are ordered
    by the digest of their text, then by place of the input, which also spreads one id's rows over several tasks.
    """
    spark = documents.sparkSession
    ship(spark)
    special = {END_OF_TEXT: 50256} if special is None else special
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("seal", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), "seal", "place"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, name, task = ByteBpe(ranks, special), attempt_name(), TaskContext.get()
        chunks: list[bytes] = []
        offsets: list[int] = []
        size = tokens = number = 0

        def close() -> pa.RecordBatch:
            path = f"{folder.rstrip('/')}/{name}-{number:05d}.rec"
            write_whole(path, b"".join(chunks))
            write_whole(path + ".idx", np.array(offsets, "<u8").tobytes())
            values = [[task.partitionId() if task else 0], [number], [path], [len(offsets)], [tokens]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["partition", "number", "path", "records", "tokens"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 128):
                coded = [np.array([*coder.encode(t or ""), end_id], np.uint32) for t in texts[at : at + 128]]
                for record, codes in zip(framed([payload_of(i, c, coder.width) for i, c in zip(ids[at : at + 128], coded, strict=True)]), coded, strict=True):
                    offsets.append(size)
                    chunks.append(record)
                    size, tokens = size + len(record), tokens + len(codes)
                if size >= file_bytes:
                    yield close()
                    chunks, offsets, size, tokens, number = [], [], 0, 0, number + 1
        if offsets:
            yield close()

    made = stored(ranged.mapInArrow(freeing(run), "partition int, number int, path string, records long, tokens long"), "files")
    # one row per file: running totals inside a partition, then over the partitions' sums
    inside = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sums = made.groupBy("partition").agg(F.sum("tokens").alias("t"))
    before = sums.select("partition", F.coalesce(F.sum("t").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files = made.join(before, "partition").withColumn("first", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")
    return Written(files, dict(rows.dtypes)["id"])


def read_records(spark: SparkSession, written: Written, shuffled: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path, number) of every record, from the files; each checksum is tested.

    With ``shuffled`` (a seed) each task reads its files' records through the index in a random order.
    """
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = written.files.select("path", "first", "records").repartition(parts, F.xxhash64("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "path", "number"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for path, first, count in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                out: list[tuple] = []
                for number, (name, ids) in enumerate(whole(path)) if shuffled is None else picked(path, count, shuffled):
                    out.append((name, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path, number))
                    first += len(ids)
                if shuffled is not None:  # starts are known in the order of the file only
                    out = [(n, None, *rest) for n, _, *rest in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def whole(path: str) -> Iterator[tuple[str | None, np.ndarray]]:
        system, place = opened(path)
        with system.open_input_stream(place) as data:
            yield from map(parsed, records(data.read()))

    def picked(path: str, count: int, seed: int) -> Iterator[tuple[int, tuple[str | None, np.ndarray]]]:
        for number in np.random.default_rng([seed, zlib.crc32(path.encode())]).permutation(count):
            yield int(number), read_at(path, int(number))

    got = files.mapInArrow(freeing(run), "doc_id string, start long, n_tokens long, ids_crc32 long, path string, number long")
    return got.withColumn("doc_id", F.col("doc_id").cast(written.id_type))


def round_trip(documents: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to record files in the shared folder and read them back."""
    spark = documents.sparkSession
    return read_records(spark, write_records(documents, ranks, shared_path(spark, "records"), doc_id, text))
