import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import checksums, forced_bpe, token_records, warc_salvage


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert checksums.crc32c(b"123456789") == 0xE3069283
    parts = [os.urandom(random.Random(i).randint(0, 1200)) for i in range(60)] + [b"", b"a", bytes(16), bytes(256), bytes(257)]
    assert checksums.crc32c_many(parts).tolist() == [plain_crc32c(p) for p in parts]
    assert checksums.masked(0) == 0xA282EAD8


@pytest.fixture(scope="module")
def ranks():
    pytest.importorskip("public_tokenizers")
    return forced_bpe.tokenizer_path("byte_bpe_50k.tiktoken")


def test_records_round_trip(spark, frame, odd_rows, ranks, prose):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(forced_bpe.tokenizer_path("byte_bpe_50k.json"))
    rows = [*odd_rows, (7, "a<|endoftext|>b <|x"), (8, "  \n\n x  y\t'LL 12½ 한국 😀"), *[(i, prose(i, 9)) for i in range(9, 60)]]
    back = token_records.round_trip(frame(rows), ranks).collect()
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in back) == want
    at, last = 0, -1
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    assert token_records.round_trip(frame([]), ranks).count() == 0


def test_shuffled_reads_use_the_index(spark, frame, ranks, prose, tmp_path):
    written = token_records.write_records(frame([(i, prose(i, 5)) for i in range(400)]), ranks, str(tmp_path), partitions=2, file_bytes=300)
    straight = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.read_records(spark, written).collect()}
    mixed = token_records.read_records(spark, written, shuffled=3).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in mixed} == straight and len(mixed) == 400
    assert written.files.count() > 2


def test_damaged_records_are_refused(ranks):
    good = b"".join(token_records.framed([token_records.payload_of(i, np.arange(i * 3, dtype=np.uint32), 2) for i in range(5)]))
    assert [token_records.parsed(p)[0] for p in token_records.records(good)] == list("01234")
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(token_records.BadRecord):
            list(token_records.records(bytes(bad)))
    with pytest.raises(token_records.BadRecord):
        list(token_records.records(good[:-3]))


# ---- WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://a/ü\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "two\r\n\r\nWARC/1.1"), (None, "u", "<p>one</p>"), (None, None, "alone"), (6, "u", "three"), (6, "u", "three"), (7, "u", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id BIGINT, url STRING, html STRING, id STRING, payload STRING")
    back = warc_salvage.round_trip(pages).collect()
    top = {"<p>one</p>": 2, "": 4, "three": 6}
    want = Counter()
    for i, _, h in rows:
        data, t = (h or "").encode(), top.get(h or "")
        again = t is not None and i != t
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", t if again else None] += 1
    assert Counter(tuple(r) for r in back) == want
    assert warc_salvage.round_trip(pages.limit(0)).count() == 0


def test_long_headers_are_read_and_lost_records_fail(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/" + "é" * 200_000, "<p>a</p>"), (2, "http://x/2", "<p>b</p>")], "page_id BIGINT, url STRING, html STRING")
    assert sorted(r.page_id for r in warc_salvage.round_trip(pages).collect()) == [1, 2]
    files = warc_salvage.write_archives(pages, str(tmp_path / "w"), "page_id")
    assert warc_salvage.read_archives(files, whole=True).count() == 2
    with pytest.raises(Exception, match="of 3 records|of 2 records"):
        warc_salvage.read_archives(files.selectExpr("path", "records + 1 as records"), whole=True).collect()



def made(n, level=5):
    return [warc_salvage.page_record(i, f"http://x/{i}", b"<p>%d WARC/1.1 </p>" % i * 40, None, False, "2024-01-01T00:00:00Z", level) for i in range(n)]


@pytest.mark.parametrize("level", [0, 5])
def test_salvage_after_damage(level):
    rng = random.Random(3)
    for _ in range(40):
        parts = made(6, level)
        hurt = rng.randrange(6)
        at = rng.randrange(12, len(parts[hurt]) - 8)
        body = bytearray(parts[hurt])
        body[at] ^= 1 << rng.randrange(8)
        data = b"".join([*parts[:hurt], bytes(body), *parts[hurt + 1 :]])
        got = list(warc_salvage.salvage(data))
        records = [r for r in got if isinstance(r, warc_salvage.Record)]
        gaps = [g for g in got if isinstance(g, warc_salvage.Gap)]
        assert {r.headers["page-id"] for r in records} >= {str(i) for i in range(6) if i != hurt}
        assert sum(r.end - r.start for r in records) + sum(g.end - g.start for g in gaps) == len(data)
        assert len(gaps) <= 1 and (not gaps or gaps[0].start == sum(map(len, parts[:hurt])))


def test_salvage_of_cut_and_foreign_bytes():
    parts = made(3)
    data = b"noise" + parts[0] + b"\x1f\x8b\x08broken" + parts[1] + parts[2][:-20]
    got = list(warc_salvage.salvage(data))
    assert [type(x).__name__ for x in got] == ["Gap", "Record", "Gap", "Record", "Gap"]
    assert got[-1].end == len(data) and list(warc_salvage.salvage(b"")) == [] and len(list(warc_salvage.salvage(b"x" * 1000))) == 1


def test_foreign_archives_are_read_by_spark(spark, tmp_path):
    body = bytearray(b"".join(made(3)))
    body[len(made(1)[0]) + 30] ^= 255
    (tmp_path / "x.warc.gz").write_bytes(bytes(body))
    rows = warc_salvage.read_foreign(spark, str(tmp_path / "*.warc.gz")).collect()
    assert sorted(r.page_id for r in rows if r.gap is None) == ["0", "2"] and sum(r.gap is not None for r in rows) == 1
