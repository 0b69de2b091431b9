import tracemalloc

import pyarrow as pa

from eventloom.llm import forced_bpe
from eventloom.llm.common import ship


def test_batches_of_texts_stay_small(spark):
    ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('abcd', 1000) text")
    sizes = [r["size"] for r in texts.mapInArrow(run, "size long").collect()]
    assert sum(sizes) >= 12_000_000 and max(sizes) <= (2 << 20) + 100_000


def test_encoding_many_distinct_words_holds_few_of_them(monkeypatch):
    """A task that keeps ids keeps a small memo; the ids and the text do not depend on what it let go."""
    got = {}
    monkeypatch.setattr(forced_bpe, "map_texts", lambda docs, keys, text, made, start: got.update(start=start))
    path = forced_bpe.tokenizer_path("word_bpe_49k.json")
    forced_bpe.encode_documents(None, path)
    one = got["start"]()
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"{i * 7919 % 1_000_003:06}".translate(letters) for i in range(k, k + 1000)) for k in range(0, 120_000, 1000)]
    first = one(texts[0])
    tracemalloc.start()
    for t in texts:
        one(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert one(texts[0]) == first
    one.forget()
    assert held < 30e6, held
    plain = forced_bpe.ForcedBpe(path)
    for t in ("", "Ab <|endoftext|> Straße 12'll x", texts[-1]):
        ids = plain.encode(t)
        assert one(t) == (ids, plain.decode(ids))
