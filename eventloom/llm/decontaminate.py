"""Benchmark decontamination: an FM-index for each shard of the training texts, searched for the benchmark's windows.

Shards are built once and stored in the shared folder, and so are the windows in blocks of bounded size, each of which
is searched in every shard; a task meets pairs of a shard and a block.  Occurrences are located and merged into the spans of words to remove.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import checked_broadcast, freeing, map_texts, ship, stored, unused
from eventloom.llm.fm_index import FmIndex

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_WINDOWS = 100_000

#: Digits, a-z and all bytes of other scripts are parts of words; A-Z are lowered before.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Each run of ``size`` words; fewer words are one window, no words none."""
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (phrase, item); an item without an id has windows too."""

    def start():
        return lambda value: (list(dict.fromkeys(windows_of(value, size))),)

    found = map_texts(benchmark, [item_id], text, "phrases array<binary>", start)
    return found.select(F.explode("phrases").alias("phrase"), F.col(f"`{item_id}`").cast("string").alias("item")).distinct()


def window_blocks(windows: DataFrame, blocks: int) -> DataFrame:
    """One row per block, numbered from 0: its (phrase, item) windows, null for none."""
    numbers = windows.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    block = F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)).cast("int")
    held = windows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("phrase", "item")).alias("windows"))
    return numbers.join(held, "block", "left")


def build_shards(documents: DataFrame, keys: Sequence[str], text: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: the keys of its rows as lists, where each row's text stands, and the index.

    Equal texts of a shard are indexed once.
    """
    ship(documents.sparkSession)
    keys = list(keys)
    picked = documents.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    lists = [T.StructField(f"key_{i}", T.ArrayType(f.dataType)) for i, f in enumerate(picked.schema.fields[:-1])]
    rest = "shard string, place array<int>, lengths array<int>, size long, words binary, starts binary, levels binary, counts binary, marked binary, samples binary"
    schema = T.StructType([*lists, *T.StructType.fromDDL(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, task = to_arrow_schema(schema), TaskContext.get()
        number = total = 0
        held, place, texts, seen = [[] for _ in keys], [], [], {}

        def flush() -> pa.RecordBatch:
            index = FmIndex.build(texts).parts()
            row = {f"key_{i}": h for i, h in enumerate(held)} | index
            row |= {"shard": f"{task.partitionId() if task else 0}-{number}", "place": place, "lengths": [len(t) for t in texts]}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, value in zip(*columns, strict=True):
                value = value or ""
                if value not in seen:
                    words = words_of(value)
                    if total and total + len(words) > shard_words:
                        yield flush()
                        number, total = number + 1, 0
                        held, place, texts, seen = [[] for _ in keys], [], [], {}
                    seen[value] = len(texts)
                    texts.append(words)
                    total += len(words) + 1
                for h, k in zip(held, key, strict=True):
                    h.append(k)
                place.append(seen[value])
                if len(place) >= 50_000:  # rows of a shard, where one text repeats without end
                    yield flush()
                    number, total = number + 1, 0
                    held, place, texts, seen = [[] for _ in keys], [], [], {}
        if place:
            yield flush()

    return picked.mapInArrow(freeing(run), schema)


def search_block(phrases: list[bytes], items: list[list[str]], index: FmIndex, lengths: list[int]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each text of the shard: merged spans of words inside occurrences, and the items that occur."""
    search = index.ready()
    covered = np.zeros(index.size + 1, np.int64)
    pairs: list[np.ndarray] = []
    split = [p.split(b" ") for p in phrases]
    for size in sorted({len(p) for p in split}):
        which = np.array([i for i, p in enumerate(split) if len(p) == size])
        coded = np.array([[search.ids.get(w, -1) for w in split[i]] for i in which], np.int64)
        low, high = search.ranges(coded)
        n = high - low
        if not n.sum():
            continue
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = search.locate(rows)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
        text = np.searchsorted(index.starts, at, side="right") - 1
        pairs.append(np.unique(np.stack([text, np.repeat(which, n)]), axis=1))
    found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in lengths]
    if pairs:
        inside = np.cumsum(covered[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            t = int(np.searchsorted(index.starts, s, side="right") - 1)
            found[t][0].append((int(s - index.starts[t]), int(e - index.starts[t])))
        for t, p in np.concatenate(pairs, axis=1).T:
            found[t][1].update([i for i in items[p] if i is not None])
    return [(spans, sorted(names)) for spans, names in found]


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = 20, block_windows: int = BLOCK_WINDOWS, also: Sequence[str] = (),
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside occurrences), ``items``, ``spans`` (of words, merged), ``contaminated``.

    A text is contaminated if a word is hit and ``share * n_hit >= n_words``.  Null and empty texts have no words and
    are clean; items without words are never found, those without an id hit but are not listed; an empty benchmark finds nothing and an empty table of
    documents gives no rows.  Repeated rows repeat; items that repeat count once by id.  Other columns are not read.
    """
    keys = [doc_id, *also]
    shards = stored(build_shards(documents, keys, text), "shards")
    windows = stored(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    key_fields = [T.StructField(k, documents.schema[k].dataType) for k in keys]
    rest = "row string, n_words long, items array<string>, spans array<struct<start:int,end:int>>"
    schema = T.StructType([*key_fields, *T.StructType.fromDDL(rest).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(batch.num_rows):
                (shard,) = batch.slice(at, 1).to_pylist()
                by: dict[bytes, list[str]] = {}
                for w in shard["windows"] or ():
                    by.setdefault(bytes(w["phrase"]), []).append(w["item"])
                phrases = sorted(by)
                lengths = shard["lengths"]
                found = search_block(phrases, [by[p] for p in phrases], FmIndex.load(shard), lengths)
                place = shard["place"]
                keep = [i for i, p in enumerate(place) if shard["block"] == 0 or found[p][0]]
                columns = [[shard[f"key_{j}"][i] for i in keep] for j in range(len(keys))]
                columns += [[f"{shard['shard']}-{i}" for i in keep], [lengths[place[i]] for i in keep], [found[place[i]][1] for i in keep]]
                columns.append([[{"start": s, "end": e} for s, e in found[place[i]][0]] for i in keep])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # a product without broadcast: the windows never pass the driver
    pairs = shards.crossJoin(stored(window_blocks(windows, blocks), "blocks").hint("shuffle_replicate_nl"))
    out = pairs.mapInArrow(freeing(run), schema)
    if blocks > 1:
        # every row came once from the first block, and again from each that hit it
        named = [F.first(F.col(f"`{k}`"), ignorenulls=False).alias(k) for k in keys]
        out = out.groupBy("row").agg(*named, F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        start = F.expr("cast(array() as array<struct<start:int,end:int>>)")

        def join(done, span):
            last = F.element_at(done, -1)
            touch = (F.size(done) > 0) & (span["start"] <= last["end"])
            grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
            return F.when(touch, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

        out = out.withColumn("spans", F.aggregate("spans", start, join))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    out = out.withColumn("n_hit", hit)
    return out.select(*[F.col(f"`{k}`") for k in keys], "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows with equal id and text share their fate."""
    mark = unused(documents.columns, "__seal")
    keyed = documents.withColumn(mark, F.md5(F.col(f"`{text}`").cast("binary")))
    found = find_contamination(keyed, benchmark, doc_id, text, also=[mark], **settings)
    gone = stored(found.where("contaminated").select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{mark}`").alias("__mark")).distinct(), "contaminated")
    same = keyed[doc_id].eqNullSafe(F.col("__id")) & keyed[mark].eqNullSafe(F.col("__mark"))
    return keyed.join(checked_broadcast(gone), same, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def without_spans(text: str | None, spans: Sequence[tuple[int, int]]) -> str | None:
    """The text with the words of the spans, and what stands between them, cut out."""
    if not text or not spans:
        return text
    import re

    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : words[s][0]])
        at = words[e - 1][1]
    return "".join(out) + text[at:]
