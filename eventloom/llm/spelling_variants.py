"""Spelling variants by PartEnum signatures: exact signatures of letter multisets, equal joins, verification.

A word is the binary vector of its letter multiset: one dimension for each letter and number of its occurrence.  A
replaced letter changes two dimensions, an inserted or deleted one changes one, so the vectors of two near words are at
most two apart.  The letters are dealt to ``PARTS`` groups; the two changes touch at most two of them, and for some choice of the
other groups the words agree there exactly.  Each choice gives a signature.  One edit also leaves the first or the last three
letters of words of six letters or more as they are, so each signature is made twice, with either end.  Words that
share a signature meet in an equal join, whose condition verifies the one edit.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import freeing, ship, stored

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A misspelt word is at least this many times rarer than its form.
RATIO = 5
#: One in so many (document, word) pairs loses a letter.
SLIP = 199
PARTS = 4
CHANGES = 2
END = 3
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000

#: The letters A-Z, a-z and U+00C0 to U+00FF in Latin-1; all else parts words.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, lowered in A-Z, as Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split() if text else []


def slipped(run: bytes, start: int, slip: int = SLIP) -> bytes:
    """The run, without one letter if its hash (crc32 continued from ``start``) is a multiple of ``slip``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of ``least_letters`` letters or more, after the slips."""
    ship(documents.sparkSession)
    picked = documents.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter([w for w in runs_of(value) if len(w) >= least_letters]).items():
                    word = slipped(word, start, slip)
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) >= HELD_WORDS:
                    yield handed()
        yield handed()

    return picked.mapInArrow(freeing(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt_letters(words: DataFrame, parts: int = PARTS) -> list[str]:
    """Letters in ``parts`` groups of about equal use; the alphabet has some ninety letters."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("c <> ''").orderBy(F.desc("n"), "c").collect()
    groups, load = [""] * parts, [0] * parts
    for r in used:
        least = load.index(min(load))
        groups[least] += r.c
        load[least] += r.n
    return groups


def signatures(words: DataFrame, groups: list[str], changes: int = CHANGES) -> DataFrame:
    """(key, word, n): a row for each choice of all but ``changes`` groups and for either end of the word."""
    everything = "".join(groups)
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    held = [F.translate("_letters", "".join(c for c in everything if c not in g) or " ", "") for g in groups]
    keys = []
    for number, kept in enumerate(itertools.combinations(range(len(groups)), max(1, len(groups) - changes))):
        shared = [F.get("_held", F.lit(i)) for i in kept]
        for side, end in ((0, F.substring("word", 1, END)), (1, F.expr(f"right(word, {END})"))):
            keys.append(F.xxhash64(F.lit(2 * number + side), *shared, end))
    rows = words.withColumn("_letters", letters).withColumn("_held", F.array(*held))
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("key"))


def near_words(words: DataFrame, parts: int = PARTS, changes: int = CHANGES) -> DataFrame:
    """(a, b, n_a, n_b), a < b: the pairs of ``words`` (word of six letters or more, n) that one edit parts."""
    signed = stored(signatures(words, dealt_letters(words, parts), changes), "signatures")
    left, right = signed.alias("x"), signed.alias("y")
    one_edit = (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")) & (F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1)
    met = left.join(right.hint("merge"), one_edit).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    return met.distinct()


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) of the words with a form: the end of the chain of forms, found by doubling the steps.

    A form is ``ratio`` times as frequent as its word, so a chain has at most the logarithm of the largest count of links.
    """
    links = max(1, math.ceil(math.log(max(most, 2), max(ratio, 2))) + 1)
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(1, links.bit_length())):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return at


def group_variants(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO,
    parts: int = PARTS, changes: int = CHANGES, slip: int = SLIP,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of six letters or more that occurs ``least_count`` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, lowered in A-Z.  A word's form is its most frequent near word (the least one on
    ties) if that is ``ratio`` times as frequent.  Null and empty texts hold no words; a null id counts as an empty one;
    repeated rows count again; an empty table gives no rows.  Other columns are not read.
    """
    counted = count_words(documents, doc_id, text, slip=slip)
    words = stored(counted.where(F.col("n") >= least_count), "words")
    pairs = stored(near_words(words, parts, changes), "near-words")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    )
    told = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    told = stored(told, "variants")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(told.where("form IS NOT NULL"), most, ratio)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
