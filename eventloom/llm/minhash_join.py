"""MinHash near-duplicates by an inverted join over signature coordinates.

Every text becomes a set of word shingles; texts with equal sets are one class.  A class is posted under each
(coordinate, minimum) pair of its signature.  Two classes with at least ``matches`` equal coordinates share a posting
among the first ``coordinates - matches + 1`` of either in the order of rarity, so only that prefix is joined and the
long lists at its far end are skipped; the collisions of a pair met there are then counted on the whole signatures.

A list is not expanded into all its pairs.  Each member meets the list's centre, the member whose coordinates are the
most common, and links are confirmed on the full sets of words.  Members of one list that are still in different
components meet each other only if their sets can reach the similarity: two sets that share a centre differ from it
by nearly the same shingles, which a prefix join without a loss finds (:func:`near_pairs`); any other two meet once,
in the first list they share, and only if their signatures, compared by a few bits of each coordinate, leave enough
collisions possible (:func:`far_pairs`).  Texts are compared for pairs with enough counted collisions alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import checked_broadcast, freeing, map_texts, ship, stored, unused


@dataclass(frozen=True)
class Spec:
    """Shingle length in words, similarity in percent, signature length and the collisions a candidate needs.

    With 48 coordinates a pair at the similarity of 80 percent has 38 collisions on average; fewer than 24 have a
    probability of 2e-7.  Pairs with a centre are measured from ``measured`` collisions on: a pair at 60 percent has
    fewer than 14 with a probability of 1e-5.
    """

    shingle: int = 2
    percent: int = 80
    coordinates: int = 48
    matches: int = 24
    measured: int = 14
    seed: int = 11

    def __post_init__(self):
        if not 1 <= self.matches <= self.coordinates <= 64:
            raise ValueError("1 <= matches <= coordinates <= 64")

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int) -> frozenset[tuple[bytes, ...]]:
    """The full set: distinct runs of ``size`` words; fewer words are one shingle, no words none."""
    words = words_of(text)
    if len(words) <= size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[i:] for i in range(size)], strict=False))


class Signer:
    """64-bit shingle names, the class digest and the signature of a text."""

    def __init__(self, spec: Spec):
        import xxhash

        self.spec, self.name = spec, xxhash.xxh64_intdigest
        rng = np.random.default_rng(spec.seed)
        self.odd = rng.integers(0, 2**63, spec.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mask = rng.integers(0, 2**63, spec.coordinates, dtype=np.uint64)
        self.memo: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[word] = self.name(word, seed=3)
        return got

    def names(self, text: str | None) -> np.ndarray:
        """Sorted distinct names of the shingles."""
        words = words_of(text)
        n, size = len(words), self.spec.shingle
        if not n:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.word, words), np.uint64, n)
        size = min(size, n)
        out = np.full(n - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                out = (out ^ codes[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return np.unique(out)

    def tokens(self, names: np.ndarray) -> np.ndarray:
        """For each coordinate its minimum, with the coordinate in the low six bits."""
        low = np.full(self.spec.coordinates, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(names), 4096):
                mixed = (names[at : at + 4096, None] ^ self.mask) * self.odd
                mixed ^= mixed >> np.uint64(31)
                low = np.minimum(low, (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
        return (low & ~np.uint64(63)) | np.arange(self.spec.coordinates, dtype=np.uint64)


def marks_of(tokens: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate's minimum, sixteen coordinates to a number: unequal bits prove unequal minima."""
    bits = np.zeros(-(-len(tokens) // 16) * 16, np.uint64)
    bits[: len(tokens)] = tokens >> np.uint64(6) & np.uint64(15)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << shifts, axis=1)


def surely_unequal(x: Column, y: Column, spec: Spec) -> Column:
    """How many coordinates differ for sure, by the marks of two classes."""
    total = F.lit(0)
    for i in range(-(-spec.coordinates // 16)):
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        any_bit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def signed(documents: DataFrame, keys: Sequence[str], text: str, spec: Spec) -> DataFrame:
    """Per row: keys, ``n_shingles``, ``cls`` (digest of the set, null without words) and ``tokens`` (the postings) and ``marks``."""

    def start():
        signer = Signer(spec)

        def one(value: str | None) -> tuple:
            names = signer.names(value)
            if not len(names):
                return 0, None, None, None
            tokens = signer.tokens(names)
            return len(names), hashlib.blake2b(names.tobytes(), digest_size=16).digest(), tokens.view(np.int64), marks_of(tokens).view(np.int64)

        return one

    return map_texts(documents, keys, text, "n_shingles long, cls binary, tokens array<long>, marks array<long>", start)


def prefix_postings(classes: DataFrame, spec: Spec) -> DataFrame:
    """(cls, token, common) for the rarest coordinates of each class that others share; a coordinate of its own fills a
    place of the prefix.  ``common`` tells how common the class's coordinates are altogether."""
    postings = classes.select("cls", F.explode("tokens").alias("token"))
    # each posting is shuffled once by its token and, if shared, once by its class; nothing else is
    shared = postings.withColumn("freq", F.count("*").over(Window.partitionBy("token"))).where("freq > 1")
    of, rank = Window.partitionBy("cls"), Window.partitionBy("cls").orderBy("freq", "token")
    placed = shared.withColumn("place", F.row_number().over(rank)).withColumn("n", F.count("*").over(of)).withColumn("common", F.sum("freq").over(of))
    return placed.where(F.col("place") <= F.col("n") - F.lit(spec.coordinates - spec.prefix)).select("cls", "token", "common")


def both_sides(pairs: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored pairs (a, b) with the columns of either class, ``a_`` and ``b_`` before their names.

    Each side is fetched by itself and the two meet on the pair, so a class with many partners stays spread over tasks.
    """
    short = checked_broadcast(pairs.select("a", "b"))
    sides = [short.join(table.select(F.col("cls").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns]), k) for k in ("a", "b")]
    return sides[0].join(sides[1], ["a", "b"])


def colliding(pairs: DataFrame, classes: DataFrame, least: int, spec: Spec) -> DataFrame:
    """Distinct pairs (a, b) with the number m of equal coordinates, if ``least`` or more; their marks rule most others out first."""
    marks = classes.select("cls", "marks")
    for k in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("cls").alias(k), F.col("marks").alias(f"{k}_marks")), k)
    alike = pairs.where(surely_unequal(F.col("a_marks"), F.col("b_marks"), spec) <= spec.coordinates - least).select("a", "b")
    met = both_sides(stored(alike, "alike"), classes, ["tokens"])
    return met.select("a", "b", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("m")).where(F.col("m") >= least)


def sizes_allow(x: Column, y: Column, spec: Spec) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * spec.percent


def texts_of(wanted: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """(cls, text) for the wanted classes, from the row that stands for each."""
    some = checked_broadcast(stored(wanted.distinct().join(classes.select("cls", "id", "seal"), "cls"), "some"))
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.seal") == F.col("s.seal"))
    return stored(source.select("id", "seal", "text").alias("d").join(some.alias("s"), same).select("s.cls", "d.text").dropDuplicates(["cls"]), "texts")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))


def measure(pairs: DataFrame, texts: DataFrame, spec: Spec, difference: bool) -> DataFrame:
    """(a, b, na, nb, linked, diff) on the full shingle sets; ``diff``, if asked for, names the shingles that one of the two has alone."""
    ship(pairs.sparkSession)
    both = both_sides(pairs, texts, ["text"]).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(spec)
        for batch in batches:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for i in range(len(ta)):
                mine, other = shingle_set(ta[i], spec.shingle), shingle_set(tb[i], spec.shingle)
                common = len(mine & other)
                union = len(mine) + len(other) - common
                diff = np.setxor1d(signer.names(ta[i]), signer.names(tb[i]), assume_unique=True).view(np.int64) if difference else None
                out.append((len(mine), len(other), 100 * common >= spec.percent * union, diff))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["a", "b", "na", "nb", "linked", "diff"])

    return both.mapInArrow(freeing(run), "a long, b long, na long, nb long, linked boolean, diff array<long>")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the least class reachable over the links.  Least labels of neighbours, then labels of labels, until none changes."""
    ways = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(ways.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp")), "labels")
    while True:
        near = ways.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        step = stored(low.join(jump, "comp", "left").select("cls", "was", F.least("comp", "far").alias("comp")), "labels")
        labels = step.select("cls", "comp")
        if step.where("comp <> was").limit(1).count() == 0:
            return labels


def labelled(frame: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component of ``column``; a class without links is its own."""
    side = labels.select(F.col("cls").alias(column), F.col("comp").alias("__c"))
    return frame.join(side, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")


def rarest(rows: DataFrame, group: Sequence[str], keep: Column, short: Column) -> DataFrame:
    """Rows (x, size, elements, their number n and ``group`` columns) exploded to ``keep`` of their rarest elements; ``brief`` marks those among
    the first ``short``, ``at`` is the place among all ``n``.  Elements that no other row of the group has fill places and are left out."""
    each = rows.select("x", *group, F.explode("elements").alias("e"))
    freq = each.groupBy(*group, "e").agg(F.count("*").alias("freq")).where("freq > 1")
    listed = each.join(freq, [*group, "e"]).groupBy("x", *group).agg(F.sort_array(F.collect_list(F.struct("freq", "e"))).alias("list"))
    listed = listed.join(rows.select("x", *group, "size", keep.alias("keep"), short.alias("short"), "n"), ["x", *group])
    own = F.col("n") - F.size("list")
    room = (F.col("keep") - own).cast("int")
    rest = listed.where(room > 0).select("x", *group, "size", "n", "short", own.alias("own"), F.posexplode(F.slice("list", F.lit(1), room)).alias("at", "p"))
    at = F.col("own") + F.col("at") + 1
    return rest.select("x", *group, "size", "n", at.alias("at"), (at <= F.col("short")).alias("brief"), F.col("p.e").alias("e"))


def near_pairs(measured: DataFrame, labels: DataFrame, spec: Spec) -> DataFrame:
    """Candidates among the members measured with one centre c of which one or both are not linked with it.

    Let D be the shingles in which a member differs from c.  x and y have the similarity s only if their difference
    |Dx| + |Dy| - 2 |Dx and Dy| is at most q (|x| + |y|) with q = (1 - s) / (1 + s).  If y is not linked with c,
    |Dy| > q (|y| + |c|), so |Dx and Dy| > (|Dx| + q (|c| - |x|)) / 2: x needs the prefix that this leaves, which is
    short.  A y that meets linked members has the bound |Dy| - q (|x| + |y|) with |x| <= |y| / s only, a long prefix.
    """
    s = spec.percent / 100
    q = (1 - s) / (1 + s)
    loose = measured.where("not linked").select("b").distinct()
    rows = measured.withColumn("n", F.size("diff")).join(loose, "b").select(F.col("a").alias("x"), F.col("b").alias("c"), "na", "nb", "linked", F.col("diff").alias("elements"), F.col("na").alias("size"), "n")
    n = F.col("n")
    short = n - F.greatest(F.lit(1), F.ceil((n + q * (F.col("nb") - F.col("na"))) / 2 - 1e-9)) + 1
    long = n - F.greatest(F.lit(1), F.ceil(n - q * (1 + 1 / s) * F.col("na") - 1e-9)) + 1
    posts = rarest(rows, ["c"], F.when(F.col("linked"), short).otherwise(F.greatest(short, long)), short)
    posts = posts.join(rows.select("x", "c", "linked"), ["x", "c"])
    one = F.col("l.linked") & ~F.col("r.linked") & F.col("l.brief") | F.col("r.linked") & ~F.col("l.linked") & F.col("r.brief")
    none = ~F.col("l.linked") & ~F.col("r.linked") & F.col("l.brief") & F.col("r.brief")
    return met(labelled(posts, labels, "x", "comp"), ["c", "e"], one | none, spec)


def far_pairs(lists: DataFrame, mixed: DataFrame, measured: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """Candidates of one list of which one or both are far from its centre, that is, have too few collisions with it.

    Such a member has no link with one that is linked with the centre, since the distance is a metric; so only members
    not linked with the centre come in, and pairs measured with it are left to :func:`near_pairs`.  Members meet by
    their marks: a pair with too many coordinates that differ for sure is never made.  A pair is made in the first of
    the lists that both are loose in; if that one leaves it to :func:`near_pairs`, the later ones need not make it.
    """
    seen = measured.select(F.col("a").alias("cls"), F.col("b").alias("first"), "linked", F.lit(True).alias("near"))
    loose = lists.join(mixed, "token", "left_semi").where("cls <> first").join(seen, ["cls", "first"], "left").where("not coalesce(linked, false)")
    rows = loose.join(classes.select("cls", "n_shingles", "marks"), "cls")
    rows = rows.select("token", F.col("cls").alias("x"), "comp", F.col("n_shingles").alias("size"), "marks", F.coalesce("near", F.lit(False)).alias("near"))
    before = F.collect_list("token").over(Window.partitionBy("x").orderBy("token").rowsBetween(Window.unboundedPreceding, -1))
    rows = stored(rows.withColumn("before", before), "loose")
    left, right = rows.alias("l"), rows.alias("r")
    far = surely_unequal(F.col("l.marks"), F.col("r.marks"), spec) <= spec.coordinates - spec.matches
    apart = (F.col("l.x") > F.col("r.x")) & (F.col("l.comp") != F.col("r.comp")) & ~(F.col("l.near") & F.col("r.near"))
    on = (F.col("l.token") == F.col("r.token")) & apart & sizes_allow(F.col("l.size"), F.col("r.size"), spec) & far
    return left.join(right, on & ~F.arrays_overlap("l.before", "r.before")).select(F.col("l.x").alias("a"), F.col("r.x").alias("b"))


def met(posts: DataFrame, on: Sequence[str], allowed: Column, spec: Spec) -> DataFrame:
    """Distinct pairs (a, b) of postings that meet in a list, are in different components and can be linked.

    The first element that two sets have in common must leave enough of either for the overlap that a link takes.
    """
    q = (100 - spec.percent) / (100 + spec.percent)
    left, right = posts.alias("l"), posts.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    takes = (F.col("l.n") + F.col("r.n") - q * (F.col("l.size") + F.col("r.size"))) / 2 - 1e-6
    enough = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) + 1 >= takes
    other = (F.col("l.x") > F.col("r.x")) & (F.col("l.comp") != F.col("r.comp")) & allowed & enough & sizes_allow(F.col("l.size"), F.col("r.size"), spec)
    for c in same:
        other = c & other
    return left.join(right, other).select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Spec = Spec(), also: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``also`` (other columns that name the row), ``n_shingles``, ``cls``, ``component_id``, ``kept``.

    Documents whose sets have ``percent`` or more of their union in common are linked; ``component_id`` is the least
    ``doc_id`` reachable and ``kept`` marks the document that has it.  Equal sets are one class and are expanded at
    the end only.  Null and empty texts have no set, are linked with nothing and stand for themselves.  Null ids count
    as no id: a component of nothing else has a null ``component_id`` and its rows are kept.  Repeated rows repeat.
    An empty table gives no rows; other columns, whatever their names, are not read.  Two different shingles of one
    text share a 64-bit name with a probability under 1e-9 for texts of 100,000 words; confirmation compares words.
    """
    source = documents.select(F.col(f"`{doc_id}`").alias("id"), *[F.col(f"`{c}`").alias(f"also_{i}") for i, c in enumerate(also)], F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("seal", F.unhex(F.md5(F.col("text").cast("binary"))))
    more = [f"also_{i}" for i in range(len(also))]
    rows = stored(signed(source, ["id", *more, "seal"], "text", spec), "signed")
    classes = stored(
        rows.where("cls is not null").groupBy(F.col("cls").alias("digest")).agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "seal")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks"))
        # a number is half of the digest in every table of classes and pairs
        .select(F.monotonically_increasing_id().alias("cls"), "digest", F.col("r.id").alias("id"), F.col("r.seal").alias("seal"), "n_shingles", "tokens", "marks"),
        "classes",
    )
    posts = stored(prefix_postings(classes, spec), "posts")
    firsts = stored(posts.groupBy("token").agg(F.max_by("cls", F.struct("common", "cls")).alias("first"), F.count("*").alias("n")).where("n > 1").select("token", "first"), "firsts")
    lists = posts.select("cls", "token").join(firsts, "token")

    star = lists.where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct()
    likely = stored(colliding(star, classes, spec.measured, spec), "likely")
    texts = texts_of(ends(likely), classes, source)

    # one centre for each class settles most of them
    best = stored(likely.groupBy("a").agg(F.max(F.struct("m", "b")).alias("top")).select("a", F.col("top.b").alias("b")), "best")
    measured = stored(measure(best, texts, spec, difference=True), "measured")
    labels = components(measured.where("linked").select("a", "b"))

    placed = labelled(lists, labels, "cls", "comp")
    mixed = stored(placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token"), "mixed")
    members = placed.join(mixed, "token").select("cls", "first").distinct()
    other = likely.select("a", "b").join(members.select(F.col("cls").alias("a"), F.col("first").alias("b")), ["a", "b"], "left_semi")
    other = stored(other.join(best, ["a", "b"], "left_anti"), "other")
    measured = stored(measured.union(measure(other, texts, spec, difference=True)), "measured")
    links = measured.where("linked").select("a", "b")
    labels = components(links)

    left = near_pairs(measured, labels, spec).union(far_pairs(labelled(lists, labels, "cls", "comp"), mixed, measured, classes, spec)).distinct()
    left = stored(colliding(left.join(measured.select("a", "b"), ["a", "b"], "left_anti"), classes, spec.matches, spec), "left")
    all_texts = texts.unionByName(texts_of(ends(left).join(texts.select("cls"), "cls", "left_anti"), classes, source))
    links = stored(links.union(measure(left, all_texts, spec, difference=False).where("linked").select("a", "b")), "links")
    labels = components(links)

    whole = labelled(classes.select("cls", "digest", "id"), labels, "cls", "comp")
    least = whole.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = whole.join(least, "comp").select(F.col("digest").alias("cls"), "component_id")
    out = rows.drop("tokens", "marks", "seal").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(doc_id), *[F.col(m).alias(c) for m, c in zip(more, also, strict=True)], "n_shingles", "cls",
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Spec = Spec()) -> DataFrame:
    """The documents without all but one of each group of near-duplicates: all columns, the row with the least id stays.

    Of rows that repeat id and text one stays.  Texts without words stay.
    """
    mark = unused(documents.columns, "__seal")
    keyed = documents.withColumn(mark, F.md5(F.col(f"`{text}`").cast("binary")))
    found = near_duplicates(keyed, doc_id, text, spec, [mark])
    decided = stored(
        found.groupBy(F.col(doc_id).alias("__id"), F.col(mark).alias("__mark")).agg(F.max("kept").alias("kept"), (F.count("*") > 1).alias("again"), F.max("n_shingles").alias("size")), "decided"
    )
    same = keyed[doc_id].eqNullSafe(F.col("__id")) & keyed[mark].eqNullSafe(F.col("__mark"))
    out = keyed.join(checked_broadcast(decided.where("not kept").select("__id", "__mark")), same, "left_anti")
    repeated = decided.where("kept and again and size > 0").select("__id", "__mark")
    if repeated.limit(1).count():
        named = checked_broadcast(repeated)
        out = out.join(named, same, "left_anti").unionByName(out.join(named, same, "left_semi").dropDuplicates([doc_id, mark]))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
