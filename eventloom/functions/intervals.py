"""Joins of dates and intervals of the same key by an index of time buckets.

Time is cut into buckets of fixed length.  A date lies in one, an interval is dealt to all that it touches, and rows meet
by (key, bucket) only: a person with half of all rows is spread over time.  Two intervals meet in every bucket they share and
count in the first of them.  A bucket that still holds very many rows is cut into slices by the rows' hash, and the rows of the
other side that belong to it are repeated once per slice.  Nothing is read while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_DAYS = 32
SLICE_ROWS = 500_000
"""Rows of one (key, bucket) that go to one task."""


def bucket_of(date: Column | str, days: int = BUCKET_DAYS) -> Column:
    return F.floor(F.unix_date(F.col(date) if isinstance(date, str) else date) / F.lit(days)).cast("int")


def reach(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: the first and the last day of the rows."""
    return F.broadcast(rows.agg(F.min(F.least(start, end)).alias("_low"), F.max(F.greatest(start, end)).alias("_high")))


def in_buckets(rows: DataFrame, start: str, end: str, bounds: DataFrame, days: int = BUCKET_DAYS) -> DataFrame:
    """Repeat each interval for the buckets it touches (``_bucket``) between the bounds, so that open ends cost no more; ``_first`` is the first of them.

    Intervals without both ends, or outside the bounds, go.
    """
    low, high = F.greatest(F.least(start, end), "_low"), F.least(F.greatest(start, end), "_high")
    whole = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).crossJoin(bounds).where(low <= high)
    dealt = whole.withColumn("_first", bucket_of(low, days)).withColumn("_bucket", F.explode(F.sequence(F.col("_first"), bucket_of(high, days))))
    return dealt.drop("_low", "_high")


def sliced(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Sequence[str], slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_slice``: rows of ``many`` by the hash of ``spread``, rows of ``few`` once for each slice of their key.

    Slices are as many as the key has ``slice_rows`` rows; sizes are combined on the map side, and few keys have more than one.
    """
    keys = list(keys)
    sizes = many.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("int").alias("_slices")).where("_slices > 1")
    count = F.coalesce("_slices", F.lit(1))
    left = many.join(sizes, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(*spread), count).cast("int")).drop("_slices")
    right = few.join(sizes, keys, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), count - 1))).drop("_slices")
    return left, right


def inside_any(
    rows: DataFrame, intervals: DataFrame, keys: Sequence[str], date: str, start: str, end: str, days: int = BUCKET_DAYS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Rows whose date lies in one of the key's intervals, ends included; each row once, null dates and keys never."""
    keys = list(keys)
    bounds = reach(rows, F.col(date), F.col(date))
    stays = in_buckets(intervals.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_to")), "_from", "_to", bounds, days)
    dated = rows.withColumn("_bucket", bucket_of(date, days))
    left, right = sliced(dated, stays, [*keys, "_bucket"], [date, *rows.columns[:4]], slice_rows)
    right = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.col("_slice").alias("_s"), "_from", "_to")
    on = (F.col("_bucket") == F.col("_b")) & (F.col("_slice") == F.col("_s")) & F.col(date).between(F.col("_from"), F.col("_to"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    return left.join(right, on, "left_semi").select(*rows.columns)


def overlaps(
    many: DataFrame, few: DataFrame, keys: Sequence[str], start: str, end: str, other_start: str, other_end: str, days: int = BUCKET_DAYS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Pairs of rows of one key whose intervals have a day in common; each pair once, in the first bucket they share."""
    keys = list(keys)
    a = in_buckets(many, start, end, reach(few, F.col(other_start), F.col(other_end)), days).withColumnRenamed("_first", "_first_a")
    b = in_buckets(few, other_start, other_end, reach(many, F.col(start), F.col(end)), days).withColumnRenamed("_first", "_first_b")
    left, right = sliced(a, b, [*keys, "_bucket"], [start, end, *many.columns[:4]], slice_rows)
    met = left.join(right, [*keys, "_bucket", "_slice"])
    once = F.col("_bucket") == F.greatest("_first_a", "_first_b")
    shared = (F.col(start) <= F.col(other_end)) & (F.col(end) >= F.col(other_start))
    return met.where(once & shared).drop("_bucket", "_slice", "_first_a", "_first_b")
