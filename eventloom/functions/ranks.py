"""Running totals, ranks and exact quantiles that never order a whole group in one task.

The input is first collapsed to one row per distinct value of a group.  Values
then fall into narrow ranges by a fixed monotone function of the value, about a
quarter of a percent wide.  Every (group, range) is ordered on its own, and the
totals of the lower ranges of the group, a few thousand rows at most, are added.
A group that holds a third of all rows is thus spread over hundreds of tasks,
and a recomputed task assigns the same ranges again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES_PER_E = 400
_SMALLEST = 1e-6


def value_range(value: Column) -> Column:
    """Number of the value's range; rises with the value, NaN comes last."""
    size = F.floor(F.least(F.lit(1e6), F.log1p(F.abs(value) / F.lit(_SMALLEST)) * F.lit(float(RANGES_PER_E))))
    number = F.when(value < 0, -size).otherwise(size)
    return F.when(F.isnan(value), F.lit(10_000_000)).otherwise(number).cast("long")


def running_totals(distinct: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller values) and ``<m>_total`` for each measure.

    ``distinct`` must hold one row per (keys, value).
    """
    keys, measures = list(keys), list(measures)
    ranged = distinct.withColumn("_range", value_range(F.col(value).cast("double")))
    parts = ranged.groupBy(*keys, "_range").agg(*[F.sum(m).alias(f"_part_{m}") for m in measures])
    group = W.partitionBy(*keys)
    lower = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_range").alias("_at"),
        *[F.coalesce(F.sum(f"_part_{m}").over(lower), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_part_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    before = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(offsets, same).select(
        *distinct.columns,
        *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(before), F.lit(0))).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def suffix_minima(distinct: DataFrame, keys: Sequence[str], value: str, measure: str, out: str) -> DataFrame:
    """Add ``out``: the least ``measure`` over the rows of the group at or above the row's value, one row per (keys, value).

    The least measure of every range is taken first; a row needs that of the higher ranges and a reverse pass over its own range.
    """
    keys = list(keys)
    ranged = distinct.withColumn("_range", value_range(F.col(value).cast("double")))
    lows = ranged.groupBy(*keys, "_range").agg(F.min(measure).alias("_low"))
    higher = W.partitionBy(*keys).orderBy("_range").rowsBetween(1, W.unboundedFollowing)
    borders = lows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_at"), F.min("_low").over(higher).alias("_above"))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    own = F.min(measure).over(W.partitionBy(*keys, "_range").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, 0))
    return ranged.join(borders, same).withColumn("_own", own).select(*distinct.columns, F.least("_own", "_above").alias(out))


def range_splitters(rows: DataFrame, keys: Sequence[str], value: str, parts: int, per_part: int = 32) -> DataFrame:
    """(keys, ``_cuts``): ``parts - 1`` or fewer ascending values that cut each group into about equal parts.

    They are quantiles of a sample of the distinct values, some ``parts * per_part`` a group, picked by the value's
    hash: partial samples merge, and a recomputed task finds the same cuts.  Only the balance hangs on them.
    """
    keys, scale = list(keys), 1 << 30
    usable = rows.where(F.col(value).isNotNull()).select(*keys, value)
    wanted = parts * per_part
    rates = usable.groupBy(*keys).agg(F.least(F.lit(1.0), F.lit(float(wanted)) / F.count(F.lit(1))).alias("_rate"))
    picked = usable.withColumn("_h", F.pmod(F.xxhash64(F.col(value), F.lit("cut")), F.lit(scale)))
    same = picked.join(rates, keys) if keys else picked.crossJoin(rates)
    sample = same.where(F.col("_h") < F.col("_rate") * scale).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda i: F.get("_s", F.floor(i * F.size("_s") / F.lit(parts)).cast("int")))
    cuts = F.array_distinct(F.array_compact(at)) if parts > 1 else F.slice("_s", 1, 0)
    return rates.drop("_rate").join(sample, keys, "left").select(*keys, F.coalesce(cuts, F.slice("_s", 1, 0)).alias("_cuts"))


def in_range(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the number of the value's range, from 0: the cuts at or below it.  Rows of groups without cuts go."""
    number = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col(value)))
    return rows.join(cuts, list(keys)).withColumn(name, number).drop("_cuts")


def _at_rank(value: Column, weight: str, rank: Column) -> Column:
    inside = (F.col(f"{weight}_before") <= rank) & (rank < F.col(f"{weight}_before") + F.col(weight))
    return F.max(F.when(inside, value))


def quantile(value: str, prob: float, weight: str = "n") -> Column:
    """Linear-interpolation quantile as an aggregate over rows from :func:`running_totals`."""
    position = (F.col(f"{weight}_total") - F.lit(1)) * F.lit(float(prob))
    low, high = F.floor(position), F.ceil(position)
    lower = _at_rank(F.col(value), weight, low)
    upper = _at_rank(F.col(value), weight, high)
    return lower + (upper - lower) * F.max(position - low)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per group: one output column per entry of ``probs``."""
    keys = list(keys)
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    distinct = usable.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(distinct, keys, value, ["n"])
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n_values"), *[quantile(value, p).alias(name) for name, p in probs.items()]
    )
