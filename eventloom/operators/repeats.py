"""Seeded repeats: split, balance, prevalence filter, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.sampling import cut_in_parts, flag_first_k, with_hash
from ..functions.skew import literal_table
from .assemble import to_long

SEED_BASE, SEED_STEP = 42, 1000


def repeat_seeds(spark, n: int, base: int = SEED_BASE, step: int = SEED_STEP) -> DataFrame:
    return spark.range(n).select(
        F.col("id").cast("int").alias("iteration"), (F.lit(base) + F.col("id") * F.lit(step)).alias("seed")
    )


def seeds_of(n: int, base: int = SEED_BASE, step: int = SEED_STEP) -> list[int]:
    return [base + step * i for i in range(n)]


def with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Repeat every row once per seed (the repeats share nothing else)."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def stratified_split(rows: DataFrame, seeds: Sequence[int], share: float = 0.2, id_col: str = "person_id", label: str = "label") -> DataFrame:
    """``is_test`` per (seed, row): ceil(share * N) test rows, divided over the classes by largest remainder."""
    seeded = with_hash(with_seeds(rows.select(id_col, label), seeds), id_col, "seed")
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy()
    quota = F.col("_t") * F.col("n") / F.col("_total")
    # Two class rows: the windows over this table order a handful of rows.
    targets = (
        classes.withColumn("_total", F.sum("n").over(whole))
        .withColumn("_t", F.ceil(F.lit(float(share)) * F.col("_total")))
        .withColumn("_floor", F.floor(quota))
        .withColumn("_rest", quota - F.floor(quota))
        .withColumn("_rank", F.row_number().over(W.partitionBy().orderBy(F.desc("_rest"), label)))
        .withColumn("_left", F.col("_t") - F.sum("_floor").over(whole))
        .select(label, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("k"))
    )
    per_seed = with_seeds(targets, seeds)
    return flag_first_k(seeded, ["seed", label], per_seed, "is_test", id_col=id_col).drop("_hash")


def balance(train: DataFrame, id_col: str = "person_id", label: str = "label") -> DataFrame:
    """All positives and equally many negatives per seed; unchanged where a class is empty.

    ``train`` has (seed, id, label); the hash differs from the split's by its prefix.
    """
    counts = train.groupBy("seed").agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    usable = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    targets = counts.select("seed", F.when(usable, F.least("_pos", "_neg")).otherwise(F.col("_neg")).alias("k"))
    negatives = train.where(F.col(label) == 0).withColumn("_hash", F.md5(F.concat_ws(":", F.lit("b"), F.col(id_col).cast("string"), F.col("seed").cast("string"))))
    kept = flag_first_k(negatives, ["seed"], targets, "_keep", id_col=id_col).where("_keep = 1").drop("_keep", "_hash")
    return train.where(F.col(label) == 1).unionByName(kept)


def folds(rows: DataFrame, n: int = 5, id_col: str = "person_id", label: str = "label") -> DataFrame:
    """Stratified folds of each seed and class by hash; their sizes differ by at most one."""
    key = F.md5(F.concat_ws(":", F.lit("f"), F.col(id_col).cast("string"), F.col("seed").cast("string"), F.col(label).cast("string")))
    return cut_in_parts(rows.withColumn("_hash", key), ["seed", label], n, "fold", id_col=id_col).drop("_hash")


def column_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n_values, mean, is_binary) of all columns from one aggregation.

    A column without any value counts as binary and has no mean.
    """
    stats = []
    for f in features:
        c = F.col(f"`{f}`").cast("double")
        stats += [
            F.struct(
                F.lit(f).alias("feature"),
                F.count(c).alias("n_values"),
                F.avg(c).alias("mean"),
                (F.count_if(c.isNotNull() & ~c.isin(0.0, 1.0)) == 0).cast("int").alias("is_binary"),
            )
        ]
    return df.agg(F.array(*stats).alias("_s")).select(F.explode("_s").alias("s")).select("s.*")


def prevalence_filter(profile: DataFrame, min_prev: float = 0.01, forced: Sequence[str] = ()) -> DataFrame:
    """Adds ``kept``: binary columns below the prevalence go, all others and forced ones stay."""
    rare = (F.col("is_binary") == 1) & F.coalesce(F.col("mean") < min_prev, F.lit(False))
    keep = ~rare
    if forced:
        keep = keep | F.col("feature").isin(*forced)
    return profile.withColumn("kept", keep.cast("int"))


def kept_features(filtered: DataFrame, order: Sequence[str]) -> list[str]:
    kept = {r.feature for r in filtered.where("kept = 1").select("feature").collect()}
    return [f for f in order if f in kept]


def train_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Column medians of the training rows (one row per column on the driver)."""
    long = to_long(train.select(*[F.col(f"`{f}`") for f in features]), [], list(features))
    rows = exact_quantiles(long, ["feature"], "value", {"m": 0.5}).collect()
    return {r.feature: float(r.m) for r in rows}


def median_impute(df: DataFrame, medians: dict[str, float], features: Sequence[str]) -> DataFrame:
    """Fill with medians fitted on the training rows; a column without values gets 0."""
    return df.fillna({f: medians.get(f, 0.0) for f in features})


def median_table(spark, medians: dict[str, float]) -> DataFrame:
    return literal_table(spark, sorted(medians.items()), "feature STRING, median DOUBLE")
