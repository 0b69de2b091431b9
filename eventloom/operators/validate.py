"""Checks of feature tables against their cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import literal_table


def prevalence(signals: DataFrame, prefix: str = "f_") -> DataFrame:
    """Mean of every flag (feature, prevalence), from one aggregation."""
    names = [c for c in signals.columns if c.startswith(prefix)]
    row = signals.agg(*[F.avg(c).alias(c) for c in names])
    return row.unpivot([], names, "feature", "prevalence")


def top_and_bottom(prevalences: DataFrame, n: int = 15) -> DataFrame:
    """The report of the n most and n least frequent flags."""
    top = prevalences.orderBy(F.desc("prevalence"), "feature").limit(n).withColumn("side", F.lit("top"))
    low = prevalences.orderBy("prevalence", "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def validate_signals(signals: DataFrame, cohort: DataFrame, prefix: str = "f_") -> DataFrame:
    """Number of violations per rule: duplicate ids, id sets, names, types, nulls, values outside 0/1."""
    features = [c for c in signals.columns if c not in ("person_id", "window")]
    types = dict(signals.dtypes)
    by_schema = [
        ("bad_name", sum(not c.startswith(prefix) for c in features)),
        ("not_integer", sum(types[c] not in ("int", "bigint", "tinyint", "smallint") for c in features)),
    ]
    ids = signals.select("person_id")
    duplicates = ids.groupBy("person_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    missing = cohort.select("person_id").join(ids, "person_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    unknown = ids.join(cohort.select("person_id"), "person_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    nulls = [F.count_if(F.col(c).isNull()) for c in features]
    outside = [F.count_if(~F.col(c).isin(0, 1)) for c in features]
    values = signals.agg(
        sum(nulls, F.lit(0)).cast("long").alias("nulls"), sum(outside, F.lit(0)).cast("long").alias("not_binary")
    ).unpivot([], ["nulls", "not_binary"], "rule", "n")
    out = literal_table(signals.sparkSession, by_schema, "rule STRING, n BIGINT").unionByName(values)
    for rule, df in (("duplicate_id", duplicates), ("missing_id", missing), ("unknown_id", unknown)):
        out = out.unionByName(df.select(F.lit(rule).alias("rule"), "n"))
    return out


def compare_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids only on one side and columns whose presence or type differs."""
    only_a = a.select("person_id").distinct().join(b.select("person_id"), "person_id", "left_anti")
    only_b = b.select("person_id").distinct().join(a.select("person_id"), "person_id", "left_anti")
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    schema = [
        ("columns_only_in_a", len(set(ta) - set(tb))),
        ("columns_only_in_b", len(set(tb) - set(ta))),
        ("type_differs", sum(ta[c] != tb[c] for c in set(ta) & set(tb))),
    ]
    out = literal_table(a.sparkSession, schema, "check STRING, n BIGINT")
    for name, df in (("ids_only_in_a", only_a), ("ids_only_in_b", only_b)):
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n"))
    return out


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")


def verify_partition(df: DataFrame, bands: list[str]) -> DataFrame:
    """Rows per number of set bands: exclusive means no row above 1; rows at 0 form the last band."""
    total = sum((F.coalesce(F.col(b), F.lit(0)) for b in bands[1:]), F.coalesce(F.col(bands[0]), F.lit(0)))
    sums = df.select(total.alias("_t"), *bands)
    return sums.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_t") > 1).alias("n_overlapping"),
        F.count_if(F.col("_t") == 0).alias("n_outside"),
        *[F.coalesce(F.sum(b), F.lit(0)).alias(f"n_{b}") for b in bands],
    )
