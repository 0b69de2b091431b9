"""Paired comparison of configurations over repeats, with false-discovery control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles, running_totals, suffix_minima
from ..functions.skew import literal_table
from ..functions.stats import two_sided_p


def pair_table(spark, groups: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    rows = [(g, a, b) for g, pairs in groups.items() for a, b in pairs]
    return literal_table(spark, rows, "grp STRING, config_a STRING, config_b STRING")


def metric_rows(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    ids = [c for c in ("config", "feature_window", "iteration", "seed") if c in results.columns]
    return results.select(*ids, *metrics).unpivot(ids, list(metrics), "metric", "score")


def paired_diff(results: DataFrame, pairs: DataFrame, metrics: Sequence[str] = ("auroc", "auprc"), check_seeds: bool = False) -> DataFrame:
    """metric(a) - metric(b) per shared (window, iteration); rows with a null metric are dropped.

    Both sides are joined on the repeat key.  With ``check_seeds`` differing seeds raise.
    """
    rows = metric_rows(results, metrics)
    key = ["feature_window", "iteration", "metric"]
    a = rows.withColumnsRenamed({"config": "config_a", "score": "score_a", "seed": "seed_a"})
    b = rows.withColumnsRenamed({"config": "config_b", "score": "score_b", "seed": "seed_b"})
    both = a.join(pairs, "config_a").join(b, [*key, "config_b"])
    if check_seeds:
        bad = both.where("seed_a <> seed_b").limit(5).collect()
        if bad:
            raise ValueError(f"seeds differ at iterations {[r.iteration for r in bad]}")
    diff = F.col("score_a") - F.col("score_b")
    return both.select("grp", "metric", "config_a", "config_b", "feature_window", "iteration", diff.alias("d")).where("d IS NOT NULL")


def wilcoxon(diffs: DataFrame, keys: Sequence[str], value: str = "d", digits: int = 12) -> DataFrame:
    """Two-sided signed-rank test: zeros dropped, average ranks, tie-corrected normal approximation.

    All differences zero gives p = 1.  Differences equal to ``digits`` places are
    ties, so the ranks do not hang on the last bit of a subtraction.
    """
    keys = list(keys)
    size = F.round(F.abs(value), digits)
    cells = diffs.where(F.round(value, digits) != 0).groupBy(*keys, size.alias("_a")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) > 0).alias("up")
    )
    ranked = running_totals(cells, keys, "_a", ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    stats = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n_used"),
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_ties"),
    )
    n = F.col("n_used").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    p = F.when(var > 0, two_sided_p((F.col("w_plus") - mean) / F.sqrt(var))).otherwise(F.lit(1.0))
    every = diffs.select(*keys).distinct().join(stats.withColumn("_p", p), keys, "left")
    return every.select(
        *keys, F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"),
        F.coalesce("_p", F.lit(1.0)).alias("p_value"),
    )


def benjamini_hochberg(rows: DataFrame, family: Sequence[str], p: str, out: str = "p_bh") -> DataFrame:
    """Step-up adjusted p-values within each family (a family is one reported table); a null p-value stays null and counts in no family.

    Distinct p-values are ranked in value ranges and the running minimum from above is taken over ranges first, so a family of
    any size is never ordered in one task.
    """
    family = list(family)
    cells = rows.where(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(cells, family, "_p", ["n"])
    scaled = ranked.select(*family, "_p", F.col("n_total").alias("bh_group_size"), (F.col("_p") * F.col("n_total") / (F.col("n_before") + F.col("n"))).alias("_adj"))
    least = suffix_minima(scaled, family, "_p", "_adj", "_least").select(*[F.col(f).alias(f"_f_{f}") for f in family], "_p", "bh_group_size", F.least(F.lit(1.0), F.col("_least")).alias(out))
    on = F.col(p) == F.col("_p")
    for f in family:
        on = on & F.col(f).eqNullSafe(F.col(f"_f_{f}"))
    return rows.join(least, on, "left").select(*rows.columns, "bh_group_size", out)


def paired_tests(
    results: DataFrame, groups: Mapping[str, Sequence[tuple[str, str]]], metrics: Sequence[str] = ("auroc", "auprc"),
    family: Sequence[str] = ("grp", "metric"), check_seeds: bool = False,
) -> DataFrame:
    """All pairs, windows and metrics in one plan."""
    diffs = paired_diff(results, pair_table(results.sparkSession, groups), metrics, check_seeds)
    key = ["grp", "metric", "config_a", "config_b", "feature_window"]
    spread = exact_quantiles(diffs, key, "d", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    share = diffs.groupBy(*key).agg(F.avg((F.col("d") > 0).cast("double")).alias("share_positive"))
    tested = wilcoxon(diffs, key).select(*key, F.col("p_value").alias("p_wilcoxon"))
    rows = spread.withColumnRenamed("n_values", "n_pairs").join(share, key).join(tested, key)
    out = benjamini_hochberg(rows, list(family), "p_wilcoxon")
    return out.withColumn("sig_bh", (F.col("p_bh") < 0.05).cast("int"))


def compare_estimators(first: DataFrame, second: DataFrame, metrics: Sequence[str] = ("auroc", "auprc")) -> DataFrame:
    """Two estimators on shared splits: per config, window and metric the paired differences second - first.

    Repeats are joined by iteration; seeds that differ raise, as the splits would.  Quartiles, the share of
    repeats in which the second wins, the signed-rank p-value and its step-up adjustment over the table of a metric.
    """
    key = ["config", "feature_window", "iteration", "metric"]
    a = metric_rows(first, metrics).withColumnsRenamed({"score": "_a", "seed": "_seed_a"})
    b = metric_rows(second, metrics).withColumnsRenamed({"score": "_b", "seed": "_seed_b"})
    both = a.join(b, key)
    if "_seed_a" in a.columns and "_seed_b" in b.columns:
        bad = both.where("_seed_a <> _seed_b").limit(5).collect()
        if bad:
            raise ValueError(f"seeds differ at iterations {[r.iteration for r in bad]}")
    diffs = both.select(*key, "_a", "_b", (F.col("_b") - F.col("_a")).alias("d")).where("d IS NOT NULL")
    group = ["metric", "config", "feature_window"]
    spread = exact_quantiles(diffs, group, "d", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("n_values", "n_pairs")
    share = diffs.groupBy(*group).agg(
        F.avg("_a").alias("mean_first"), F.avg("_b").alias("mean_second"), F.avg((F.col("d") > 0).cast("double")).alias("share_positive")
    )
    tested = wilcoxon(diffs, group).select(*group, F.col("p_value").alias("p_wilcoxon"))
    return benjamini_hochberg(spread.join(share, group).join(tested, group), ["metric"], "p_wilcoxon")


def compare_to_expected(tests: DataFrame, expected: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 5e-4) -> DataFrame:
    """Expected values next to the found ones; ``n_off`` counts those beyond the tolerance."""
    renamed = expected.select(*keys, *[F.col(v).alias(f"expected_{v}") for v in values])
    off = sum(
        ((F.abs(F.col(v) - F.col(f"expected_{v}")) > tolerance) | F.col(v).isNull()).cast("int") for v in values
    )
    return renamed.join(tests.select(*keys, *values), list(keys), "left").withColumn("n_off", F.coalesce(off, F.lit(len(values))))


def reproduce_or_stop(compared: DataFrame) -> DataFrame:
    bad = compared.where("n_off > 0").limit(5).collect()
    if bad:
        raise ValueError(f"results differ from the expected ones: {[r.asDict() for r in bad]}")
    return compared
