"""Descriptive tables and summaries of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.skew import literal_table


def _grouped(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(characteristic, arm, value): each value once for everyone and once for its class."""
    long = df.select(label, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        [label], list(columns), "characteristic", "value"
    )
    arms = F.explode(F.array(F.lit("overall"), F.when(F.col(label) == 1, "pos").otherwise("neg")))
    return long.where(F.col("value").isNotNull()).withColumn("arm", arms)


def table_one(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], label: str = "label") -> DataFrame:
    """median (q1-q3) for continuous and n (pct) for binary rows, by arm."""
    cont = exact_quantiles(_grouped(df, continuous, label), ["characteristic", "arm"], "value", {"m": 0.5, "a": 0.25, "b": 0.75})

    def whole(c):
        return F.format_string("%d", F.bround(c).cast("long"))

    cont_text = F.concat(whole("m"), F.lit(" ("), whole("a"), F.lit("-"), whole("b"), F.lit(")"))
    share = _grouped(df, binary, label).groupBy("characteristic", "arm").agg(
        F.sum("value").cast("long").alias("n"), F.round(F.lit(100.0) * F.avg("value"), 1).alias("pct")
    )
    bin_text = F.concat(F.col("n").cast("string"), F.lit(" ("), F.format_string("%.1f", "pct"), F.lit("%)"))
    rows = cont.select("characteristic", "arm", cont_text.alias("text")).unionByName(
        share.select("characteristic", "arm", bin_text.alias("text"))
    )
    return rows.groupBy("characteristic").pivot("arm", ["overall", "pos", "neg"]).agg(F.first("text"))


def smd(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], label: str = "label") -> DataFrame:
    """Standardised difference between the classes from one aggregation of moments."""
    kinds = [(c, "cont") for c in continuous] + [(c, "bin") for c in binary]
    moments = _grouped(df, [c for c, _ in kinds], label).where("arm <> 'overall'").groupBy("characteristic").pivot(
        "arm", ["pos", "neg"]
    ).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    rows = moments.join(literal_table(df.sparkSession, kinds, "characteristic STRING, kind STRING"), "characteristic")
    pooled = F.sqrt((F.col("pos_v") + F.col("neg_v")) / 2.0)
    mid = (F.col("pos_m") + F.col("neg_m")) / 2.0
    spread = F.when(F.col("kind") == "cont", pooled).otherwise(F.sqrt(mid * (F.lit(1.0) - mid)))
    return rows.select("characteristic", "kind", F.when(spread > 0, (F.col("pos_m") - F.col("neg_m")) / spread).alias("smd"))


# The four reported groups.
HISPANIC, WHITE, BLACK, OTHER = "Hispanic / Latino", "Non-Hispanic white", "Non-Hispanic black", "Asian / other / unknown"


def race_buckets(person: DataFrame, concept: DataFrame) -> DataFrame:
    """Ethnicity first, then race, from the two concept names of a person."""
    names = concept.select("concept_id", F.lower("concept_name").alias("_n"))
    race = names.select(F.col("concept_id").alias("race_concept_id"), F.col("_n").alias("_race"))
    eth = names.select(F.col("concept_id").alias("ethnicity_concept_id"), F.col("_n").alias("_eth"))
    df = person.join(race, "race_concept_id", "left").join(eth, "ethnicity_concept_id", "left")
    r, e = F.coalesce("_race", F.lit("")), F.coalesce("_eth", F.lit(""))
    bucket = (
        F.when(e.contains("hispanic") & ~e.contains("not hispanic"), HISPANIC)
        .when(r.contains("white"), WHITE)
        .when(r.contains("black") | r.contains("african"), BLACK)
        .otherwise(OTHER)
    )
    return df.select("person_id", bucket.alias("race_bucket"))


def missingness_by_window(matrix: DataFrame, labs: Sequence[str], template: str = "f_lab_{lab}_measured") -> DataFrame:
    """Share of persons without a value per lab and window; a lab without column is "not recorded"."""
    present = [lab for lab in labs if template.format(lab=lab) in matrix.columns]
    shares = matrix.groupBy("window").agg(*[(F.lit(100.0) * (1 - F.avg(template.format(lab=lab)))).alias(lab) for lab in present])
    known = shares.unpivot(["window"], present, "lab", "pct_missing").withColumn("status", F.lit("recorded"))
    absent = [lab for lab in labs if lab not in present]
    if not absent:
        return known
    gone = matrix.select("window").distinct().select(
        "window", F.explode(F.array(*[F.lit(a) for a in absent])).alias("lab"), F.lit(None).cast("double").alias("pct_missing"),
        F.lit("not recorded").alias("status"),
    )
    return known.unionByName(gone)


def scalars(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Counts, prevalence and quantiles of chosen columns as (name, value) rows."""
    counts = df.agg(
        F.count(F.lit(1)).cast("double").alias("n_total"), F.sum(label).cast("double").alias("n_pos"),
        (F.lit(100.0) * F.avg(label)).alias("prevalence_pct"),
    ).unpivot([], ["n_total", "n_pos", "prevalence_pct"], "name", "value")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    q = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}).drop("n_values")
    rows = q.unpivot(["column"], ["p25", "p50", "p75", "p95"], "stat", "value").select(
        F.concat_ws("_", "column", "stat").alias("name"), "value"
    )
    return counts.unionByName(rows)


# ------------------------------------------------------------------ results over repeats


def summary_table(results: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("auroc", "auprc")) -> DataFrame:
    """Median, quartiles, mean and sd per key and metric."""
    long = results.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")
    group = [*keys, "metric"]
    q = exact_quantiles(long, group, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = long.groupBy(*group).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return q.withColumnRenamed("n_values", "n").join(m, group)


def lift_table(results: DataFrame, reference: str, metric: str = "auroc") -> DataFrame:
    """median(config) - median(reference) per window."""
    med = exact_quantiles(results, ["config", "feature_window"], metric, {"median": 0.5})
    ref = med.where(F.col("config") == reference).select("feature_window", F.col("median").alias("reference_median"))
    return med.where(F.col("config") != reference).join(ref, "feature_window").select(
        "config", "feature_window", "median", "reference_median", (F.col("median") - F.col("reference_median")).alias("lift")
    )


def selection_frequency(selections: DataFrame, keys: Sequence[str], catalogue: DataFrame | None = None, keep_min: int = 50) -> DataFrame:
    """How often a feature was selected; ``selections`` holds an array column ``features`` per repeat.

    With a catalogue of offered (keys, group, feature) rows the never selected ones appear with 0.
    """
    counts = selections.select(*keys, F.explode("features").alias("feature")).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_selected")
    )
    if catalogue is not None:
        shared = [c for c in [*keys, "feature"] if c in catalogue.columns]
        counts = catalogue.join(counts, shared, "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    return counts.withColumn("kept", (F.col("n_selected") >= keep_min).cast("int"))


def offered_and_kept(frequency: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frequency.groupBy(*keys).agg(F.count(F.lit(1)).alias("offered"), F.sum("kept").alias("kept"))


def mean_abs_importance(importance: DataFrame, keys: Sequence[str], n_repeats: int = 100) -> DataFrame:
    """Sum over repeats / number of repeats: a feature absent from a repeat counts as 0 there."""
    return importance.groupBy(*keys, "feature").agg((F.sum(F.abs("importance")) / F.lit(float(n_repeats))).alias("mean_abs"))


def top_features(means: DataFrame, windows: Sequence[str], order_by: str, k: int = 10) -> DataFrame:
    """The report of the union of each window's k most important features, ordered by one window."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("window").orderBy(F.desc("mean_abs"), "feature"))
    chosen = means.where(F.col("window").isin(*windows)).withColumn("_r", rank).where(F.col("_r") <= k).select("feature").distinct()
    at = means.where(F.col("window") == order_by).select("feature", "mean_abs")
    return chosen.join(at, "feature", "left").select("feature", F.coalesce("mean_abs", F.lit(0.0)).alias("mean_abs")).orderBy(
        F.desc("mean_abs"), "feature"
    )
