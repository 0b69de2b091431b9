"""Numeric laboratory summaries, derived ratios and series dynamics per person and window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantile, running_totals
from ..functions.skew import literal_table, lookup_join, salted_join
from .concepts import ConceptSpec, Vocabulary, resolve_all
from .windows import Window, cohort_windows, explode_matching, with_windows, within_cohort_dates


@dataclass(frozen=True)
class LabSpec:
    name: str
    concepts: tuple[ConceptSpec, ...]
    high: float | None = None
    low: float | None = None


def lab_specs(table: Mapping[str, tuple]) -> list[LabSpec]:
    """Rows of (codes, ids, high, low) to specifications."""
    out = []
    for name, (codes, ids, high, low) in table.items():
        parts = ([ConceptSpec(codes=tuple(codes))] if codes else []) + ([ConceptSpec(ids=tuple(ids))] if ids else [])
        out.append(LabSpec(name, tuple(parts), high, low))
    return out


def lab_membership(vocabulary: Vocabulary, specs: Sequence[LabSpec], last_wins: bool = True) -> DataFrame:
    """``(concept_id, lab, high, low)``; a concept shared by two labs belongs to the later one.

    ``last_wins=False`` gives a shared concept to every lab that lists it.
    """
    spark = vocabulary.spark
    members = resolve_all(vocabulary, {s.name: list(s.concepts) for s in specs})
    rows = [(s.name, i, s.high, s.low) for i, s in enumerate(specs)]
    params = literal_table(spark, rows, "set_id STRING, ordinal INT, high DOUBLE, low DOUBLE")
    joined = members.join(params, "set_id").withColumnRenamed("set_id", "lab")
    if not last_wins:
        return joined.select("concept_id", "lab", "high", "low")
    entry = F.max_by(F.struct("lab", "high", "low"), "ordinal").alias("_e")
    return joined.groupBy("concept_id").agg(entry).select("concept_id", "_e.lab", "_e.high", "_e.low")


def is_abnormal(value: Column | str = "value") -> Column:
    """Above the upper limit if there is one, else below the lower limit."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("high").isNotNull(), v > F.col("high")).when(F.col("low").isNotNull(), v < F.col("low")).otherwise(False)


def lab_summary(
    measurements: DataFrame, cohort: DataFrame, windows: Sequence[Window], members: DataFrame
) -> DataFrame:
    """Long result per (person, window, lab): peak, median, last, abnormal count and flag.

    Values are collapsed to distinct (person, lab, day, value) on the map side,
    met with the cohort by a join that splits heavy persons, and the median is
    read from running totals, so no group is held in memory.
    """
    near = within_cohort_dates(measurements, cohort, windows)
    numeric = near.where(F.col("value").isNotNull()).select("person_id", "concept_id", "event_date", "event_id", "value")
    rows = lookup_join(numeric, members, ["concept_id"], ["event_id"])
    cells = rows.groupBy("person_id", "lab", "high", "low", "event_date", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("event_id")
    )
    people = with_windows(cohort, windows)
    inside = explode_matching(salted_join(cells, people, ["person_id"], ["event_date", "value"], heavy=numeric))
    key = ["person_id", "window", "lab"]
    values = inside.groupBy(*key, "value").agg(
        F.sum("n").alias("n"),
        F.max(F.struct("event_date", "event_id")).alias("latest"),
        F.max(is_abnormal().cast("int")).alias("abnormal"),
    )
    ranked = running_totals(values, key, "value", ["n"])
    return ranked.groupBy(*key).agg(
        F.max("value").alias("peak"),
        quantile("value", 0.5).alias("median"),
        F.max_by("value", "latest").alias("last"),
        F.sum(F.col("n") * F.col("abnormal")).alias("abnormal_count"),
        F.max("abnormal").alias("abnormal_any"),
    )


LAB_STATS = ("measured", "peak", "median", "last", "abnormal_count", "abnormal_any")
ZERO_FILLED = ("measured", "abnormal_count", "abnormal_any")


def lab_matrix(summary: DataFrame, cohort: DataFrame, windows: Sequence[Window], labs: Sequence[str]) -> DataFrame:
    """Wide form, one row per person and window; every lab has every column."""
    every = cohort_windows(cohort, windows).select("person_id", "window")
    wide = summary.withColumn("measured", F.lit(1)).groupBy("person_id", "window").pivot("lab", list(labs)).agg(
        *[F.first(s).alias(s) for s in LAB_STATS]
    )
    full = every.join(wide, ["person_id", "window"], "left")

    def column(lab: str, stat: str) -> Column:
        c = F.col(f"`{lab}_{stat}`")
        c = F.coalesce(c, F.lit(0)) if stat in ZERO_FILLED else c
        return c.alias(f"f_lab_{lab}_{stat}")

    return full.select("person_id", "window", *[column(lab, s) for lab in labs for s in LAB_STATS])


# ------------------------------------------------------------------ daily components


def daily_components(
    measurements: DataFrame, cohort: DataFrame, windows: Sequence[Window], members: DataFrame, names: Sequence[str]
) -> DataFrame:
    """Mean of each component per (person, window, day)."""
    near = within_cohort_dates(measurements, cohort, windows)
    numeric = near.where(F.col("value").isNotNull()).select("person_id", "concept_id", "event_date", "event_id", "value")
    rows = lookup_join(numeric, members.select("concept_id", "lab"), ["concept_id"], ["event_id"])
    daily = rows.groupBy("person_id", "event_date").pivot("lab", list(names)).agg(F.avg("value"))
    return explode_matching(daily.join(with_windows(cohort, windows), "person_id"))


def with_ratios(daily: DataFrame) -> DataFrame:
    """NLR, PLR and SII of a day where the lymphocyte mean is positive."""
    neut, lymph, plt = F.col("neut"), F.col("lymph"), F.col("plt")
    ok = lymph > 0
    return (
        daily.withColumn("nlr", F.when(ok, neut / lymph))
        .withColumn("plr", F.when(ok, plt / lymph))
        .withColumn("sii", F.when(ok, plt * neut / lymph))
    )


def peak_and_median(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A person has at most one row per day and window here, so the exact median is a bounded buffer."""
    return daily.groupBy("person_id", "window").agg(
        *[c for name in columns for c in (F.max(name).alias(f"{name}_peak"), F.median(name).alias(f"{name}_median"))]
    )


def derived_ratios(daily: DataFrame) -> DataFrame:
    return peak_and_median(with_ratios(daily), ("nlr", "plr", "sii"))


def series_dynamics(
    daily: DataFrame, low_lymph: float = 1.0, high_mono: float = 1.0, high_eos: float = 0.5
) -> DataFrame:
    """Slopes, first-to-last change and threshold day counts of the daily series.

    A slope needs two distinct days: without them NLR stays null and the
    lymphocyte features are null below two rows.
    """
    d = with_ratios(daily)
    x = F.col("day").cast("double")
    lymph_day = F.when(F.col("lymph").isNotNull(), F.col("event_date"))
    n_lymph = F.count("lymph")
    return d.groupBy("person_id", "window").agg(
        F.regr_slope("nlr", x).alias("nlr_slope"),
        (F.count_if(F.col("lymph") < low_lymph) >= 2).cast("int").alias("persistent_lymphopenia"),
        F.count_if(F.col("lymph") < low_lymph).alias("low_lymph_count"),
        F.min("lymph").alias("lymph_min"),
        F.when(n_lymph >= 2, F.max_by("lymph", lymph_day) - F.min_by("lymph", lymph_day)).alias("lymph_delta"),
        F.when(n_lymph >= 2, F.regr_slope("lymph", x)).alias("lymph_slope"),
        (F.count_if(F.col("mono") > high_mono) >= 1).cast("int").alias("monocytosis"),
        F.count_if(F.col("mono") > high_mono).alias("high_mono_count"),
        F.max("mono").alias("mono_max"),
        (F.count_if(F.col("eos") > high_eos) >= 1).cast("int").alias("eosinophilia"),
        F.count_if(F.col("eos") > high_eos).alias("high_eos_count"),
        F.max("eos").alias("eos_max"),
        F.max("rdw").alias("rdw_peak"),
        F.median("rdw").alias("rdw_median"),
    )


def impaired_response(
    exposures: DataFrame, tests: DataFrame, cohort: DataFrame, windows: Sequence[Window],
    positive: Sequence[int], negative: Sequence[int],
) -> DataFrame:
    """Exposed by the window end, a negative on or after the first exposure, never positive in the window.

    ``exposures`` and ``tests`` are event rows; the result codes are parameters.
    """
    first = exposures.groupBy("person_id").agg(F.min("event_date").alias("exposed_on"))
    code = F.col("value_concept_id")
    daily = tests.where(code.isNotNull() | F.col("value").isNotNull()).groupBy("person_id", "event_date").agg(
        F.max(code.isin(*positive).cast("int")).alias("pos"), F.max(code.isin(*negative).cast("int")).alias("neg")
    )
    seen = explode_matching(daily.join(with_windows(cohort, windows), "person_id")).groupBy("person_id", "window").agg(
        F.max("pos").alias("pos"), F.max(F.when(F.col("neg") == 1, F.col("event_date"))).alias("last_neg")
    )
    every = cohort_windows(cohort, windows).select("person_id", "window", "window_end")
    df = every.join(first, "person_id", "left").join(seen, ["person_id", "window"], "left")
    hit = (
        (F.col("exposed_on") <= F.col("window_end"))
        & (F.col("last_neg") >= F.col("exposed_on"))
        & (F.coalesce("pos", F.lit(0)) == 0)
    )
    return df.select("person_id", "window", F.coalesce(hit, F.lit(False)).cast("int").alias("impaired_response"))
