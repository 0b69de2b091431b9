"""Index-dated cohorts: index event, outcome label, setting, windows, death, follow-up, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from .windows import overlapping

DAY_ZERO = "1970-01-01"

DEAD_BEFORE = "a_pre_index_ineligible"
DEAD_ACUTE = "b_in_acute_window"
DEAD_AFTER_OUTCOME = "d_post_outcome_true_positive"
DEAD_LATER = "post_acute_death"
ALIVE = "alive"
SYNTHETIC_CASE = "undocumented_index_case"


def plus_days(column: Column | str, days: int) -> Column:
    return F.date_add(column, days)


def index_events(dx: DataFrame, dx_ids: Sequence[int], tests: DataFrame, test_ids: Sequence[int], positive_ids: Sequence[int]) -> DataFrame:
    """Earliest of a diagnosis and a positive test; rows without a date do not count."""
    a = dx.where(F.col("concept_id").isin(*dx_ids)).select("person_id", "event_date")
    b = tests.where(F.col("concept_id").isin(*test_ids) & F.col("value_concept_id").isin(*positive_ids)).select(
        "person_id", "event_date"
    )
    both = a.unionByName(b).where(F.col("event_date").isNotNull())
    return both.groupBy("person_id").agg(F.min("event_date").alias("index_date"))


def exclude_members(cohort: DataFrame, excluded: DataFrame) -> DataFrame:
    return cohort.join(excluded.select("person_id"), "person_id", "left_anti")


def first_event(events: DataFrame, ids: Sequence[int], name: str) -> DataFrame:
    return events.where(F.col("concept_id").isin(*ids)).groupBy("person_id").agg(F.min("event_date").alias(name))


def observation_extent(periods: DataFrame) -> DataFrame:
    """``periods`` has (person_id, period_start, period_end)."""
    return periods.groupBy("person_id").agg(F.min("period_start").alias("obs_start"), F.max("period_end").alias("obs_end"))


def robust_cutoff(dates: DataFrame, column: str, q: float = 0.999) -> DataFrame:
    """Latest date not above the q-quantile, which drops far-future placeholders (one row)."""
    days = dates.where(F.col(column).isNotNull()).select(F.datediff(column, F.lit(DAY_ZERO).cast("date")).alias("_d"))
    cap = exact_quantiles(days.select(F.col("_d").cast("double").alias("_d")), [], "_d", {"cap": q})
    return days.where(F.col("_d") <= cap.select("cap").scalar()).agg(F.date_add(F.lit(DAY_ZERO).cast("date"), F.max("_d")).alias("data_cutoff"))


def label_outcome(cohort: DataFrame, first_outcome: DataFrame, min_days: int = 90) -> DataFrame:
    """1 iff the first outcome falls at least ``min_days`` after the index date."""
    late = F.datediff("first_outcome_date", "index_date") >= min_days
    return cohort.join(first_outcome.select("person_id", "first_outcome_date"), "person_id", "left").withColumn(
        "label", F.when(F.coalesce(late, F.lit(False)), 1).otherwise(0)
    )


def classify_setting(cohort: DataFrame, visits: DataFrame, types: Sequence[int], before: int = 1, after: int = 16) -> DataFrame:
    """Inpatient iff a qualifying visit overlaps [index - before, index + after]; discharge is the latest end."""
    stays = visits.where(F.col("concept_id").isin(*types)).select("person_id", "event_date", "end_date")
    hits = overlapping(
        stays, cohort.select("person_id", "index_date"), plus_days("index_date", -before), plus_days("index_date", after)
    )
    discharge = hits.groupBy("person_id").agg(F.max("visit_end").alias("discharge_date"))
    return cohort.join(discharge, "person_id", "left").withColumn(
        "is_inpatient", F.col("discharge_date").isNotNull().cast("int")
    )


def acute_window(cohort: DataFrame, end: int = 21, start: int = 0) -> DataFrame:
    """[index + start, index + end]; an inpatient's end moves to a later discharge."""
    default = plus_days("index_date", end)
    extended = F.when(F.col("is_inpatient") == 1, F.greatest(default, F.col("discharge_date"))).otherwise(default)
    return cohort.withColumn("acute_start", plus_days("index_date", start)).withColumn("acute_end", extended)


def death_and_followup(
    cohort: DataFrame, deaths: DataFrame, extent: DataFrame, cutoff: DataFrame, min_followup: int = 90
) -> DataFrame:
    """Death buckets, follow-up and censoring; deaths up to the end of the acute window are dropped.

    ``cutoff`` is the one-row table of :func:`robust_cutoff`.  A death after the
    outcome overwrites the acute-window bucket, yet such a row is dropped too.
    """
    df = (
        cohort.join(deaths.select("person_id", "death_date"), "person_id", "left")
        .join(extent.select("person_id", "obs_end"), "person_id", "left")
        .withColumn("data_cutoff", cutoff.select("data_cutoff").scalar())
    )
    death, index, acute, outcome = (F.col(c) for c in ("death_date", "index_date", "acute_end", "first_outcome_date"))
    case = F.col("label") == 1
    bucket = (
        F.when(death.isNull(), ALIVE)
        .when(case & outcome.isNotNull() & (death >= outcome), DEAD_AFTER_OUTCOME)
        .when(death <= index, DEAD_BEFORE)
        .when(death <= acute, DEAD_ACUTE)
        .otherwise(DEAD_LATER)
    )
    last = F.least("obs_end", "death_date", "data_cutoff")
    short = (F.col("label") == 0) & F.coalesce(F.col("followup_days") < min_followup, F.lit(False))
    return (
        df.withColumn("death_bucket", bucket)
        .where(death.isNull() | (death > F.greatest(index, acute)))
        .withColumn("last_obs_date", last)
        .withColumn("followup_days", F.datediff("last_obs_date", "index_date"))
        .withColumn("insufficient_followup", short)
        .withColumn(
            "eligibility_status",
            F.when(F.col("insufficient_followup"), "censored").when(case, "positive").otherwise("confirmed_negative"),
        )
        .drop("data_cutoff")
    )


def demographics(cohort: DataFrame, person: DataFrame) -> DataFrame:
    """Age in completed years at index and the gender concept; ``person`` has birth_date."""
    who = person.select("person_id", F.to_date("birth_date").alias("_birth"), "gender_concept_id")
    return (
        cohort.join(who, "person_id", "left")
        .withColumn("age_at_index", F.floor(F.datediff("index_date", "_birth") / F.lit(365.25)).cast("int"))
        .drop("_birth")
    )


def subcohort_summary(cohort: DataFrame) -> DataFrame:
    """Size, positives and prevalence of everyone, inpatients and outpatients in one pass."""
    groups = F.explode(
        F.array(F.lit("all"), F.when(F.col("is_inpatient") == 1, "inpatient").otherwise("outpatient"))
    )
    rows = cohort.select(groups.alias("subcohort"), "label")
    return rows.groupBy("subcohort").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.avg("label").alias("prevalence")
    )


def subcohort(cohort: DataFrame, which: str) -> DataFrame:
    if which == "all":
        return cohort
    return cohort.where(F.col("is_inpatient") == (1 if which == "inpatient" else 0))


def dominant_site(cohort: DataFrame, visits: DataFrame, days: int = 365) -> DataFrame:
    """Most visited site around the index date; ties go to the lower site id."""
    daily = (
        visits.where(F.col("site_id").isNotNull())
        .groupBy("person_id", "site_id", "event_date")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    near = daily.join(cohort.select("person_id", "index_date"), "person_id").where(
        F.col("event_date").between(plus_days("index_date", -days), plus_days("index_date", days))
    )
    counts = near.groupBy("person_id", "site_id").agg(F.sum("_n").alias("_n"))
    best = counts.groupBy("person_id").agg(
        F.max_by("site_id", F.struct("_n", -F.col("site_id"))).alias("site_id"), F.max("_n").alias("n_visits")
    )
    return cohort.select("person_id").join(best, "person_id", "left")


def synthetic_index_cases(
    first_outcome: DataFrame,
    documented: DataFrame,
    visits: DataFrame,
    types: Sequence[int],
    deaths: DataFrame,
    person: DataFrame,
    acute_days: int = 21,
    gap: int = 39,
) -> DataFrame:
    """Outcome patients without a documented index: index = outcome - (acute + gap) days, label 1."""
    base = (
        first_outcome.join(documented.select("person_id"), "person_id", "left_anti")
        .withColumn("index_date", plus_days("first_outcome_date", -(acute_days + gap)))
        .withColumn("label", F.lit(1))
        .withColumn("has_documented_index", F.lit(0))
    )
    df = acute_window(classify_setting(base, visits, types), acute_days)
    df = df.join(deaths.select("person_id", "death_date"), "person_id", "left").where(
        F.col("death_date").isNull() | (F.col("death_date") > F.col("acute_end"))
    )
    df = (
        df.withColumn("insufficient_followup", F.lit(False))
        .withColumn("eligibility_status", F.lit("positive"))
        .withColumn("death_bucket", F.lit(SYNTHETIC_CASE))
    )
    return demographics(df, person)


def cap_leaking_windows(cohort: DataFrame) -> DataFrame:
    """A synthetic case's window must end the day before its outcome."""
    leaks = (F.col("has_documented_index") == 0) & (F.col("acute_end") >= F.col("first_outcome_date"))
    return cohort.withColumn(
        "acute_end", F.when(leaks, plus_days("first_outcome_date", -1)).otherwise(F.col("acute_end"))
    )


def _integrity_rules(acute_days: int, washout: int, earliest: str) -> dict[str, Column]:
    case = (F.col("label") == 1) & F.col("first_outcome_date").isNotNull()
    return {
        "eligibility_index_date": F.col("index_date").isNull() | (F.col("index_date") < F.lit(earliest).cast("date")),
        "exposure_window_starts_after_index": F.col("acute_start") > F.col("index_date"),
        "outcome_window_short": F.datediff("acute_end", "index_date") < acute_days - 1,
        "outcome_before_followup_start": case & (F.col("first_outcome_date") < plus_days("index_date", washout)),
        "outcome_inside_feature_window": case & (F.col("first_outcome_date") <= F.col("acute_end")),
    }


def temporal_integrity(
    cohort: DataFrame, acute_days: int = 21, washout: int = 0, earliest: str = "2020-01-01", strict: bool = False
) -> DataFrame:
    """Violations per rule plus the count of retained short follow-ups, in one aggregation.

    ``strict`` runs the job, adds up to ten sample persons per broken rule to the
    message and raises.
    """
    rules = _integrity_rules(acute_days, washout, earliest)
    flagged = F.col("insufficient_followup") if "insufficient_followup" in cohort.columns else F.lit(False)
    counts = cohort.agg(
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
        F.count_if(flagged).alias("insufficient_followup_retained"),
    )
    if strict:
        found = counts.first().asDict()
        broken = [name for name in rules if found[name]]
        if broken:
            samples = {
                name: [r.person_id for r in cohort.where(rules[name]).select("person_id").limit(10).collect()]
                for name in broken
            }
            raise ValueError(f"temporal integrity violated: {samples}")
    names = [*rules, "insufficient_followup_retained"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names]))
    return counts.select(pairs.alias("r")).select("r.rule", "r.n")


def eligible_dates(cohort: DataFrame, lo: str, hi: str) -> DataFrame:
    return cohort.where(F.col("index_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def recap_followup(cohort: DataFrame, cutoff: str) -> DataFrame:
    """Follow-up recomputed against a fixed data cutoff."""
    last = F.least("obs_end", "death_date", F.lit(cutoff).cast("date"))
    return cohort.withColumn("last_obs_date", last).withColumn("followup_days", F.datediff("last_obs_date", "index_date"))


def early_outcome(min_outcome_day: int = 90) -> Column:
    return F.coalesce(F.datediff("first_outcome_date", "index_date") < min_outcome_day, F.lit(False))


def short_control(min_followup: int = 365) -> Column:
    return (F.col("label") == 0) & F.coalesce(F.col("followup_days") < min_followup, F.lit(False))


def modelling_gates(cohort: DataFrame, cutoff: str, min_outcome_day: int = 90, min_followup: int = 365) -> DataFrame:
    """Drop late index dates, early outcomes (rather than relabel them) and short controls."""
    kept = recap_followup(cohort.where(F.col("index_date") <= F.lit(cutoff).cast("date")), cutoff)
    return kept.where(~early_outcome(min_outcome_day)).where(~short_control(min_followup))


def window_case_filter(cohort: DataFrame, window_end: int) -> DataFrame:
    """Controls, and cases whose outcome lies strictly after the feature window."""
    return cohort.where(
        (F.col("label") == 0) | (F.datediff("first_outcome_date", "index_date") > window_end)
    )


def attrition_counts(cohort: DataFrame, min_outcome_day: int = 90, min_followup: int = 365) -> DataFrame:
    """The flow-chart counts in one conditional aggregation."""
    early, short = early_outcome(min_outcome_day), short_control(min_followup)
    final = ~early & ~short
    pos, inp = F.col("label") == 1, F.col("is_inpatient") == 1
    return cohort.agg(
        F.count(F.lit(1)).alias("n_saved"),
        F.count_if(pos).alias("saved_pos"),
        F.count_if(~pos).alias("saved_neg"),
        F.count_if(F.col("death_bucket").isin(DEAD_LATER, DEAD_AFTER_OUTCOME)).alias("retained_dead"),
        F.min("index_date").alias("index_min"),
        F.max("index_date").alias("index_max"),
        F.count_if(early).alias("n_early_outcome"),
        F.count_if(~early).alias("n_after_gate1"),
        F.count_if(~early & short).alias("n_short_followup"),
        F.count_if(final).alias("n_final"),
        F.count_if(final & pos).alias("pos"),
        F.count_if(final & ~pos).alias("neg"),
        F.count_if(final & pos & inp).alias("pos_in"),
        F.count_if(final & pos & ~inp).alias("pos_out"),
        F.count_if(final & ~pos & inp).alias("neg_in"),
        F.count_if(final & ~pos & ~inp).alias("neg_out"),
    )


def prefer_documented(documented: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Stack both cohorts; a person already documented keeps that row."""
    extra = synthetic.join(documented.select("person_id"), "person_id", "left_anti")
    return documented.unionByName(extra, allowMissingColumns=True)
