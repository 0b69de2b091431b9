"""The cohort build as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort as C


@dataclass(frozen=True)
class CohortInputs:
    diagnoses: DataFrame
    tests: DataFrame
    outcomes: DataFrame
    visits: DataFrame
    deaths: DataFrame
    periods: DataFrame
    person: DataFrame


@dataclass(frozen=True)
class CohortRules:
    dx_ids: Sequence[int]
    test_ids: Sequence[int]
    positive_ids: Sequence[int]
    outcome_ids: Sequence[int]
    inpatient_types: Sequence[int]
    acute_days: int = 21
    min_outcome_day: int = 90
    min_followup: int = 90
    washout: int = 0
    earliest: str = "2020-01-01"
    latest: str = "2100-01-01"
    cutoff_quantile: float = 0.999


def build_cohort(inputs: CohortInputs, rules: CohortRules, mode: str = "strict", check: bool = False) -> DataFrame:
    """Index -> label -> setting -> acute window -> death and follow-up -> demographics -> date range.

    ``relaxed`` adds outcome patients without a documented index.  With ``check``
    the temporal rules are run and a violation raises.
    """
    if mode not in ("strict", "relaxed"):
        raise ValueError(f"unknown mode {mode}")
    base = C.index_events(inputs.diagnoses, rules.dx_ids, inputs.tests, rules.test_ids, rules.positive_ids)
    outcome = C.first_event(inputs.outcomes, rules.outcome_ids, "first_outcome_date")
    df = C.label_outcome(base, outcome, rules.min_outcome_day)
    df = C.acute_window(C.classify_setting(df, inputs.visits, rules.inpatient_types), rules.acute_days)
    extent = C.observation_extent(inputs.periods)
    cutoff = C.robust_cutoff(extent, "obs_end", rules.cutoff_quantile)
    df = C.death_and_followup(df, inputs.deaths, extent, cutoff, rules.min_followup)
    df = C.demographics(df, inputs.person).withColumn("has_documented_index", F.lit(1))
    if mode == "relaxed":
        extra = C.synthetic_index_cases(
            outcome, df, inputs.visits, rules.inpatient_types, inputs.deaths, inputs.person, rules.acute_days
        )
        df = C.cap_leaking_windows(C.prefer_documented(df, extra))
    df = C.eligible_dates(df, rules.earliest, rules.latest)
    if check:
        C.temporal_integrity(df, rules.acute_days, rules.washout, rules.earliest, strict=True)
    return df
