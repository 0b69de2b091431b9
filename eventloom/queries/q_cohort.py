"""Cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..plans.cohort_build import CohortInputs, CohortRules, build_cohort
from ..sources.warehouse import death_dates
from .registry import query
from .roles import CUTOFF, INPATIENT, POS, canonical
from ..schema import CONDITION

_BASE = "person_id, index_date, first_outcome_date, label"
_FULL = f"{_BASE}, discharge_date, is_inpatient, acute_start, acute_end"
_FOLLOW = f"{_FULL}, death_date, obs_end, death_bucket, last_obs_date, followup_days, insufficient_followup, eligibility_status"


@query("index_events", """
    SELECT person_id, min(d) AS index_date FROM (
        SELECT person_id, event_date AS d FROM ev WHERE concept_id IN (2)
        UNION ALL SELECT person_id, event_date FROM ev WHERE concept_id IN (4, 5) AND value_concept_id IN (901)) GROUP BY 1""")
def index_events(r):
    return C.index_events(r.stream, [2], r.stream, [4, 5], [POS])


@query("first_outcome", "SELECT * FROM outcome")
def first_outcome(r):
    return r.outcome


@query("exclude_members", "SELECT person_id, index_date FROM idx WHERE person_id NOT IN (SELECT person_id FROM deaths)")
def exclude_members(r):
    return C.exclude_members(r.index, r.deaths)


@query("death_dates", "SELECT person_id, death_date FROM deaths")
def death_dates_q(r):
    table = r.deaths.withColumn("death_datetime", F.col("death_date").cast("timestamp_ntz")).drop("death_date")
    return death_dates(table)


@query("observation_extent", "SELECT * FROM extent")
def observation_extent(r):
    return r.extent


@query("robust_cutoff", "SELECT data_cutoff FROM cutoff")
def robust_cutoff(r):
    return C.robust_cutoff(r.extent, "obs_end")


@query("label_outcome", f"SELECT {_BASE} FROM labelled")
def label_outcome(r):
    return r.labelled


@query("classify_setting", f"SELECT {_BASE}, discharge_date, is_inpatient FROM setting")
def classify_setting(r):
    return r.setting


@query("acute_window", f"SELECT {_FULL} FROM acute")
def acute_window(r):
    return r.acute


@query("death_followup", f"SELECT {_FOLLOW} FROM followed")
def death_followup(r):
    return r.followed


@query("demographics", f"SELECT {_FOLLOW}, age_at_index, gender_concept_id FROM cohort")
def demographics(r):
    return r.cohort


@query("subcohorts", """
    SELECT g AS subcohort, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 6) AS prevalence FROM (
        SELECT 'all' AS g, label FROM cohort UNION ALL SELECT CASE WHEN is_inpatient = 1 THEN 'inpatient' ELSE 'outpatient' END, label FROM cohort) GROUP BY 1""")
def subcohorts(r):
    return C.subcohort_summary(r.cohort)


@query("dominant_site", """
    WITH n AS (SELECT c.person_id, site_id, count(*) AS n FROM cohort c JOIN visits v ON v.person_id = c.person_id
               AND v.event_date BETWEEN index_date - 365 AND index_date + 365 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC, site_id) AS rn FROM n)
    SELECT c.person_id, site_id, n AS n_visits FROM cohort c LEFT JOIN b ON b.person_id = c.person_id AND rn = 1""")
def dominant_site(r):
    return C.dominant_site(r.cohort, r.visits)


_SYNTH = """
    SELECT s.*, p.gender_concept_id, CAST(floor((index_date - birth_date) / 365.25) AS BIGINT) AS age_at_index FROM (
        SELECT b.person_id, first_outcome_date, b.index_date, 1 AS label, 0 AS has_documented_index, h.discharge_date,
               CASE WHEN h.discharge_date IS NULL THEN 0 ELSE 1 END AS is_inpatient, b.index_date AS acute_start,
               CASE WHEN h.discharge_date IS NULL THEN b.index_date + 21 ELSE greatest(b.index_date + 21, h.discharge_date) END AS acute_end
        FROM (SELECT person_id, first_outcome_date, first_outcome_date - 60 AS index_date FROM outcome WHERE person_id NOT IN (SELECT person_id FROM idx)) b
        LEFT JOIN (SELECT o.person_id, max(coalesce(v.end_date, v.event_date)) AS discharge_date FROM outcome o JOIN visits v
                   ON v.person_id = o.person_id AND v.concept_id IN (2, 3) AND v.event_date <= first_outcome_date - 60 + 16
                   AND coalesce(v.end_date, v.event_date) >= first_outcome_date - 61 GROUP BY 1) h USING (person_id)) s
    LEFT JOIN deaths d USING (person_id) LEFT JOIN person p USING (person_id)
    WHERE d.death_date IS NULL OR d.death_date > acute_end"""


@query("synthetic_index", f"""
    SELECT person_id, first_outcome_date, index_date, label, has_documented_index, discharge_date, is_inpatient, acute_start,
           CASE WHEN acute_end >= first_outcome_date THEN first_outcome_date - 1 ELSE acute_end END AS acute_end, age_at_index, gender_concept_id FROM ({_SYNTH})""")
def synthetic_index(r):
    df = C.synthetic_index_cases(r.outcome, r.index, r.visits, INPATIENT, r.deaths, r.person)
    return C.cap_leaking_windows(df).drop("death_date", "insufficient_followup", "eligibility_status", "death_bucket")


@query("temporal_integrity", """
    SELECT 'eligibility_index_date' AS rule, count(*) FILTER (index_date IS NULL OR index_date < DATE '1996-01-01') AS n FROM cohort
    UNION ALL SELECT 'exposure_window_starts_after_index', count(*) FILTER (acute_start > index_date) FROM cohort
    UNION ALL SELECT 'outcome_window_short', count(*) FILTER (acute_end - index_date < 20) FROM cohort
    UNION ALL SELECT 'outcome_before_followup_start', count(*) FILTER (label = 1 AND first_outcome_date < index_date + 100) FROM cohort
    UNION ALL SELECT 'outcome_inside_feature_window', count(*) FILTER (label = 1 AND first_outcome_date <= acute_end) FROM cohort
    UNION ALL SELECT 'insufficient_followup_retained', count(*) FILTER (insufficient_followup = 1) FROM cohort""")
def temporal_integrity(r):
    return C.temporal_integrity(r.cohort, 21, 100, "1996-01-01")


@query("eligible_dates", "SELECT person_id, index_date FROM idx WHERE index_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def eligible_dates(r):
    return C.eligible_dates(r.index, "1996-01-01", "1997-06-30")


_GATED = f"""
    SELECT {_BASE}, is_inpatient, acute_start, acute_end, least(obs_end, death_date, DATE '{CUTOFF}') AS last_obs_date,
           least(obs_end, death_date, DATE '{CUTOFF}') - index_date AS followup_days
    FROM cohort WHERE index_date <= DATE '{CUTOFF}' AND NOT coalesce(first_outcome_date - index_date < 90, false)
      AND NOT (label = 0 AND least(obs_end, death_date, DATE '{CUTOFF}') - index_date < 365)"""


def gated(r):
    return C.modelling_gates(r.cohort, CUTOFF)


@query("modelling_gates", _GATED)
def modelling_gates(r):
    return gated(r).select(*_BASE.split(", "), "is_inpatient", "acute_start", "acute_end", "last_obs_date", "followup_days")


@query("window_case_filter", f"SELECT person_id, label, first_outcome_date FROM ({_GATED}) WHERE label = 0 OR first_outcome_date - index_date > 180")
def window_case_filter(r):
    return C.window_case_filter(gated(r), 180).select("person_id", "label", "first_outcome_date")


@query("attrition", """
    WITH f AS (SELECT *, coalesce(first_outcome_date - index_date < 90, false) AS early, label = 0 AND coalesce(followup_days < 365, false) AS short, label = 1 AS pos, is_inpatient = 1 AS inp FROM cohort)
    SELECT count(*) AS n_saved, count(*) FILTER (pos) AS saved_pos, count(*) FILTER (NOT pos) AS saved_neg,
           count(*) FILTER (death_bucket IN ('post_acute_death', 'd_post_outcome_true_positive')) AS retained_dead,
           min(index_date) AS index_min, max(index_date) AS index_max, count(*) FILTER (early) AS n_early_outcome, count(*) FILTER (NOT early) AS n_after_gate1,
           count(*) FILTER (NOT early AND short) AS n_short_followup, count(*) FILTER (NOT early AND NOT short) AS n_final,
           count(*) FILTER (NOT early AND NOT short AND pos) AS pos, count(*) FILTER (NOT early AND NOT short AND NOT pos) AS neg,
           count(*) FILTER (NOT early AND NOT short AND pos AND inp) AS pos_in, count(*) FILTER (NOT early AND NOT short AND pos AND NOT inp) AS pos_out,
           count(*) FILTER (NOT early AND NOT short AND NOT pos AND inp) AS neg_in, count(*) FILTER (NOT early AND NOT short AND NOT pos AND NOT inp) AS neg_out FROM f""")
def attrition(r):
    return C.attrition_counts(r.cohort)


def _inputs(r):
    outcomes = canonical(
        r.table("orders").where("o_orderstatus = 'P'"), CONDITION, person_id="o_custkey", event_id="o_orderkey",
        concept_id=F.lit(77), event_date=F.to_date("o_orderdate"),
    )
    return CohortInputs(r.visits, r.visits, outcomes, r.visits, r.deaths, r.periods, r.person)


_RULES = CohortRules([1], [], [], [77], INPATIENT, earliest="1995-01-01", latest="2001-06-30")


@query("build_cohort_strict", f"SELECT {_FOLLOW}, age_at_index, gender_concept_id FROM cohort WHERE index_date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30'")
def build_cohort_strict(r):
    return build_cohort(_inputs(r), _RULES).drop("has_documented_index")


@query("build_cohort_relaxed", f"""
    SELECT person_id, index_date, label, is_inpatient, acute_end, 1 AS has_documented_index, age_at_index FROM cohort WHERE index_date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30'
    UNION ALL
    SELECT person_id, index_date, label, is_inpatient, CASE WHEN acute_end >= first_outcome_date THEN first_outcome_date - 1 ELSE acute_end END, 0, age_at_index
    FROM ({_SYNTH.replace('(SELECT person_id FROM idx)', '(SELECT person_id FROM cohort)')}) WHERE index_date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30'""")
def build_cohort_relaxed(r):
    df = build_cohort(_inputs(r), _RULES, mode="relaxed")
    return df.select("person_id", "index_date", "label", "is_inpatient", "acute_end", "has_documented_index", "age_at_index")
