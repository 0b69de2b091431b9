"""Event predicates and indicator kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import decode_result, has_any_value, ilike_any, is_elevated
from ..operators.concepts import ConceptSpec, concepts_or_text
from ..operators.indicators import IndicatorSpec, build_signals, indicator_hits
from ..operators.windows import cohort_windows, sequential_windows, with_windows, explode_matching
from ..schema import MEASUREMENT
from .registry import query
from .roles import NATION, NEG, ORDER_WINDOWS, POS, REGION, STREAM_WINDOWS

ERROR, PURCHASE, CLICK, VIEW = 4, 3, 5, 1


def ids(*values):
    return (ConceptSpec(ids=tuple(values)),)


def stream_hits(r, *specs, windows=STREAM_WINDOWS):
    hits = indicator_hits(r.stream, r.stream_cohort, windows, specs, r.stream_vocabulary, min_episode_window=0)
    return hits.withColumnRenamed("window", "win")


def order_hits(r, events, *specs):
    return indicator_hits(events, r.cohort, ORDER_WINDOWS, specs, r.vocabulary, r.providers, r.sites).withColumnRenamed("window", "win")


# ------------------------------------------------------------------ predicates


@query(
    "scan_events",
    "SELECT person_id, event_id, domain, concept_id, event_date, value, value_concept_id, value_text, range_high, source_text, source_concept_id FROM ev",
)
def scan_events(r):
    return r.stream.drop("end_date", "provider_id", "site_id")


@query("concept_or_text_filter", "SELECT event_id, person_id, concept_id, source_text FROM ev WHERE concept_id IN (4) OR source_text LIKE 'click:5%'")
def concept_or_text_filter(r):
    wanted = r.stream_concepts.where("concept_name = 'error'")
    return concepts_or_text(r.stream, wanted, ["click:5%"]).select("event_id", "person_id", "concept_id", "source_text")


@query("concept_set_filter", "SELECT event_id, concept_id FROM ev WHERE concept_id IN (3, 5)")
def concept_set_filter(r):
    wanted = r.stream_concepts.where("concept_name IN ('purchase', 'click')")
    return concepts_or_text(r.stream, wanted).select("event_id", "concept_id")


@query("empty_set_filter", "SELECT event_id FROM ev WHERE false")
def empty_set_filter(r):
    return concepts_or_text(r.stream, r.stream_concepts.where("concept_name = 'none'")).select("event_id")


@query("text_filter", "SELECT event_id, source_text FROM ev WHERE lower(source_text) LIKE '%ror:1%' OR lower(source_text) LIKE 'view:_'")
def text_filter(r):
    return r.stream.where(ilike_any("source_text", ["%ROR:1%", "VIEW:_"])).select("event_id", "source_text")


@query("elevated_filter", "SELECT event_id FROM ev WHERE concept_id = 4 AND (value > range_high OR (value IS NOT NULL AND range_high IS NULL) OR value_concept_id IS NOT NULL)")
def elevated_filter(r):
    return r.stream.where((F.col("concept_id") == ERROR) & is_elevated()).select("event_id")


@query("value_gates", """
    SELECT concept_id, count(*) FILTER (value IS NOT NULL OR value_concept_id IS NOT NULL) AS n_any, count(*) FILTER (value >= 50) AS n_threshold,
           count(*) FILTER (value_concept_id IN (902)) AS n_listed FROM ev GROUP BY 1""")
def value_gates(r):
    return r.stream.groupBy("concept_id").agg(
        F.count_if(has_any_value()).alias("n_any"), F.count_if(F.col("value") >= 50).alias("n_threshold"),
        F.count_if(F.col("value_concept_id").isin(NEG)).alias("n_listed"),
    )


_DECODE = """CASE WHEN value_concept_id IN (902) THEN 0 WHEN value_concept_id IN (901) THEN 1
    WHEN value_concept_id IS NULL AND (lower(value_text) LIKE '%not detected%' OR lower(value_text) LIKE '%negative%') THEN 0
    WHEN value_concept_id IS NULL AND (lower(value_text) LIKE '%detected%' OR lower(value_text) LIKE '%positive%')
     AND NOT (lower(value_text) LIKE '%presumptive%' OR lower(source_text) LIKE '%presumptive%') THEN 1 END"""


@query("result_decode", f"SELECT event_id, {_DECODE} AS is_positive FROM ev")
def result_decode(r):
    return r.stream.select("event_id", decode_result([POS], [NEG]).alias("is_positive"))


@query("window_join", "SELECT event_id, person_id, win, day, day_in FROM s_evw")
def window_join(r):
    people = with_windows(r.stream_cohort, STREAM_WINDOWS)
    return explode_matching(r.stream.join(people, "person_id")).select("event_id", "person_id", F.col("window").alias("win"), "day", "day_in")


@query("window_dates", "SELECT person_id, win, w_start, w_end, ws AS window_start, we AS window_end FROM s_win")
def window_dates(r):
    return cohort_windows(r.stream_cohort, STREAM_WINDOWS).select(
        "person_id", F.col("window").alias("win"), "w_start", "w_end", "window_start", "window_end"
    )


# ------------------------------------------------------------------ measurement kinds


@query("meas_any_recorded", """
    SELECT DISTINCT person_id, win, 'M' AS indicator FROM s_evw
    WHERE (concept_id = 4 OR source_text LIKE 'click:5%') AND (value IS NOT NULL OR value_concept_id IS NOT NULL) AND value_concept_id IN (902)""")
def meas_any_recorded(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_ANY_RECORDED", ids(ERROR), text=("click:5%",), any_value=True, values=(NEG,)))


@query("meas_numeric_any", "SELECT DISTINCT person_id, win, 'M' AS indicator FROM s_evw WHERE concept_id = 3 AND value IS NOT NULL")
def meas_numeric_any(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_NUMERIC_ANY", ids(PURCHASE)))


@query("meas_numeric_threshold", "SELECT DISTINCT person_id, win, 'M' AS indicator FROM s_evw WHERE concept_id = 3 AND value >= 90")
def meas_numeric_threshold(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_NUMERIC_THRESHOLD", ids(PURCHASE), threshold=90.0))


@query("meas_elevated_or_any", """
    SELECT DISTINCT person_id, win, 'M' AS indicator FROM s_evw
    WHERE concept_id = 4 AND (value > range_high OR (value IS NOT NULL AND range_high IS NULL) OR value_concept_id IS NOT NULL)""")
def meas_elevated_or_any(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_ELEVATED_OR_ANY", ids(ERROR)))


@query("meas_paired_same_date", """
    SELECT DISTINCT a.person_id, a.win, 'M' AS indicator FROM s_evw a JOIN s_evw b
      ON a.person_id = b.person_id AND a.win = b.win AND a.event_date = b.event_date
    WHERE a.concept_id = 3 AND b.concept_id = 4 AND a.value > 0 AND b.value IS NOT NULL""")
def meas_paired_same_date(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_PAIRED_SAME_DATE_NUMERIC", left=ids(PURCHASE), right=ids(ERROR)))


@query("meas_repeat_at_least_n", """
    SELECT person_id, win, 'M' AS indicator FROM s_evw WHERE concept_id = 4 AND value_concept_id IN (901) GROUP BY 1, 2 HAVING count(*) >= 3""")
def meas_repeat_at_least_n(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_REPEAT_AT_LEAST_N", ids(ERROR), values=(POS,), min_n=3))


@query("meas_elev_episodes_gap", """
    WITH e AS (SELECT person_id, win, event_date, lag(event_date) OVER (PARTITION BY person_id, win ORDER BY event_date) AS prev
               FROM s_evw WHERE concept_id = 4 AND value IS NOT NULL AND (value > range_high OR range_high IS NULL))
    SELECT person_id, win, 'M' AS indicator FROM e GROUP BY 1, 2 HAVING sum(CASE WHEN prev IS NULL OR event_date >= prev + 3 THEN 1 ELSE 0 END) >= 2""")
def meas_elev_episodes_gap(r):
    return stream_hits(r, IndicatorSpec("M", "MEAS_ELEV_EPISODES_GAP", ids(ERROR), gap=3, min_n=2))


@query("episodes_in_long_windows", """
    WITH e AS (SELECT person_id, win, event_date, lag(event_date) OVER (PARTITION BY person_id, win ORDER BY event_date) AS prev
               FROM s_evw JOIN (SELECT DISTINCT win AS w, w_end - w_start AS size FROM s_win) ON w = win WHERE size >= 10 AND concept_id = 4 AND value IS NOT NULL AND (value > range_high OR range_high IS NULL))
    SELECT person_id, win, 'M' AS indicator FROM e GROUP BY 1, 2 HAVING sum(CASE WHEN prev IS NULL OR event_date >= prev + 3 THEN 1 ELSE 0 END) >= 2
    UNION ALL SELECT DISTINCT person_id, win, 'ANY' FROM s_evw WHERE concept_id = 4 AND (value IS NOT NULL OR value_concept_id IS NOT NULL)""")
def episodes_in_long_windows(r):
    """Elevated episodes are not asked for in windows below the least length (60 days of a 90-day domain, 10 of this one); other kinds are."""
    specs = [IndicatorSpec("M", "MEAS_ELEV_EPISODES_GAP", ids(ERROR), gap=3, min_n=2), IndicatorSpec("ANY", "MEAS_ANY_RECORDED", ids(ERROR), any_value=True)]
    hits = indicator_hits(r.stream, r.stream_cohort, STREAM_WINDOWS, specs, r.stream_vocabulary, min_episode_window=10)
    return hits.withColumnRenamed("window", "win")


@query("meas_persistent_positivity", f"""
    WITH d AS (SELECT person_id, win, event_date, event_id, day_in, {_DECODE} AS is_pos FROM s_evw WHERE concept_id IN (1, 4)),
    o AS (SELECT *, sum(CASE WHEN is_pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, win ORDER BY event_date, is_pos, event_id ROWS UNBOUNDED PRECEDING) AS run
          FROM d WHERE is_pos IS NOT NULL),
    q AS (SELECT person_id, win, run, count(*) AS n, max(day_in) AS m FROM o WHERE is_pos = 1 GROUP BY 1, 2, 3)
    SELECT DISTINCT person_id, win, 'ANY' AS indicator FROM q WHERE n >= 2
    UNION ALL SELECT DISTINCT person_id, win, 'ANCHORED' FROM q WHERE run = 0 AND n >= 1 AND m >= 2""")
def meas_persistent_positivity(r):
    common = dict(concepts=ids(VIEW, ERROR), positive=(POS,), negative=(NEG,))
    return stream_hits(
        r, IndicatorSpec("ANY", "MEAS_PERSISTENT_POSITIVITY", **common),
        IndicatorSpec("ANCHORED", "MEAS_PERSISTENT_POSITIVITY", min_day=2, anchored=True, **common),
    )


@query("signals_all_windows", """
    WITH h AS (
        SELECT DISTINCT person_id, win, 'a' AS i FROM s_evw WHERE concept_id = 4
        UNION ALL SELECT person_id, win, 'b' FROM s_evw WHERE concept_id = 5 GROUP BY 1, 2 HAVING count(*) >= 2
        UNION ALL SELECT DISTINCT person_id, win, 'c' FROM s_evw WHERE concept_id = 3 AND value >= 120)
    SELECT w.person_id, w.win, max(CASE WHEN i = 'a' THEN 1 ELSE 0 END) AS f_ind_s_any_error, max(CASE WHEN i = 'b' THEN 1 ELSE 0 END) AS f_ind_s_two_clicks,
           max(CASE WHEN i = 'c' THEN 1 ELSE 0 END) AS f_ind_s_big_purchase, 0 AS f_ind_s_never
    FROM s_win w LEFT JOIN h ON h.person_id = w.person_id AND h.win = w.win GROUP BY 1, 2""")
def signals_all_windows(r):
    specs = [
        IndicatorSpec("ANY_ERROR", "MEAS_ANY_RECORDED", ids(ERROR), group="s"),
        IndicatorSpec("TWO_CLICKS", "MEAS_REPEAT_AT_LEAST_N", ids(CLICK), min_n=2, group="s"),
        IndicatorSpec("BIG_PURCHASE", "MEAS_NUMERIC_THRESHOLD", ids(PURCHASE), threshold=120.0, group="s"),
        IndicatorSpec("NEVER", "MEAS_ANY_RECORDED", constant_zero=True, group="s"),
    ]
    hits = indicator_hits(r.stream, r.stream_cohort, STREAM_WINDOWS, specs, r.stream_vocabulary)
    return build_signals(hits, r.stream_cohort, STREAM_WINDOWS, specs).withColumnRenamed("window", "win")


@query("sequential_windows", """
    WITH w AS (SELECT unnest(range(0, 20, 6)) AS a), x AS (SELECT a, least(a + 6, 20) AS b FROM w)
    SELECT 'w' || a || '_' || b AS win, count(DISTINCT e.person_id) AS n_persons
    FROM ev e JOIN s_cohort c USING (person_id) JOIN x ON e.event_date BETWEEN c.index_date + CAST(a AS INTEGER) AND c.index_date + CAST(b AS INTEGER)
    WHERE e.concept_id = 4 GROUP BY 1""")
def sequential(r):
    hits = stream_hits(r, IndicatorSpec("M", "MEAS_ANY_RECORDED", ids(ERROR)), windows=sequential_windows(0, 20, 6))
    return hits.groupBy("win").agg(F.count_distinct("person_id").alias("n_persons"))


# ------------------------------------------------------------------ order-domain kinds


def _any(table, where):
    return f"SELECT DISTINCT e.person_id, w.win, 'M' AS indicator FROM {table} e JOIN o_win w ON e.person_id = w.person_id AND e.event_date BETWEEN w.ws AND w.we WHERE {where}"


@query("obs_any_recorded", _any("observations", "concept_id IN (SELECT des FROM closure WHERE anc = 1000003) AND value IS NOT NULL"))
def obs_any_recorded(r):
    return order_hits(r, r.observations, IndicatorSpec("M", "OBS_ANY_RECORDED", (ConceptSpec(ancestors=(1_000_003,)),), any_value=True))


@query("meas_or_obs_any", f"""
    WITH m AS (SELECT *, CASE WHEN source_text LIKE 'F%' THEN 1 END AS value_concept_id FROM procedures)
    SELECT DISTINCT * FROM ({_any('m', "concept_id IN (SELECT des FROM closure WHERE anc = 1000005) AND value_concept_id IS NOT NULL")}
    UNION ALL {_any('observations', 'concept_id IN (7, 8, 9, 10, 11) AND value IS NOT NULL')})""")
def meas_or_obs_any(r):
    m = r.procedures.withColumn("domain", F.lit(MEASUREMENT)).withColumn("value_concept_id", F.when(F.col("source_text").like("F%"), 1).cast("long"))
    spec = IndicatorSpec("M", "MEAS_OR_OBS_ANY", (ConceptSpec(ancestors=(1_000_005,)),), observation_ids=(7, 8, 9, 10, 11), any_value=True)
    return order_hits(r, m.unionByName(r.observations), spec)


@query("cond_any_recorded", _any("conditions", "concept_id IN (SELECT des FROM closure WHERE anc IN (3000002, 3000004)) OR source_text LIKE 'o:1%' OR source_text LIKE 'O:1%'"))
def cond_any_recorded(r):
    spec = IndicatorSpec("M", "COND_ANY_RECORDED", (ConceptSpec(ancestors=(NATION + 2, NATION + 4)),), text=("o:1%",))
    return order_hits(r, r.conditions, spec)


@query("cond_episodes_gap", """
    WITH e AS (SELECT c.person_id, w.win, c.event_date, lag(c.event_date) OVER (PARTITION BY c.person_id, w.win ORDER BY c.event_date) AS prev
               FROM conditions c JOIN o_win w ON c.person_id = w.person_id AND c.event_date BETWEEN w.ws AND w.we
               WHERE concept_id IN (SELECT des FROM closure WHERE anc IN (4000000, 4000001, 4000002)))
    SELECT person_id, win, 'M' AS indicator FROM e GROUP BY 1, 2 HAVING sum(CASE WHEN prev IS NULL OR event_date >= prev + 20 THEN 1 ELSE 0 END) >= 2""")
def cond_episodes_gap(r):
    spec = IndicatorSpec("M", "COND_EPISODES_GAP", (ConceptSpec(ancestors=(REGION, REGION + 1, REGION + 2)),), gap=20, min_n=2)
    return order_hits(r, r.conditions, spec)


@query("cond_name_pattern", _any("conditions", "concept_id IN (SELECT concept_id FROM concept WHERE domain_id = 'Condition' AND (upper(concept_name) LIKE '%1' OR upper(concept_name) LIKE 'SUPPLIER%02'))"))
def cond_name_pattern(r):
    spec = IndicatorSpec("M", "COND_NAME_PATTERN", (ConceptSpec(names=("%1", "SUPPLIER%02"), domain="Condition"),), text=("%:7%",))
    return order_hits(r, r.conditions, spec)


@query("proc_any_recorded", _any("procedures", "concept_id IN (SELECT des FROM closure WHERE anc = 2000002)"))
def proc_any_recorded(r):
    return order_hits(r, r.procedures, IndicatorSpec("M", "PROC_ANY_RECORDED", (ConceptSpec(ancestors=(2_000_002,)),)))


@query("proc_name_pattern", _any("procedures", "concept_id IN (SELECT concept_id FROM concept WHERE domain_id = 'Drug' AND upper(concept_name) LIKE '%RED%BOLT%')"))
def proc_name_pattern(r):
    return order_hits(r, r.procedures, IndicatorSpec("M", "PROC_NAME_PATTERN", (ConceptSpec(names=("%RED%BOLT%",), domain="Drug"),)))


@query("drug_any_recorded", _any("drugs", "concept_id IN (SELECT des FROM closure WHERE anc IN (1000001, 1000002))"))
def drug_any_recorded(r):
    return order_hits(r, r.drugs, IndicatorSpec("M", "DRUG_ANY_RECORDED", (ConceptSpec(ancestors=(1_000_001, 1_000_002)),)))


def _ingredient(*names):
    return (ConceptSpec(ingredients=names, ingredient_vocabulary="PART"),)


_BRANDS = "concept_id IN (SELECT des FROM closure WHERE anc IN (1000004, 1000009))"


@query("drug_ingredient_desc", _any("drugs", f"{_BRANDS} OR lower(source_text) LIKE '%blue%'"))
def drug_ingredient_desc(r):
    return order_hits(r, r.drugs, IndicatorSpec("M", "DRUG_INGREDIENT_DESC", _ingredient("brand#4", "Brand#9"), text=("%blue%",)))


@query("drug_repeat_at_least_n", f"""
    WITH u AS (SELECT person_id, event_date FROM drugs WHERE {_BRANDS} UNION ALL SELECT person_id, event_date FROM drugs WHERE lower(source_text) LIKE '%blue%')
    SELECT u.person_id, w.win, 'M' AS indicator FROM u JOIN o_win w ON u.person_id = w.person_id AND u.event_date BETWEEN w.ws AND w.we
    GROUP BY 1, 2 HAVING count(*) >= 2""")
def drug_repeat_at_least_n(r):
    return order_hits(r, r.drugs, IndicatorSpec("M", "DRUG_REPEAT_AT_LEAST_N", _ingredient("BRAND#4", "BRAND#9"), text=("%blue%",), min_n=2))


@query("drug_episodes_gap", """
    WITH e AS (SELECT c.person_id, w.win, c.event_date, lag(c.event_date) OVER (PARTITION BY c.person_id, w.win ORDER BY c.event_date) AS prev
               FROM drugs c JOIN o_win w ON c.person_id = w.person_id AND c.event_date BETWEEN w.ws AND w.we
               WHERE concept_id IN (SELECT des FROM closure WHERE anc BETWEEN 1000001 AND 1000009))
    SELECT person_id, win, 'M' AS indicator FROM e GROUP BY 1, 2 HAVING sum(CASE WHEN prev IS NULL OR event_date >= prev + 14 THEN 1 ELSE 0 END) >= 2""")
def drug_episodes_gap(r):
    names = [f"BRAND#{i}" for i in range(1, 10)]
    return order_hits(r, r.drugs, IndicatorSpec("M", "DRUG_EPISODES_GAP", _ingredient(*names), gap=14, min_n=2))


@query("visit_specialty_name", _any("visits", """
    provider_id IN (SELECT provider_id FROM providers p LEFT JOIN concept c ON c.concept_id = p.specialty_concept_id
                    WHERE lower(concept_name) LIKE '%nation_1%' OR lower(specialty_source_value) LIKE '%nation_1%')
    OR site_id IN (SELECT n_nationkey FROM nation WHERE lower(n_name) LIKE '%nation_1%')"""))
def visit_specialty_name(r):
    return order_hits(r, r.visits, IndicatorSpec("M", "VISIT_SPECIALTY_NAME", specialties=("%nation_1%",)))


@query("signals_all_domains", f"""
    {_any("conditions", "concept_id IN (SELECT des FROM closure WHERE anc = 4000001)").replace("'M'", "'COND'")}
    UNION ALL {_any("procedures", "concept_id IN (SELECT des FROM closure WHERE anc = 2000001)").replace("'M'", "'PROC'")}
    UNION ALL {_any("drugs", "concept_id IN (SELECT des FROM closure WHERE anc = 1000007)").replace("'M'", "'DRUG'")}
    UNION ALL {_any("observations", "concept_id IN (SELECT des FROM closure WHERE anc = 1000007)").replace("'M'", "'OBS'")}""")
def signals_all_domains(r):
    events = r.conditions.unionByName(r.procedures).unionByName(r.drugs).unionByName(r.observations)
    return order_hits(
        r, events,
        IndicatorSpec("COND", "COND_ANY_RECORDED", (ConceptSpec(ancestors=(REGION + 1,)),)),
        IndicatorSpec("PROC", "PROC_ANY_RECORDED", (ConceptSpec(ancestors=(2_000_001,)),)),
        IndicatorSpec("DRUG", "DRUG_INGREDIENT_DESC", _ingredient("Brand#7")),
        IndicatorSpec("OBS", "OBS_ANY_RECORDED", (ConceptSpec(ancestors=(1_000_007,)),)),
    )


