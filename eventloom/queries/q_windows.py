"""Comparisons between windows, composites, assembly and validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators import multiwindow as M
from ..operators import validate as V
from ..operators.concepts import ConceptSpec, resolve_all
from ..operators.indicators import IndicatorSpec, build_signals, indicator_hits
from ..operators.labs import lab_matrix
from ..operators.windows import cohort_windows
from ..operators import blocks as B
from ..plans.features import assemble_baseline
from ..sources.results import families_table
from .q_features import LAB_SQL, below, flag, lab_summary
from .registry import query
from .roles import NATION, REGION, STREAM_LABELS, STREAM_WINDOWS


def _ids(*v):
    return (ConceptSpec(ids=tuple(v)),)


_SPECS = (
    IndicatorSpec("ERR", "MEAS_ANY_RECORDED", _ids(4)),
    IndicatorSpec("CLK", "MEAS_REPEAT_AT_LEAST_N", _ids(5), min_n=2),
    IndicatorSpec("BUY", "MEAS_NUMERIC_THRESHOLD", _ids(3), threshold=80.0),
)
_HITS = """
    SELECT DISTINCT person_id, win, 'ERR' AS i FROM s_evw WHERE concept_id = 4
    UNION ALL SELECT person_id, win, 'CLK' FROM s_evw WHERE concept_id = 5 GROUP BY 1, 2 HAVING count(*) >= 2
    UNION ALL SELECT DISTINCT person_id, win, 'BUY' FROM s_evw WHERE concept_id = 3 AND value >= 80"""


def hits(r):
    return indicator_hits(r.stream, r.stream_cohort, STREAM_WINDOWS, _SPECS, r.stream_vocabulary)


@query("lab_trajectories", f"""
    WITH l AS ({LAB_SQL})
    SELECT c.person_id, round(b.median - a.median, 6) AS f_lab_traj_purchase_delta_w0_5_to_w10_20, round(d.median - k.median, 6) AS f_lab_traj_error_delta_w0_5_to_w10_20,
           CASE WHEN a.abnormal_any = 1 AND b.abnormal_any = 1 THEN 1 ELSE 0 END AS f_lab_traj_purchase_persistent_elev
    FROM s_cohort c LEFT JOIN l a ON a.person_id = c.person_id AND a.win = 'w0_5' AND a.lab = 'purchase' LEFT JOIN l b ON b.person_id = c.person_id AND b.win = 'w10_20' AND b.lab = 'purchase'
    LEFT JOIN l k ON k.person_id = c.person_id AND k.win = 'w0_5' AND k.lab = 'error' LEFT JOIN l d ON d.person_id = c.person_id AND d.win = 'w10_20' AND d.lab = 'error'""")
def lab_trajectories(r):
    return M.lab_trajectories(lab_summary(r), r.stream_cohort, {"purchase": True, "error": False}, "w0_5", "w10_20")


_XW = ", ".join(
    f"CASE WHEN count(DISTINCT win) FILTER (i = '{i}') >= 2 THEN 1 ELSE 0 END AS f_ind_xw_persistent_{i.lower()}, "
    f"CASE WHEN count(DISTINCT win) FILTER (i = '{i}') = 1 AND max(win) FILTER (i = '{i}') = 'w0_5' THEN 1 ELSE 0 END AS f_ind_xw_early_only_{i.lower()}, "
    f"CASE WHEN count(DISTINCT win) FILTER (i = '{i}') = 1 AND max(win) FILTER (i = '{i}') = 'w10_20' THEN 1 ELSE 0 END AS f_ind_xw_late_only_{i.lower()}"
    for i in ("ERR", "CLK", "BUY")
)


@query("cross_window", f"WITH h AS ({_HITS}) SELECT c.person_id, {_XW} FROM s_cohort c LEFT JOIN h ON h.person_id = c.person_id AND win IN ('w0_5', 'w5_10', 'w10_20') GROUP BY 1")
def cross_window(r):
    return M.cross_window(hits(r), r.stream_cohort, ["w10_20", "w0_5", "w5_10"], [s.name for s in _SPECS])


@query("temporal_trends", f"""
    WITH m AS (SELECT c.person_id, max(CASE WHEN win = 'w0_5' THEN 1 ELSE 0 END) AS a, max(CASE WHEN win = 'w5_10' THEN 1 ELSE 0 END) AS b, max(CASE WHEN win = 'w10_20' THEN 1 ELSE 0 END) AS d
               FROM s_cohort c LEFT JOIN ({_HITS}) h ON h.person_id = c.person_id AND i = 'CLK' GROUP BY 1)
    SELECT person_id, CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END AS f_temp_bin_clk_rise_w0_5_to_w5_10, CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END AS f_temp_bin_clk_fall_w0_5_to_w5_10,
           CASE WHEN b = 0 AND d = 1 THEN 1 ELSE 0 END AS f_temp_bin_clk_rise_w5_10_to_w10_20, CASE WHEN b = 1 AND d = 0 THEN 1 ELSE 0 END AS f_temp_bin_clk_fall_w5_10_to_w10_20,
           CASE WHEN (a = 0 AND b = 1) OR (b = 0 AND d = 1) THEN 1 ELSE 0 END AS f_temp_bin_clk_any_rise, CASE WHEN (a = 1 AND b = 0) OR (b = 1 AND d = 0) THEN 1 ELSE 0 END AS f_temp_bin_clk_any_fall,
           CASE WHEN a = 0 AND d = 1 THEN 1 ELSE 0 END AS f_temp_bin_clk_late_gt_early, CASE WHEN a = 1 AND d = 0 THEN 1 ELSE 0 END AS f_temp_bin_clk_late_lt_early FROM m""")
def temporal_trends(r):
    return M.binary_trends(hits(r), r.stream_cohort, ["w0_5", "w5_10", "w10_20"], ["CLK"])


@query("lab_trends", f"""
    WITH m AS (SELECT c.person_id, max(median) FILTER (win = 'w0_5') AS a, max(median) FILTER (win = 'w5_10') AS b, max(median) FILTER (win = 'w10_20') AS d
               FROM s_cohort c LEFT JOIN ({LAB_SQL}) l ON l.person_id = c.person_id AND lab = 'purchase' GROUP BY 1)
    SELECT person_id, CASE WHEN b > a THEN 1 ELSE 0 END AS f_temp_lab_purchase_up_w0_5_to_w5_10, CASE WHEN d > b THEN 1 ELSE 0 END AS f_temp_lab_purchase_up_w5_10_to_w10_20,
           CASE WHEN d > a THEN 1 ELSE 0 END AS f_temp_lab_purchase_late_gt_early, CASE WHEN b > a OR d > b THEN 1 ELSE 0 END AS f_temp_lab_purchase_any_up,
           round(b - a, 6) AS f_temp_lab_purchase_delta_w0_5_to_w5_10, round(d - b, 6) AS f_temp_lab_purchase_delta_w5_10_to_w10_20, round(d - a, 6) AS f_temp_lab_purchase_delta_overall FROM m""")
def lab_trends(r):
    return M.lab_trends(lab_summary(r), r.stream_cohort, ["w0_5", "w5_10", "w10_20"], {"purchase": "up"})


@query("and_composites", f"""
    WITH l AS ({LAB_SQL}), h AS ({_HITS}), f AS (
        SELECT w.person_id, w.win, max(CASE WHEN i = 'CLK' THEN 1 ELSE 0 END) AS c, coalesce(max(a.abnormal_any), 0) AS a, coalesce(max(b.abnormal_any), 0) AS b
        FROM s_win w LEFT JOIN h ON h.person_id = w.person_id AND h.win = w.win LEFT JOIN l a ON a.person_id = w.person_id AND a.win = w.win AND a.lab = 'purchase'
        LEFT JOIN l b ON b.person_id = w.person_id AND b.win = w.win AND b.lab = 'error' GROUP BY 1, 2)
    SELECT person_id, win, c * a AS f_comp_complement_ddimer, c * a * b AS f_comp_complement_crp_ddimer, c + a + b AS f_comp_complement_crp_ddimer_count FROM f""")
def and_composites(r):
    signals = build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS)
    labs = lab_matrix(lab_summary(r), r.stream_cohort, STREAM_WINDOWS, ["purchase", "error"])
    both = signals.join(labs, ["person_id", "window"])
    out = M.and_composites(both, F.col("f_ind_clk"), "f_lab_purchase_abnormal_any", "f_lab_error_abnormal_any")
    return out.withColumnRenamed("window", "win")


@query("organ_injury", f"""
    WITH l AS ({LAB_SQL})
    SELECT w.person_id, w.win, coalesce(max(abnormal_any) FILTER (lab IN ('purchase', 'click')), 0) AS f_comp_cardiac_injury,
           round(max(CASE lab WHEN 'purchase' THEN peak / 60.0 WHEN 'click' THEN peak / 40.0 END), 6) AS f_comp_cardiac_injury_score,
           coalesce(max(abnormal_any) FILTER (lab = 'error'), 0) AS f_comp_renal_injury, round(max(peak / 5.0) FILTER (lab = 'error'), 6) AS f_comp_renal_injury_ratio
    FROM s_win w LEFT JOIN l ON l.person_id = w.person_id AND l.win = w.win GROUP BY 1, 2""")
def organ_injury(r):
    every = cohort_windows(r.stream_cohort, STREAM_WINDOWS)
    out = M.organ_injury(lab_summary(r), every, {"purchase": 60.0, "click": 40.0}, ("error", 5.0))
    return out.withColumnRenamed("window", "win")


def _named(pattern):
    return f"concept_id IN (SELECT concept_id FROM concept WHERE lower(concept_name) LIKE '{pattern}')"


_GI = f"""
    SELECT c.person_id, {flag("k = 'c' AND " + below(4000003), 'f_comp_gi_a')}, {flag("k = 'p' AND " + _named('%red%'), 'f_comp_gi_b')}, {flag("k = 'd' AND " + _named('%blue%bolt%'), 'f_comp_gi_c')}
    FROM cohort c LEFT JOIN (SELECT person_id, event_date, concept_id, 'c' AS k FROM conditions UNION ALL SELECT person_id, event_date, concept_id, 'p' FROM procedures
        UNION ALL SELECT person_id, event_date, concept_id, 'd' FROM drugs) e ON e.person_id = c.person_id AND e.event_date BETWEEN c.index_date + 30 AND c.index_date + 180 GROUP BY 1"""


@query("gi_cluster", f"SELECT *, CASE WHEN f_comp_gi_a + f_comp_gi_b + f_comp_gi_c > 0 THEN 1 ELSE 0 END AS f_comp_gi_any, f_comp_gi_a + f_comp_gi_b + f_comp_gi_c AS f_comp_gi_burden_score FROM ({_GI})")
def gi_cluster(r):
    sets = {
        "f_comp_gi_a": (r.conditions, ConceptSpec(ancestors=(REGION + 3,))), "f_comp_gi_b": (r.procedures, ConceptSpec(names=("%red%",))),
        "f_comp_gi_c": (r.drugs, ConceptSpec(names=("%blue%bolt%",))),
    }
    cohort = r.cohort.withColumn("from", F.date_add("index_date", 30)).withColumn("to", F.date_add("index_date", 180))
    days = None
    for name, (events, spec) in sets.items():
        part = B.set_days(events, resolve_all(r.vocabulary, {name: [spec]}))
        days = part if days is None else days.unionByName(part)
    found = B.in_person_window(days, cohort, "from", "to")
    return M.burden(B.flags(cohort, found, list(sets)))


@query("late_divergence", f"""
    WITH h AS (SELECT person_id, win, i FROM ({_HITS}) WHERE win IN ('w5_10', 'w10_20'))
    SELECT c.person_id, CASE WHEN count(DISTINCT win) FILTER (i IN ('ERR', 'BUY')) > 0 THEN 1 ELSE 0 END AS f_comp_td_x, count(DISTINCT win) FILTER (i IN ('ERR', 'BUY')) AS f_comp_td_x_n_windows,
           CASE WHEN count(DISTINCT win) FILTER (i = 'CLK') > 0 THEN 1 ELSE 0 END AS f_comp_td_y, count(DISTINCT win) FILTER (i = 'CLK') AS f_comp_td_y_n_windows,
           CASE WHEN count(*) FILTER (i = 'ERR') > 0 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (i IN ('CLK', 'BUY')) > 0 THEN 1 ELSE 0 END AS f_comp_td_multisystem_late
    FROM s_cohort c LEFT JOIN h USING (person_id) GROUP BY 1""")
def late_divergence(r):
    features = [s.name for s in _SPECS]
    return M.late_divergence(
        hits(r).withColumnRenamed("indicator", "feature"), r.stream_cohort, STREAM_WINDOWS, features,
        {"f_comp_td_x": ("ERR", "BU"), "f_comp_td_y": ("CLK",)}, {"viral": ("ERR",), "immuno": ("CLK", "BUY")}, min_start=5, max_end=20,
    )


# ------------------------------------------------------------------ assembly

_FULL_COLUMNS = ["f_lab_purchase_measured", "f_lab_purchase_peak", "f_lab_purchase_abnormal_count"]


def grouped_specs():
    return [replace(s, group=g) for s, g in zip(_SPECS, ("viral", "immuno", "endo"))]


def full_matrix(r, window="w0_10"):
    """Baseline, signals, laboratory columns and a composite of one window, filled by family rules."""
    cohort = r.stream_cohort
    baseline = cohort.select("person_id", F.dayofmonth("index_date").alias("f_age"))
    one = [w for w, label in zip(STREAM_WINDOWS, STREAM_LABELS) if label == window]
    specs = grouped_specs()
    found = indicator_hits(r.stream, cohort, one, specs, r.stream_vocabulary)
    signals = build_signals(found, cohort, one, specs).drop("window")
    summary = lab_summary(r).where(F.col("window") == window)
    labs = lab_matrix(summary, cohort, one, ["purchase"]).select("person_id", *_FULL_COLUMNS)
    organs = M.organ_injury(summary, cohort_windows(cohort, one), {"click": 40.0}, ("error", 5.0)).drop("window")
    counts = cohort.select("person_id", F.lit(None).cast("double").alias("f_cbc_nlr_peak"))
    return A.assemble_full(baseline, {"core_demographics": ["f_age"]}, signals, labs, counts, composites=organs)


@query("assemble_full", f"""
    WITH l AS ({LAB_SQL}), h AS ({_HITS}), b AS (
        SELECT c.person_id, CAST(day(index_date) AS DOUBLE) AS f_age, max(CASE WHEN i = 'ERR' THEN 1 ELSE 0 END) AS f_ind_viral_err,
               max(CASE WHEN i = 'CLK' THEN 1 ELSE 0 END) AS f_ind_immuno_clk, max(CASE WHEN i = 'BUY' THEN 1 ELSE 0 END) AS f_ind_endo_buy,
               max(CASE WHEN lab = 'purchase' THEN 1 ELSE 0 END) AS f_lab_purchase_measured, max(peak) FILTER (lab = 'purchase') AS p,
               coalesce(max(abnormal_count) FILTER (lab = 'purchase'), 0) AS f_lab_purchase_abnormal_count,
               coalesce(max(abnormal_any) FILTER (lab = 'click'), 0) AS f_comp_cardiac_injury, max(peak / 40.0) FILTER (lab = 'click') AS s,
               coalesce(max(abnormal_any) FILTER (lab = 'error'), 0) AS f_comp_renal_injury, max(peak / 5.0) FILTER (lab = 'error') AS t
        FROM s_cohort c LEFT JOIN h ON h.person_id = c.person_id AND h.win = 'w0_10' LEFT JOIN l ON l.person_id = c.person_id AND l.win = 'w0_10' GROUP BY 1, index_date)
    SELECT person_id, f_age, f_ind_viral_err, f_ind_immuno_clk, f_ind_endo_buy, f_lab_purchase_measured, f_lab_purchase_abnormal_count, f_comp_cardiac_injury, f_comp_renal_injury,
           round(coalesce(p, (SELECT median(p) FROM b)), 6) AS f_lab_purchase_peak, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS f_lab_purchase_peak_miss,
           CAST(0 AS DOUBLE) AS f_cbc_nlr_peak, 1 AS f_cbc_nlr_peak_miss, round(coalesce(s, (SELECT median(s) FROM b)), 6) AS f_comp_cardiac_injury_score, CASE WHEN s IS NULL THEN 1 ELSE 0 END AS f_comp_cardiac_injury_score_miss,
           round(coalesce(t, (SELECT median(t) FROM b)), 6) AS f_comp_renal_injury_ratio, CASE WHEN t IS NULL THEN 1 ELSE 0 END AS f_comp_renal_injury_ratio_miss FROM b""")
def assemble_full(r):
    return full_matrix(r)[0]


_ROUTE_ROWS = """
    SELECT family, p_name || suffix AS feature FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN
    (VALUES ('numeric_labs', '_crp_peak'), ('numeric_labs', '_ddimer_peak'), ('cbc_indices', '_plr_peak'), ('cbc_indices', '_nlr_peak'), ('composites', '_td_multisystem_late'),
            ('composites', '_gi_any'), ('composites', '_complement_ddimer'), ('composites', '_cardiac'), ('mechsig_viral', '_x'), ('ext_features', '_y')) v(family, suffix)"""


@query("route_features", f"""
    SELECT family, feature, CASE family WHEN 'numeric_labs' THEN CASE WHEN feature LIKE '%crp%' THEN 'immuno' ELSE 'endo' END WHEN 'cbc_indices' THEN CASE WHEN feature LIKE '%plr%' THEN 'endo' ELSE 'immuno' END
           WHEN 'composites' THEN CASE WHEN feature LIKE '%multisystem%' THEN 'none' WHEN feature LIKE '%\\_gi\\_%' ESCAPE '\\' THEN 'viral' WHEN feature LIKE '%complement%' THEN 'immuno' ELSE 'endo' END
           WHEN 'mechsig_viral' THEN 'viral' ELSE 'none' END AS mechanism FROM ({_ROUTE_ROWS})""")
def route_features(r):
    suffixes = [
        ("numeric_labs", "_crp_peak"), ("numeric_labs", "_ddimer_peak"), ("cbc_indices", "_plr_peak"), ("cbc_indices", "_nlr_peak"),
        ("composites", "_td_multisystem_late"), ("composites", "_gi_any"), ("composites", "_complement_ddimer"), ("composites", "_cardiac"),
        ("mechsig_viral", "_x"), ("ext_features", "_y"),
    ]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("suffix")) for f, s in suffixes]))
    names = r.table("part").select("p_name").distinct().select("p_name", pairs.alias("v"))
    return A.route_features(names.select("v.family", F.concat("p_name", "v.suffix").alias("feature")))


@query("project_config", f"""
    WITH h AS ({_HITS}), f(config, i) AS (VALUES ('base', 'ERR'), ('more', 'ERR'), ('more', 'CLK'), ('all', 'ERR'), ('all', 'CLK'), ('all', 'BUY'))
    SELECT config, win, i AS feature, count(*) AS n FROM h JOIN f USING (i) GROUP BY 1, 2, 3""")
def project_config(r):
    configs = {"base": ["ERR"], "more": ["ERR", "CLK"], "all": ["ERR", "CLK", "BUY"]}
    table = A.config_table(r.spark, configs)
    rows = hits(r).withColumnRenamed("indicator", "feature").join(table, "feature")
    return rows.groupBy("config", F.col("window").alias("win"), "feature").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ validation


@query("prevalence", f"""
    WITH h AS ({_HITS}), n AS (SELECT count(*) AS n FROM s_win) SELECT 'f_ind_' || lower(i) AS feature, round(count(*) / (SELECT n FROM n), 6) AS prevalence FROM h GROUP BY 1""")
def prevalence(r):
    return V.prevalence(build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS))


@query("prevalence_extremes", f"""
    WITH h AS ({_HITS}), p AS (SELECT 'f_ind_' || lower(i) AS feature, round(count(*) / (SELECT count(*) FROM s_win), 6) AS prevalence FROM h GROUP BY 1)
    (SELECT *, 'top' AS side FROM p ORDER BY prevalence DESC, feature LIMIT 2) UNION ALL (SELECT *, 'bottom' FROM p ORDER BY prevalence, feature LIMIT 2)""")
def prevalence_extremes(r):
    return V.top_and_bottom(V.prevalence(build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS)), 2)


@query("validate_signals", """
    SELECT 'bad_name' AS rule, 1 AS n UNION ALL SELECT 'not_integer', 0 UNION ALL SELECT 'duplicate_id', 0 UNION ALL SELECT 'unknown_id', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT person_id FROM cohort))
    UNION ALL SELECT 'missing_id', 0 UNION ALL SELECT 'nulls', (SELECT count(*) FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 'not_binary', (SELECT count(*) FILTER (c_custkey % 3 NOT IN (0, 1)) FROM customer)""")
def validate_signals(r):
    table = r.table("customer").select(
        F.col("c_custkey").alias("person_id"), (F.col("c_custkey") % 3).alias("f_ind_a"), F.when(F.col("c_acctbal") >= 0, 1).alias("other")
    )
    return V.validate_signals(table, r.cohort)


@query("compare_structure", """
    SELECT 'columns_only_in_a' AS "check", 1 AS n UNION ALL SELECT 'columns_only_in_b', 0 UNION ALL SELECT 'type_differs', 1
    UNION ALL SELECT 'ids_only_in_a', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT person_id FROM cohort)) UNION ALL SELECT 'ids_only_in_b', 0""")
def compare_structure(r):
    a = r.table("customer").select(F.col("c_custkey").alias("person_id"), F.lit(1).alias("x"), F.lit(1).alias("y"))
    b = r.cohort.select("person_id", F.lit(1.0).alias("x"))
    return V.compare_structure(a, b)


@query("verify_partition", """
    WITH b AS (SELECT CASE WHEN index_date < DATE '1996-01-01' THEN 1 ELSE 0 END AS a, CASE WHEN index_date BETWEEN DATE '1995-07-01' AND DATE '1997-01-01' THEN 1 ELSE 0 END AS c FROM cohort)
    SELECT count(*) AS n, count(*) FILTER (a + c > 1) AS n_overlapping, count(*) FILTER (a + c = 0) AS n_outside, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(c) AS BIGINT) AS n_c FROM b""")
def verify_partition(r):
    df = r.cohort.select(
        (F.col("index_date") < F.lit("1996-01-01").cast("date")).cast("int").alias("a"),
        F.col("index_date").between(F.lit("1995-07-01").cast("date"), F.lit("1997-01-01").cast("date")).cast("int").alias("c"),
    )
    return V.verify_partition(df, ["a", "c"])


@query("blocklist_audit", f"""
    WITH p AS (SELECT 'f_ind_' || lower(i) AS feature, round(count(*) / (SELECT count(*) FROM s_win), 6) AS prevalence FROM ({_HITS}) GROUP BY 1)
    SELECT subtype, config, feature, prevalence FROM p CROSS JOIN (VALUES ('s1', '__full_table__'), ('s1', 'all')) v(subtype, config) WHERE feature LIKE '%err' OR feature LIKE '%buy'
    UNION ALL SELECT 's2', '__full_table__', * FROM p WHERE feature LIKE '%clk' UNION ALL SELECT 's2', 'all', * FROM p WHERE feature LIKE '%clk'
    UNION ALL SELECT 's1', 'base', * FROM p WHERE feature LIKE '%err'""")
def blocklist_audit(r):
    signals = build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS)
    columns = [c for c in signals.columns if c.startswith("f_")]
    rules = {"s1": ["f_ind_err", "re:^f_ind_b.y$"], "s2": ["re:clk$"]}
    audit = A.blocklist_audit(r.spark, rules, columns, {"base": ["f_ind_err"], "all": columns})
    return V.prevalence(signals).join(audit, "feature")


@query("families_table", f"""
    SELECT CASE i WHEN 'ERR' THEN 'mechsig_viral' WHEN 'CLK' THEN 'mechsig_immuno' ELSE 'mechsig_endo' END AS family,
           CASE i WHEN 'ERR' THEN 'f_ind_viral_err' WHEN 'CLK' THEN 'f_ind_immuno_clk' ELSE 'f_ind_endo_buy' END AS feature, 0 AS ordinal,
           round(count(*) / (SELECT count(*) FROM s_win), 6) AS prevalence FROM ({_HITS}) GROUP BY i""")
def families_table_q(r):
    """Families of the indicator columns next to how often each column is set."""
    specs = grouped_specs()
    signals = build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, specs)
    families = A.mechanism_families(c for c in signals.columns if c.startswith("f_"))
    return V.prevalence(signals).join(families_table(r.spark, families), "feature")


@query("assemble_baseline", f"""
    WITH h AS (SELECT c.person_id, {flag(below(3000001), 'f_c_n1')}, {flag(below(4000000), 'f_c_r0')}
               FROM cohort c LEFT JOIN conditions e ON e.person_id = c.person_id AND e.event_date <= c.index_date GROUP BY 1),
    v AS (SELECT c.person_id, count(DISTINCT v.event_id) AS n FROM cohort c JOIN visits v ON v.person_id = c.person_id AND v.event_date BETWEEN c.index_date - 365 AND c.index_date - 1 GROUP BY 1)
    SELECT c.person_id, f_c_n1, f_c_r0, age_at_index AS f_age,
           CASE WHEN gender_concept_id = 8532 THEN 1 ELSE 0 END AS f_sex_female, CASE WHEN gender_concept_id = 8507 THEN 1 ELSE 0 END AS f_sex_male,
           CASE WHEN gender_concept_id IN (8532, 8507) THEN 0 ELSE 1 END AS f_sex_unknown, coalesce(n, 0) AS f_eng_n_encounters_pre_index_1y
    FROM cohort c JOIN h USING (person_id) LEFT JOIN v USING (person_id)""")
def assemble_baseline_q(r):
    """Families joined by one union and one pivot."""
    engagement = B.engagement_controls(r.cohort, r.visits, r.providers, r.plans, (), {}).select("person_id", "f_eng_n_encounters_pre_index_1y")
    groups = {
        "core_comorbidities": [B.ancestor_flags(r.conditions, r.cohort, r.vocabulary, {"f_c_n1": (NATION + 1,), "f_c_r0": (REGION,)})],
        "core_demographics": [B.one_hot_demographics(r.cohort)],
        "engagement_controls": [engagement],
    }
    return assemble_baseline(r.cohort, groups)[0]
