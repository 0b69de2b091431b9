import pytest
from pyspark.sql import functions as F

from days import day
from eventloom.operators import assemble as A
from eventloom.operators import blocks as B
from eventloom.operators import cohort as C
from eventloom.operators import labs as L
from eventloom.operators import multiwindow as M
from eventloom.operators import validate as V
from eventloom.operators import windows as W
from eventloom.operators.concepts import ConceptSpec, load_ontology_map, resolve, resolve_all
from eventloom.plans import codesets

COHORT = "person_id BIGINT, index_date DATE, label INT, is_inpatient INT, discharge_date DATE, first_outcome_date DATE"


def people(spark, *rows):
    return spark.createDataFrame(rows, COHORT)


def test_acute_window_follows_a_late_discharge(spark):
    df = people(spark, (1, day(0), 0, 1, day(40), None), (2, day(0), 0, 1, day(5), None), (3, day(0), 0, 0, None, None))
    ends = {r.person_id: r.acute_end for r in C.acute_window(df, 21).collect()}
    assert ends == {1: day(40), 2: day(21), 3: day(21)}


def test_death_buckets(spark):
    df = C.acute_window(
        people(
            spark, (1, day(0), 0, 0, None, None), (2, day(0), 0, 0, None, None), (3, day(0), 1, 0, None, day(100)),
            (4, day(0), 0, 0, None, None), (5, day(0), 1, 1, day(150), day(100)), (6, day(0), 0, 0, None, None),
        )
    )
    deaths = spark.createDataFrame([(1, day(0)), (2, day(10)), (3, day(200)), (4, day(60)), (5, day(120))], "person_id BIGINT, death_date DATE")
    extent = spark.createDataFrame([(i, day(400)) for i in range(1, 7)], "person_id BIGINT, obs_end DATE")
    cutoff = spark.createDataFrame([(day(300),)], "data_cutoff DATE")
    out = {r.person_id: r for r in C.death_and_followup(df, deaths, extent, cutoff, 90).collect()}
    assert set(out) == {3, 4, 6}  # dead at index, in the window, and in a long window after the outcome are gone
    assert out[3].death_bucket == C.DEAD_AFTER_OUTCOME and out[3].followup_days == 200
    assert out[4].death_bucket == C.DEAD_LATER and out[4].eligibility_status == "censored"
    assert out[6].followup_days == 300 and out[6].eligibility_status == "confirmed_negative"


def test_label_boundary_and_gate(spark):
    base = spark.createDataFrame([(1, day(0)), (2, day(0)), (3, day(0))], "person_id BIGINT, index_date DATE")
    outcome = spark.createDataFrame([(1, day(89)), (2, day(90))], "person_id BIGINT, first_outcome_date DATE")
    labelled = C.label_outcome(base, outcome, 90)
    assert {r.person_id: r.label for r in labelled.collect()} == {1: 0, 2: 1, 3: 0}
    full = labelled.withColumn("obs_end", F.lit(day(1000))).withColumn("death_date", F.lit(None).cast("date"))
    assert sorted(r.person_id for r in C.modelling_gates(full, "2030-01-01").collect()) == [2, 3]


def test_integrity_raises_with_samples(spark):
    df = C.acute_window(people(spark, (7, day(0), 1, 0, None, day(10))))
    counts = {r.rule: r.n for r in C.temporal_integrity(df).collect()}
    assert counts["outcome_inside_feature_window"] == 1 and counts["outcome_window_short"] == 0
    with pytest.raises(ValueError, match="7"):
        C.temporal_integrity(df, strict=True)


def test_setting_overlap_and_open_end(spark, make_events):
    visits = make_events(
        [dict(concept_id=9, day=-3, end_date=day(-1)), dict(concept_id=9, day=17, person_id=2), dict(concept_id=9, day=16, person_id=3)], "visit"
    )
    base = spark.createDataFrame([(i, day(0)) for i in (1, 2, 3)], "person_id BIGINT, index_date DATE")
    out = {r.person_id: (r.is_inpatient, r.discharge_date) for r in C.classify_setting(base, visits, [9]).collect()}
    assert out == {1: (1, day(-1)), 2: (0, None), 3: (1, day(16))}


def test_resolution(vocabulary):
    def get(*specs):
        return sorted(r.concept_id for r in resolve(vocabulary, *specs).collect())

    assert get(ConceptSpec(codes=("1-1",))) == [1]  # not the retired one
    assert get(ConceptSpec(ancestors=(10,))) == [10, 11]
    assert get(ConceptSpec(ids=(1, 5)), ConceptSpec(codes=("1-1", "2-2"))) == [1, 2, 5]
    assert get(ConceptSpec(names=("%disease%",), domain="Condition")) == [10, 11]
    assert get(ConceptSpec(ingredients=("STEROID",))) == [20, 21]


def test_ontology_labels_align_by_position(spark):
    raw = spark.createDataFrame(
        [(1, "HP_0000001 | XX_2 | HP_0000003", "one | two | three", "t"), (2, "HP_0000004 | HP_0000005", "four", "t")],
        "concept_id BIGINT, ontology_id STRING, ontology_label STRING, mapping_category STRING",
    )
    rows = {(r.concept_id, r.term_id, r.term_label) for r in load_ontology_map(raw).collect()}
    assert rows == {(1, "HP:0000001", "one"), (1, "HP:0000003", "three"), (2, "HP:0000004", "four"), (2, "HP:0000005", "")}


def test_last_value_tie_goes_to_the_higher_id(make_events, cohort):
    events = make_events([dict(concept_id=1, day=0, value=1.0), dict(concept_id=1, day=0, value=2.0), dict(concept_id=1, day=1, value=9.0)])
    row = B.last_value_before(events, cohort, {"f_bmi": 1}).where("person_id = 1").first()
    assert row.f_bmi == 2.0


def test_clean_name(spark):
    names = spark.createDataFrame([("Vitamin B-12 (oral), 5/10",), ("x" * 80,)], "n STRING").select(B.clean_name(F.col("n")).alias("c")).collect()
    assert names[0].c == "f_drug_vitamin_b_12_oral_5_10"
    assert names[1].c == "f_drug_" + "x" * 60


def test_platelet_low_limit_is_never_used(make_events, cohort, spark):
    members = spark.createDataFrame([(1, "plt", 400.0, 150.0)], "concept_id BIGINT, lab STRING, high DOUBLE, low DOUBLE")
    events = make_events([dict(concept_id=1, day=1, value=100.0)])
    assert L.lab_summary(events, cohort, [(0, 5)], members).first().abnormal_any == 0


def test_shared_concept_belongs_to_the_later_lab(vocabulary):
    specs = [L.LabSpec("ast", (ConceptSpec(ids=(1,)),), 40.0), L.LabSpec("alt", (ConceptSpec(ids=(1,)),), 50.0)]
    assert [r.lab for r in L.lab_membership(vocabulary, specs).collect()] == ["alt"]
    assert sorted(r.lab for r in L.lab_membership(vocabulary, specs, last_wins=False).collect()) == ["alt", "ast"]


def test_lab_summary_of_a_person_with_most_rows(make_events, cohort, spark):
    import statistics

    members = spark.createDataFrame([(1, "crp", 10.0, None)], "concept_id BIGINT, lab STRING, high DOUBLE, low DOUBLE")
    values = [((i * 37) % 101) / 7 for i in range(301)]
    events = make_events([dict(concept_id=1, day=i % 9, value=v) for i, v in enumerate(values)])
    row = L.lab_summary(events, cohort, [(0, 10)], members).first()
    assert row.median == pytest.approx(statistics.median(values)) and row.peak == max(values)
    assert row.abnormal_count == sum(v > 10 for v in values)
    last = max((i % 9, i) for i in range(301))[1]
    assert row.last == values[last]


def test_slope_needs_two_days(make_events, cohort, spark):
    members = spark.createDataFrame([(1, "neut"), (2, "lymph")], "concept_id BIGINT, lab STRING")
    rows = [dict(concept_id=c, day=d, value=float(v)) for c, d, v in ((1, 1, 4), (2, 1, 2))]
    names = ["neut", "lymph", "mono", "eos", "plt", "rdw"]
    one = L.series_dynamics(L.daily_components(make_events(rows), cohort, [(0, 9)], members, names)).first()
    assert one.nlr_slope is None and one.lymph_delta is None
    rows += [dict(concept_id=c, day=d, value=float(v)) for c, d, v in ((1, 3, 8), (2, 3, 1))]
    two = L.series_dynamics(L.daily_components(make_events(rows), cohort, [(0, 9)], members, names)).first()
    assert two.nlr_slope == pytest.approx(3.0) and two.lymph_delta == pytest.approx(-1.0)


def test_late_composites(spark, cohort):
    hits = spark.createDataFrame([(1, "w30_60", "f_a_x"), (1, "w60_90", "f_a_x"), (2, "w0_21", "f_a_x")], "person_id BIGINT, window STRING, feature STRING")
    windows = [(0, 21), (30, 60), (60, 90)]

    def run(**kw):
        return {r.person_id: r for r in M.late_divergence(hits, cohort, windows, ["f_a_x"], {"c": ("a_x",)}, {"viral": ("a_",)}, **kw).collect()}

    assert run()[1].c_n_windows == 2 and run()[2].c == 0
    assert run(max_end=60)[1].c_n_windows == 1
    gated = run(max_end=21)
    assert gated[1].c == 0 and "c_n_windows" not in gated[1].asDict()
    with pytest.raises(ValueError, match="matches no feature"):
        M.late_divergence(hits, cohort, windows, ["f_a_x"], {"c": ("nothing",)}, {})


def test_subtypes_only_for_cases(spark, make_events, vocabulary):
    base = spark.createDataFrame([(1, day(0), 1), (2, day(0), 0)], "person_id BIGINT, index_date DATE, label INT")
    events = make_events([dict(concept_id=11, day=100), dict(concept_id=11, day=100, person_id=2)], "condition")
    out = {r.person_id: r.g for r in B.subtype_labels(events, base, vocabulary, {"g": ConceptSpec(ancestors=(10,))}).collect()}
    assert out == {1: 1, 2: 0}


def test_windows_helpers():
    assert W.sequential_windows(0, 20, 6) == [(0, 6), (6, 12), (12, 18), (18, 20)]
    assert W.ordered_labels(["w30_60", "w0_90", "w0_21"]) == ["w0_21", "w0_90", "w30_60"]


# ------------------------------------------------------------------ configurations


FAMILIES = {
    "core_comorbidities": ["f_comor_a"], "core_symptoms": ["f_sym_hpo_x"], "core_drugs": ["f_drug_d"], "core_demographics": ["f_age"],
    "core_treatment": ["f_tx_los"], "ext_features": ["f_ext_bmi_last"], "engagement_controls": ["f_eng_n", "f_eng_p"],
    "mechsig_viral": ["f_ind_viral_w0_90_a"], "mechsig_immuno": ["f_ind_immuno_w0_90_b"], "mechsig_endo": ["f_ind_endo_w0_90_c"],
    "mechsig_exploratory": ["f_ind_expl_t"], "numeric_labs": ["f_lab_w0_90_crp_peak", "f_lab_w0_90_troponin_peak"],
    "cbc_indices": ["f_cbc_w0_90_nlr_peak", "f_cbc_w0_90_plr_peak"],
    "composites": ["f_comp_w0_90_complement_ddimer", "f_comp_td_multisystem_late", "f_comp_td_post_acute_respiratory"],
}


def test_configurations_nest_and_strip():
    c = A.build_configs(FAMILIES)
    assert len(c) == 19
    core, ext = set(c["baseline_core"]), set(c["baseline_ext"])
    assert core < set(c["baseline_core_eng"]) < ext
    added = {m: set(c[f"mechsig_{m}"]) - ext for m in A.MECHANISMS}
    assert not added["viral"] & added["immuno"] and not added["viral"] & added["endo"] and not added["immuno"] & added["endo"]
    for m in A.MECHANISMS:
        assert ext < set(c[f"mechsig_{m}"]) <= set(c["mechsig_all"])
    for only in ("f_ind_expl_t", "f_comp_td_multisystem_late"):
        assert [n for n in c if only in c[n] and n.startswith("mechsig_") and "all" not in n and "full" not in n] == []
        assert only in c["mechsig_all"]
    for base in ("baseline_ext", "mechsig_all"):
        assert set(c[f"{base}_no_td"]) == {x for x in c[base] if not x.startswith("f_comp_td_")}
        assert set(c[f"{base}_no_eng"]) == {x for x in c[base] if not x.startswith("f_eng_")}
    assert len(A.build_simple_configs(FAMILIES)) == 6


def test_blocklist_misses_raise():
    assert A.resolve_blocklist(["a", "re:^b_"], ["a", "b_1", "b_2", "c"]) == ["a", "b_1", "b_2"]
    with pytest.raises(ValueError, match="zz"):
        A.resolve_blocklist(["a", "zz"], ["a"])
    with pytest.raises(ValueError):
        A.mechanism_families(["f_ind_other_x"])


def test_withhold_removes_everywhere(spark):
    df = spark.createDataFrame([(1, 2, 3)], "person_id INT, a INT, b INT")
    out, fam, conf = A.withhold(df, {"f": ["a", "b"]}, {"c": ["b"]}, ["b"])
    assert out.columns == ["person_id", "a"] and fam == {"f": ["a"]} and conf == {"c": []}


def test_fill_marks_missing_and_uses_the_median(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, None), (4, 8.0, None)], "person_id INT, x DOUBLE, y DOUBLE")
    rows = {r.person_id: r for r in A.miss_and_fill(df, ["x", "y"]).collect()}
    assert rows[3].x == 3.0 and rows[3].x_miss == 1 and rows[1].x_miss == 0 and rows[1].y == 0.0


def test_wide_pivot_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(A, "PIVOT_WIDTH", 2)
    wide = spark.createDataFrame([(1, 1.0, None, 3.0), (2, 4.0, 5.0, None)], "person_id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    back = A.to_wide(A.to_long(wide), ["a", "b", "c"]).orderBy("person_id").collect()
    assert [tuple(r) for r in back] == [(1, 1.0, None, 3.0), (2, 4.0, 5.0, None)]


def test_blocklists_of_the_catalogue_hit_catalogue_columns():
    from eventloom.operators.indicators import feature_name
    from eventloom.plans import catalogue

    columns = [feature_name(s, "w0_90") for s in catalogue.active()]
    columns += [*codesets.COMORBIDITIES, *codesets.SYMPTOM_TERMS, *codesets.EXTRA_SYMPTOM_TERMS, *codesets.FURTHER_SYMPTOMS]
    columns += [*codesets.GI_SYMPTOMS, "f_comp_gi_any", "f_comp_gi_burden_score", *codesets.LATE_COMPOSITES]
    for entries in codesets.BLOCKLIST.values():
        assert A.resolve_blocklist(entries, columns)
    for parts in codesets.LATE_COMPOSITES.values():
        assert parts


def test_validation_counts(spark, cohort):
    signals = spark.createDataFrame([(1, 1), (1, None), (9, 2)], "person_id BIGINT, f_a INT")
    found = {r.rule: r.n for r in V.validate_signals(signals, cohort).collect()}
    assert found == {"bad_name": 0, "not_integer": 0, "nulls": 1, "not_binary": 1, "duplicate_id": 1, "missing_id": 1, "unknown_id": 1}


def test_sets_are_resolved_together(vocabulary):
    rows = {(r.set_id, r.concept_id) for r in resolve_all(vocabulary, {"a": [ConceptSpec(ids=(7,))], "b": [ConceptSpec(ancestors=(10,))]}).collect()}
    assert rows == {("a", 7), ("b", 10), ("b", 11)}




def test_whole_baseline_plan(spark, make_events, vocabulary):
    from eventloom.plans.features import FeatureInputs, baseline_matrix

    rows = C.acute_window(people(spark, (1, day(0), 0, 0, None, None), (2, day(0), 0, 1, day(3), None)))
    rows = rows.withColumn("age_at_index", F.lit(50)).withColumn("gender_concept_id", F.lit(8532).cast("long"))
    drugs = make_events([dict(concept_id=21, day=1, person_id=p, source_text="x") for p in (1, 2)], "drug")
    visits = make_events([dict(concept_id=9201, day=0, end_date=day(3), person_id=2), dict(concept_id=9, day=-10)], "visit")
    none = make_events([dict(concept_id=0, day=-999, person_id=99)])
    inputs = FeatureInputs(
        none, none, none, none, drugs, visits, spark.createDataFrame([(1, 1, "x")], "provider_id BIGINT, specialty_concept_id BIGINT, specialty_source_value STRING"),
        spark.createDataFrame([(1, "icu")], "site_id BIGINT, site_name STRING"),
        spark.createDataFrame([(1, "Medicaid HMO", day(-5), None)], "person_id BIGINT, payer STRING, plan_start DATE, plan_end DATE"), vocabulary,
    )
    matrix, families = baseline_matrix(inputs, rows)
    got = {r.person_id: r.asDict() for r in matrix.collect()}
    assert set(families) == {"core_comorbidities", "core_symptoms", "core_drugs", "core_demographics", "core_treatment", "ext_features", "engagement_controls"}
    assert got[1]["f_drug_steroid"] == 1 and got[2]["f_ext_hosp_acute"] == 1 and got[2]["f_tx_los"] == 3
    assert got[1]["f_eng_insurance_medicaid"] == 1 and got[1]["f_eng_insurance_commercial"] == 1
    assert got[1]["f_eng_n_encounters_pre_index_1y"] == 1 and got[1]["f_ext_bmi_last"] is None
    assert len(matrix.columns) == 1 + sum(map(len, families.values()))
