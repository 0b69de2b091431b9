"""Every indicator kind on hand-made rows, one test per rule that is easy to get wrong."""

import pytest

from eventloom.operators.concepts import ConceptSpec
from eventloom.operators.indicators import KINDS, IndicatorSpec, build_signals, feature_name, indicator_hits
from eventloom.plans import catalogue

POS, NEG = 901, 902


def ids(*v):
    return (ConceptSpec(ids=v),)


@pytest.fixture
def hit(make_events, cohort, vocabulary):
    def run(spec, rows, window=(0, 90), domain="measurement", **kw):
        out = indicator_hits(make_events(rows, domain), cohort, [window], [spec], vocabulary, **kw)
        return sorted(r.person_id for r in out.collect())

    return run


def episodes(gap=30, n=2):
    return IndicatorSpec("E", "COND_EPISODES_GAP", ids(10), gap=gap, min_n=n)


def test_episode_gap_is_measured_from_row_to_row(hit):
    assert hit(episodes(), [dict(concept_id=10, day=d) for d in (0, 20, 40)], domain="condition") == []
    assert hit(episodes(), [dict(concept_id=10, day=d) for d in (0, 31)], domain="condition") == [1]
    assert hit(episodes(), [dict(concept_id=10, day=d) for d in (0, 30)], domain="condition") == [1]


def persistent(**kw):
    return IndicatorSpec("P", "MEAS_PERSISTENT_POSITIVITY", ids(1), positive=(POS,), negative=(NEG,), **kw)


def result(code, d):
    return dict(concept_id=1, value_concept_id=code, day=d)


def test_persistent_run_is_broken_by_a_negative(hit):
    assert hit(persistent(), [result(POS, 1), result(POS, 5)]) == [1]
    assert hit(persistent(), [result(POS, 1), result(NEG, 3), result(POS, 5)]) == []
    # same day: negatives are taken first
    assert hit(persistent(), [result(POS, 1), result(NEG, 1), result(POS, 5)]) == [1]


def test_anchored_run_needs_one_late_positive_before_any_negative(hit):
    spec = persistent(anchored=True, min_day=21)
    assert hit(spec, [result(POS, 25)]) == [1]
    assert hit(spec, [result(POS, 20)]) == []
    assert hit(spec, [result(NEG, 10), result(POS, 25)]) == []


def test_text_results_count_only_without_a_code(hit):
    def text(t, d):
        return dict(concept_id=1, value_text=t, source_text="pcr", day=d)

    assert hit(persistent(), [text("Detected", 1), text("POSITIVE (high)", 4)]) == [1]
    assert hit(persistent(), [text("Detected", 1), text("Not detected", 2), text("Detected", 3)]) == []
    assert hit(persistent(), [text("Detected", 1), text("Presumptive positive", 3)]) == []


def test_value_gates(hit):
    spec = IndicatorSpec("M", "MEAS_ANY_RECORDED", ids(1), any_value=True)
    assert hit(spec, [dict(concept_id=1, day=1)]) == []
    assert hit(spec, [dict(concept_id=1, day=1, value_concept_id=5)]) == [1]
    numeric = IndicatorSpec("M", "MEAS_ANY_RECORDED", ids(1), any_value=True, numeric=True)
    assert hit(numeric, [dict(concept_id=1, day=1, value_concept_id=5)]) == []
    threshold = IndicatorSpec("M", "MEAS_NUMERIC_THRESHOLD", ids(1), threshold=5.0)
    assert hit(threshold, [dict(concept_id=1, day=1, value=5.0)]) == [1]
    assert hit(threshold, [dict(concept_id=1, day=1, value=4.9)]) == []


def test_value_without_reference_range_is_elevated(hit):
    spec = IndicatorSpec("M", "MEAS_ELEV_EPISODES_GAP", ids(1), gap=30, min_n=2)
    assert hit(spec, [dict(concept_id=1, day=d, value=5.0) for d in (0, 40)]) == [1]
    assert hit(spec, [dict(concept_id=1, day=d, value=5.0, range_high=9.0) for d in (0, 40)]) == []
    # short windows carry no elevated-episode indicator
    assert hit(spec, [dict(concept_id=1, day=d, value=5.0) for d in (0, 40)], window=(0, 50)) == []


def test_paired_needs_both_on_one_day_and_left_above_zero(hit):
    spec = IndicatorSpec("N", "MEAS_PAIRED_SAME_DATE_NUMERIC", left=ids(1), right=ids(2))
    assert hit(spec, [dict(concept_id=1, day=1, value=1.0), dict(concept_id=2, day=1, value=0.0)]) == [1]
    assert hit(spec, [dict(concept_id=1, day=1, value=1.0), dict(concept_id=2, day=2, value=1.0)]) == []
    assert hit(spec, [dict(concept_id=1, day=1, value=0.0), dict(concept_id=2, day=1, value=1.0)]) == []


def test_repeat_counts_rows_and_honours_the_value_list(hit):
    spec = IndicatorSpec("R", "MEAS_REPEAT_AT_LEAST_N", ids(1), values=(POS,), min_n=2)
    assert hit(spec, [result(POS, 1), result(POS, 1)]) == [1]
    assert hit(spec, [result(POS, 1), result(NEG, 2)]) == []


def steroid(kind, **kw):
    return IndicatorSpec("D", kind, (ConceptSpec(ingredients=("steroid",)),), **kw)


def test_one_drug_row_matching_concept_and_text_counts_twice_for_repeats_only(hit):
    row = [dict(concept_id=21, day=1, source_text="steroid 5")]
    assert hit(steroid("DRUG_REPEAT_AT_LEAST_N", min_n=2, text=("%steroid%",)), row, domain="drug") == [1]
    assert hit(steroid("DRUG_REPEAT_AT_LEAST_N", min_n=2), row, domain="drug") == []
    assert hit(steroid("DRUG_INGREDIENT_DESC", text=("%steroid%",)), row, domain="drug") == [1]
    assert hit(steroid("DRUG_INGREDIENT_DESC"), [dict(concept_id=99, day=1, source_text="steroid")], domain="drug") == []


def test_name_patterns_ignore_source_text_and_other_domains(hit):
    spec = IndicatorSpec("C", "COND_NAME_PATTERN", (ConceptSpec(names=("%LEFT%",), domain="Condition"),), text=("%x%",))
    assert hit(spec, [dict(concept_id=11, day=1)], domain="condition") == [1]
    assert hit(spec, [dict(concept_id=10, day=1, source_text="x")], domain="condition") == []


def test_observation_value_may_be_text(hit):
    spec = IndicatorSpec("O", "OBS_ANY_RECORDED", ids(1), any_value=True)
    assert hit(spec, [dict(concept_id=1, day=1, value_text="yes")], domain="observation") == [1]


def test_no_concepts_and_no_text_means_every_row(hit):
    assert hit(IndicatorSpec("M", "MEAS_NUMERIC_ANY"), [dict(concept_id=77, day=1, value=1.0)]) == [1]
    empty = IndicatorSpec("M", "MEAS_NUMERIC_ANY", (ConceptSpec(codes=("9-9",)),))
    assert hit(empty, [dict(concept_id=77, day=1, value=1.0)]) == []


def test_windows_include_both_ends_and_nest(make_events, cohort, vocabulary):
    spec = IndicatorSpec("M", "MEAS_ANY_RECORDED", ids(1))
    events = make_events([dict(concept_id=1, day=0), dict(concept_id=1, day=21, person_id=2), dict(concept_id=1, day=22, person_id=2)])
    found = {(r.person_id, r.window) for r in indicator_hits(events, cohort, [(0, 21), (0, 90), (22, 30)], [spec], vocabulary).collect()}
    assert found == {(1, "w0_21"), (1, "w0_90"), (2, "w0_21"), (2, "w0_90"), (2, "w22_30")}


def test_signals_have_every_person_and_constant_columns(make_events, cohort, vocabulary):
    specs = [IndicatorSpec("A", "MEAS_ANY_RECORDED", ids(1), group="viral"), IndicatorSpec("Z", "MEAS_ANY_RECORDED", constant_zero=True, group="viral")]
    hits = indicator_hits(make_events([dict(concept_id=1, day=3)]), cohort, [(0, 5)], specs, vocabulary)
    rows = {r.person_id: r for r in build_signals(hits, cohort, [(0, 5)], specs).collect()}
    assert rows[1].f_ind_viral_a == 1 and rows[2].f_ind_viral_a == 0 and rows[1].f_ind_viral_z == 0


def test_partition_count_does_not_matter(make_events, cohort, vocabulary):
    spec = persistent()
    rows = [result(POS if i % 3 else NEG, i % 40) for i in range(200)]
    events = make_events(rows)
    outs = [sorted(map(tuple, indicator_hits(events.repartition(n), cohort, [(0, 90), (10, 30)], [spec], vocabulary).collect())) for n in (1, 16)]
    assert outs[0] == outs[1]


def test_catalogue():
    groups = catalogue.grouped()
    sizes = {m: sum(len(v) for g, v in groups.items() if g.endswith(m)) for m in ("viral", "immuno", "endo", "exploratory")}
    assert sizes == {"viral": 24, "immuno": 32, "endo": 14, "exploratory": 4}
    active = catalogue.active()
    assert len(active) == 74 and len({s.name for s in active}) == 74
    assert all(s.kind in KINDS for s in (*active, *catalogue.OPTIONAL))
    assert not {s.name for s in catalogue.OPTIONAL} & {s.name for s in active}
    assert feature_name(active[0], "w0_90") == "f_ind_viral_w0_90_repeated_pos_sars_cov2_test"


def test_whole_catalogue_runs_in_one_plan(make_events, cohort, vocabulary):
    rows = [dict(concept_id=37311061, day=d, domain="condition") for d in (0, 31)]
    rows += [dict(concept_id=706169, day=d, value_concept_id=45884084) for d in (1, 25)]
    hits = indicator_hits(make_events(rows), cohort, [(0, 90)], catalogue.active(), vocabulary)
    names = {r.indicator for r in hits.collect()}
    assert names == {
        "REPEATED_COVID_DX", "REPEATED_POS_SARS_COV2_TEST", "PERSISTENT_POS_SARS_COV2_STRICT", "PERSISTENT_POS_SARS_COV2_14D",
        "PERSISTENT_POS_SARS_COV2_ANY",
    }


def test_incomplete_specs_are_refused():
    with pytest.raises(ValueError):
        IndicatorSpec("X", "MEAS_NUMERIC_THRESHOLD", ids(1))
    with pytest.raises(ValueError):
        IndicatorSpec("X", "COND_EPISODES_GAP", ids(1), gap=0, min_n=2)
    with pytest.raises(ValueError):
        ConceptSpec()
