"""The baseline feature matrix as one plan over the blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blocks as B
from ..operators.assemble import join_blocks, to_numeric
from ..operators.concepts import ConceptSpec, Vocabulary, resolve_all
from . import codesets as S

NUMERIC_PREFIXES = ("f_age", "f_ext_bmi", "f_ext_sbp", "f_ext_dbp", "f_ext_spo2_min")


@dataclass(frozen=True)
class FeatureInputs:
    conditions: DataFrame
    measurements: DataFrame
    observations: DataFrame
    procedures: DataFrame
    drugs: DataFrame
    visits: DataFrame
    providers: DataFrame
    sites: DataFrame
    plans: DataFrame
    vocabulary: Vocabulary
    mapping: DataFrame | None = None


def _under(vocabulary: Vocabulary, ids: Sequence[int]) -> DataFrame:
    return resolve_all(vocabulary, {"s": [ConceptSpec(ancestors=tuple(ids))]})


def core_blocks(inputs: FeatureInputs, cohort: DataFrame, strict: bool = False, treatment: bool = True) -> dict[str, DataFrame]:
    """Comorbidities, symptoms, drugs, demographics and treatment.

    Symptoms go through the ontology map if there is one.  ``strict`` leaves out
    the five additional symptoms.
    """
    x, v = inputs, inputs.vocabulary
    pairs = B.drug_ingredients(x.drugs, cohort, v)
    if x.mapping is not None:
        terms = S.SYMPTOM_TERMS if strict else {**S.SYMPTOM_TERMS, **S.EXTRA_SYMPTOM_TERMS}
        symptoms = B.ontology_flags(x.conditions, cohort, x.mapping, terms)
    else:
        symptoms = B.window_ancestor_flags(x.conditions, cohort, v, S.SYMPTOMS, S.EXTRA_SYMPTOMS if strict else ())
    out = {
        "core_comorbidities": B.ancestor_flags(x.conditions, cohort, v, S.COMORBIDITIES, S.DIABETES),
        "core_symptoms": symptoms,
        "core_drugs": B.ingredient_flags(pairs, cohort)
        .join(B.class_composite(pairs, cohort, S.STEROID_NAMES, "f_drug_corticosteroid_any"), "person_id")
        .join(
            B.regimen_flag(
                x.drugs, cohort, x.visits,
                resolve_all(v, {"f_drug_regimen_corticosteroids": [ConceptSpec(ancestors=S.STEROID_ANCESTORS)]}),
                (9201, 262), "f_drug_regimen_corticosteroids",
            ),
            "person_id",
        ),
        "core_demographics": B.one_hot_demographics(cohort),
    }
    if treatment:
        sets = {
            "imv": _under(v, S.VENTILATION_ANCESTORS), "ecmo": _under(v, S.ECMO_ANCESTORS),
            "remdesivir": _under(v, S.REMDESIVIR_ANCESTORS),
        }
        measures = B.treatment_measures(cohort, x.procedures, x.observations, x.drugs, sets, S.VENTILATION_MODE)
        levels = B.severity_one_hot(cohort, x.procedures, x.observations, x.visits, sets["imv"], S.VENTILATION_MODE, (9203, 262))
        out["core_treatment"] = measures.join(levels, "person_id")
    return out


def extended_blocks(inputs: FeatureInputs, cohort: DataFrame, tested_flag: bool = False) -> dict[str, DataFrame]:
    """Vitals, lifestyle, acute severity, calendar, vaccination, further symptoms, infections and serology."""
    x, v = inputs, inputs.vocabulary
    tests = x.measurements.join(
        v.concept.where(v.concept.concept_code.isin(*S.ANTIBODY_CODES)).select("concept_id").distinct(), "concept_id", "left_semi"
    )
    n_codes = v.concept.where(v.concept.concept_code.isin(*S.N_CODES)).selectExpr("concept_id", "'N' AS ab_type")
    s_codes = v.concept.where(v.concept.concept_code.isin(*S.S_CODES)).selectExpr("concept_id", "'S' AS ab_type")
    kinds = n_codes.unionByName(s_codes)
    seen = B.serology_interpretation(tests, cohort, S.ANTIBODY_POSITIVE, S.ANTIBODY_NEGATIVE, S.BANDS)
    return {
        "vitals": B.last_value_before(x.measurements, cohort, S.VITALS),
        "lifestyle": B.history_text_flags(x.observations, cohort, S.LIFESTYLE),
        "acute": B.acute_severity(
            cohort, x.visits, x.observations, x.measurements, x.sites, (9201, 262), (S.ICU_OBSERVATION,), (S.ICU_MEASUREMENT,),
            (S.SPO2,), (S.VENTILATION_MODE,), icu_site_text=S.ICU_SITE_TEXT,
        ),
        "calendar": B.calendar_bands(cohort, S.BANDS),
        "vaccination": B.dose_history(x.drugs, cohort, S.VACCINE_IDS, S.VACCINE_TEXT, S.VACCINE_TYPES),
        "symptoms": B.window_ancestor_flags(x.conditions, cohort, v, S.FURTHER_SYMPTOMS),
        "infections": B.ancestor_flags(x.conditions, cohort, v, S.CHRONIC_INFECTIONS),
        "serology": seen,
        "titers": B.titer_features(tests, cohort),
        "contrast": B.antibody_contrast(x.measurements, cohort, kinds, seen, tested_flag),
    }


def engagement_block(inputs: FeatureInputs, cohort: DataFrame) -> DataFrame:
    return B.engagement_controls(cohort, inputs.visits, inputs.providers, inputs.plans, S.PRIMARY_CARE, S.PAYERS)


def assemble_baseline(cohort: DataFrame, groups: Mapping[str, Sequence[DataFrame]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """One row per person from the blocks of every family, and the family -> columns map.

    Flags and counts are filled with 0; measured numbers stay null.
    """
    families = {f: [c for b in blocks for c in b.columns if c != "person_id"] for f, blocks in groups.items()}
    blocks = [b for many in groups.values() for b in many]
    columns = [c for cols in families.values() for c in cols]
    matrix = join_blocks(cohort, blocks, [c for c in columns if not c.startswith(NUMERIC_PREFIXES)])
    texts = {f.name for f in matrix.schema.fields if isinstance(f.dataType, T.StringType)}
    return matrix.select("person_id", *[to_numeric(f"`{c}`").alias(c) if c in texts else F.col(f"`{c}`") for c in columns]), families


def baseline_matrix(
    inputs: FeatureInputs, cohort: DataFrame, strict: bool = False, treatment: bool = True, extended: bool = True,
    engagement: bool = True, tested_flag: bool = False,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """The whole baseline: core families, then the extended and engagement families on request."""
    groups: dict[str, list[DataFrame]] = {f: [b] for f, b in core_blocks(inputs, cohort, strict, treatment).items()}
    if extended and not strict:
        groups["ext_features"] = list(extended_blocks(inputs, cohort, tested_flag).values())
    if engagement and not strict:
        groups["engagement_controls"] = [engagement_block(inputs, cohort)]
    return assemble_baseline(cohort, groups)
