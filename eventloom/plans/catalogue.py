"""The indicator catalogue and code sets: fixed values, one row per indicator.

Rows are data for the operators; nothing in the engine depends on them.  Pass
other rows to work with another catalogue.
"""

from __future__ import annotations

from dataclasses import replace

from ..operators.concepts import ConceptSpec
from ..operators.indicators import IndicatorSpec


def _row(name, kind, *, ids=(), codes=(), anc=(), names=(), domain=None, drugs=(), left=(), right=(), label="", **rest):
    concepts = []
    if codes:
        concepts.append(ConceptSpec(codes=codes))
    if ids:
        concepts.append(ConceptSpec(ids=ids))
    if anc:
        concepts.append(ConceptSpec(ancestors=anc))
    if names:
        concepts.append(ConceptSpec(names=names, domain=domain))
    if drugs:
        concepts.append(ConceptSpec(ingredients=drugs))
    return IndicatorSpec(
        name,
        kind,
        tuple(concepts),
        left=(ConceptSpec(codes=left),) if left else (),
        right=(ConceptSpec(codes=right),) if right else (),
        label=label,
        **rest,
    )


def _meas(name, **rest):
    return _row(name, "MEAS_ANY_RECORDED", **rest)


def _dx(name, **rest):
    return _row(name, "COND_ANY_RECORDED", **rest)


def _dx_name(name, *patterns, **rest):
    return _row(name, "COND_NAME_PATTERN", names=patterns, domain="Condition", **rest)


def _rx(name, **rest):
    return _row(name, "DRUG_INGREDIENT_DESC", **rest)


# Result codes.
POSITIVE_RESULTS = (45884084, 45877985, 36715206)
CONFIRMED_POSITIVE = (45884084, 45877985)
NEGATIVE_RESULTS = (45880296, 45878583, 1261264)

# Virus test concepts, diagnoses and visit types of the cohort.
VIRUS_TESTS = (706169, 586526, 706170, 706163, 723476)
INDEX_CONDITION = (37311061,)
OUTCOME_CONDITIONS = (600588, 600589)
INPATIENT_VISITS = (9201, 262)
EMERGENCY_VISITS = (9203, 262)

_PERSISTENT = dict(ids=VIRUS_TESTS, positive=CONFIRMED_POSITIVE, negative=NEGATIVE_RESULTS)
_ANTIVIRALS = (37499271, 702530, 1748921, 21603127)
_ANTICOAGULANTS = (
    "HEPARIN", "WARFARIN", "APIXABAN", "RIVAROXABAN", "DABIGATRAN ETEXILATE", "EDOXABAN", "ENOXAPARIN",
    "DALTEPARIN", "FONDAPARINUX",
)

# Viral indicators.
VIRAL = (
    _row("REPEATED_POS_SARS_COV2_TEST", "MEAS_REPEAT_AT_LEAST_N", ids=VIRUS_TESTS, values=CONFIRMED_POSITIVE, min_n=2),
    _row("PERSISTENT_POS_SARS_COV2_STRICT", "MEAS_PERSISTENT_POSITIVITY", min_day=21, anchored=True, **_PERSISTENT),
    _row("PERSISTENT_POS_SARS_COV2_14D", "MEAS_PERSISTENT_POSITIVITY", min_day=14, anchored=True, **_PERSISTENT),
    _row("PERSISTENT_POS_SARS_COV2_ANY", "MEAS_PERSISTENT_POSITIVITY", **_PERSISTENT),
    _row("REPEATED_COVID_DX", "COND_EPISODES_GAP", ids=INDEX_CONDITION, gap=30, min_n=2),
    _meas(
        "EBV_PCR_ANY_VALUE", codes=("32585-2", "43730-1", "47982-4", "100677-4", "100678-2"),
        ids=(3014258, 3050637, 3037329, 3043849), text=("%ebv%", "%epstein%barr%"), any_value=True,
    ),
    _meas("CMV_PCR_ANY_VALUE", anc=(37172169,), any_value=True),
    _dx("CMV_DX", ids=(440032,)),
    _meas(
        "HHV6_PCR_ANY_VALUE", ids=(3031625, 3049401, 3052811, 1761324, 3029493, 3965815),
        text=("%hhv%6%", "%hhv-6%", "%human herpesvirus 6%"), any_value=True,
    ),
    _row("REMDESIVIR", "DRUG_ANY_RECORDED", anc=(37499271,)),
    _row("NIRMATRELVIR", "DRUG_ANY_RECORDED", anc=(702530,)),
    _row("RITONAVIR", "DRUG_ANY_RECORDED", anc=(1748921,)),
    _row("OTHER_COVID_DAAS", "DRUG_ANY_RECORDED", anc=(21603127,)),
    _row("ANY_COVID_ANTIVIRAL", "DRUG_ANY_RECORDED", anc=_ANTIVIRALS),
    _row(
        "REPEATED_COVID_ANTIVIRAL", "DRUG_EPISODES_GAP", drugs=("REMDESIVIR", "NIRMATRELVIR", "RITONAVIR", "MOLNUPIRAVIR"),
        gap=14, min_n=2,
    ),
)

VIRAL_PLUS = (
    _meas("EBV_PCR_ANY", codes=("32585-2",), any_value=True),
    _meas(
        "EBV_EARLY_ANTIGEN", codes=("24007-2", "30339-6"), text=("%ebv%early antigen%", "%ebv%ea%igg%", "%ebv%ea-d%"),
        any_value=True,
    ),
    _meas("EBV_VCA_IGM", codes=("7885-7",), text=("%ebv%vca%igm%", "%ebv%capsid%igm%"), any_value=True),
    _meas("CMV_PCR_ANY", anc=(37172169,), any_value=True),
    _dx("GI_DX_ANY", anc=(196523, 200219, 27674)),
    _dx("RESP_DX_ANY", anc=(254761, 312437)),
    _meas(
        "SARS_COV2_NUCLEOCAPSID_IGG", ids=(1988397,),
        text=("%nucleocapsid%igg%", "%sars%cov%nucleocapsid%", "%covid%nucleocapsid%"), any_value=True,
    ),
    _meas(
        "SARS_COV2_SPIKE_IGG", ids=(1988202, 4132298, 4196936, 4211116),
        text=("%spike%igg%", "%sars%cov%igg%", "%covid%igg%", "%sars%igg%"), any_value=True,
    ),
    _meas(
        "SARS_COV2_IGM", names=("%SARS%COV%2%IGM%",), domain="Measurement", text=("%sars%cov%igm%", "%covid%igm%"),
        any_value=True,
    ),
)

# Immune and inflammatory indicators.
IMMUNO = (
    _row(
        "ANY_IL6", "MEAS_OR_OBS_ANY", codes=("26881-3",), ids=(4332015, 42529420), observation_ids=(4150054,), any_value=True
    ),
    _row(
        "ANY_TNFA", "MEAS_OR_OBS_ANY", names=("%TNF%ALPHA%", "%TUMOR NECROSIS FACTOR%"), domain="Measurement",
        ids=(4225604,), observation_ids=(4216487,), any_value=True,
    ),
    _meas("ANY_IL12", anc=(3034621,), any_value=True),
    _meas("ANY_LYMPH_ABS", codes=("731-0",), ids=(37208689,), anc=(4254663,), any_value=True),
    _meas("ANY_NEUT_ABS", codes=("751-8",), ids=(4148615,), any_value=True),
    _row("NLR_COMPUTABLE", "MEAS_PAIRED_SAME_DATE_NUMERIC", left=("731-0", "26474-7"), right=("751-8", "26499-4")),
    _row("PERSISTENT_CRP", "MEAS_ELEV_EPISODES_GAP", codes=("1988-5", "30522-7"), ids=(4208414,), gap=30, min_n=2),
    _rx(
        "IMMUNOMOD_DRUGS",
        drugs=(
            "prednisone", "prednisolone", "methylprednisolone", "dexamethasone", "hydrocortisone", "methotrexate",
            "azathioprine", "mycophenolate mofetil", "leflunomide", "sulfasalazine", "hydroxychloroquine", "adalimumab",
            "infliximab", "etanercept", "rituximab", "tocilizumab", "abatacept", "ustekinumab", "tofacitinib",
            "baricitinib", "upadacitinib",
        ),
        text=(
            "%prednisone%", "%dexamethasone%", "%methylprednisolone%", "%methotrexate%", "%hydroxychloroquine%",
            "%rituximab%", "%tocilizumab%",
        ),
    ),
    _row("NEUTROPHIL_ANTIBODY_OBS", "OBS_ANY_RECORDED", ids=(35624339,), any_value=True),
    _dx("PNEUMONIA_DX", ids=(255848,)),
    _dx("LYME_DISEASE_DX", ids=(440638,)),
    _dx("OPPORTUNISTIC_INFECTION", anc=(433701, 4140111, 432584, 440704)),
    _dx("INFLUENZA_A_DX", ids=(40483537,)),
    _dx("INFLUENZA_B_DX", ids=(4266367,)),
    _dx("RSV_DX", ids=(437222,)),
    _dx("HEPATITIS_E_DX", ids=(45769824,)),
    _row("RECURRENT_RESPIRATORY_INFECTION", "COND_EPISODES_GAP", anc=(4103703, 255848, 260139, 258780), gap=30, min_n=2),
)

RHEUMATIC = (
    80809, 257628, 134442, 80182, 80800, 254443, 255348, 313219, 4101602, 436642, 314963, 4290976, 314381, 42535714, 196431,
)

IMMUNO_PLUS = (
    _meas("COMPLEMENT_C3_ORDERED", codes=("4485-9",), text=("%complement c3%", "%complement 3%"), any_value=True),
    _meas("COMPLEMENT_C4_ORDERED", codes=("4498-2",), text=("%complement c4%", "%complement 4%"), any_value=True),
    _meas(
        "COMPLEMENT_CH50_ORDERED", codes=("4532-8",),
        names=("%COMPLEMENT%CH50%", "%COMPLEMENT%AH50%", "%COMPLEMENT%TOTAL%HEMOLYTIC%"), domain="Measurement",
        text=("%ch50%", "%total complement%", "%total hemolytic%"), any_value=True,
    ),
    _meas("ANA_ORDERED", codes=("8061-4",), text=("%antinuclear%antibod%", "%ana %screen%", "%ana %titer%"), any_value=True),
    _meas("RF_ORDERED", codes=("11572-5",), text=("%rheumatoid factor%",), any_value=True),
    _meas(
        "ANTI_CCP_ORDERED", codes=("53027-9",), names=("%ANTI%CCP%", "%CYCLIC CITRULLINATED PEPTIDE%"), domain="Measurement",
        text=("%anti%ccp%", "%cyclic citrullinated%"), any_value=True,
    ),
    _meas(
        "ANTIPHOSPHOLIPID_ORDERED",
        names=(
            "%ANTIPHOSPHOLIPID%", "%ANTICARDIOLIPIN%", "%BETA-2 GLYCOPROTEIN%", "%B2 GLYCOPROTEIN%", "%LUPUS ANTICOAGULANT%",
        ),
        domain="Measurement",
        text=("%antiphospholipid%", "%anticardiolipin%", "%lupus anticoag%", "%beta-2 glycoprotein%"), any_value=True,
    ),
    _dx("NEW_RHEUM_DX", anc=RHEUMATIC),
    _rx(
        "JAK_INHIBITOR", drugs=("tofacitinib", "baricitinib", "ruxolitinib", "upadacitinib"),
        text=("%tofacitinib%", "%xeljanz%", "%baricitinib%", "%olumiant%", "%ruxolitinib%"),
    ),
    _rx(
        "DMARD_INITIATION",
        drugs=("methotrexate", "hydroxychloroquine", "sulfasalazine", "leflunomide", "azathioprine", "mycophenolate"),
        text=("%methotrexate%", "%hydroxychloroquine%", "%plaquenil%", "%sulfasalazine%", "%leflunomide%"),
    ),
    _rx(
        "IVIG_EXPOSURE", drugs=("immune globulin",),
        text=("%ivig%", "%gamunex%", "%gammagard%", "%privigen%", "%octagam%", "%immune globulin%intravenous%"),
    ),
    _meas(
        "ANY_IL1B", codes=("47032-8",), names=("%INTERLEUKIN%1%BETA%",), domain="Measurement",
        text=("%il-1%beta%", "%il1b%", "%interleukin 1b%"), any_value=True,
    ),
    _meas("CD4_COUNT", codes=("24467-3",), ids=(37396514,), text=("%cd4%count%", "%cd4%abs%", "%t-helper%"), any_value=True),
    _meas("DSDNA_ANTIBODY", codes=("5130-0",), text=("%dsdna%", "%double stranded dna%", "%anti-dna%"), any_value=True),
    _meas(
        "THYROID_AUTOANTIBODY", codes=("5382-7", "8098-6"),
        text=("%thyroid peroxidase%ab%", "%anti%tpo%", "%thyroglobulin%ab%"), any_value=True,
    ),
)

# Endothelial and thrombotic indicators.
ENDO = (
    _rx(
        "ANTICOAG_THERAPY", drugs=_ANTICOAGULANTS,
        text=(
            "%heparin%", "%warfarin%", "%apixaban%", "%eliquis%", "%rivaroxaban%", "%xarelto%", "%enoxaparin%", "%lovenox%",
        ),
    ),
    _row(
        "APHERESIS", "PROC_NAME_PATTERN", names=("%PLASMAPHERESIS%", "%THERAPEUTIC PLASMA EXCHANGE%", "%PLASMA EXCHANGE%"),
        domain="Procedure", text=("%apheresis%", "%plasmapheresis%", "%plasma exchange%"),
    ),
    _row("REPEATED_DDIMER_TESTING", "MEAS_REPEAT_AT_LEAST_N", codes=("48065-7",), min_n=2),
    _row("REPEATED_ANTICOAG_EXPOSURE", "DRUG_REPEAT_AT_LEAST_N", drugs=_ANTICOAGULANTS, min_n=2),
)

ENDO_PLUS = (
    _meas("VWF_ORDERED", codes=("6014-5", "27816-8"), text=("%von willebrand%", "%vwf%"), any_value=True),
    _meas("FACTOR_VIII_ORDERED", codes=("3209-4",), text=("%factor viii%", "%factor 8%activity%"), any_value=True),
    _dx_name("DVT_PE", "%DEEP VEIN THROMBOSIS%", "%PULMONARY EMBOLISM%", "%PULMONARY THROMBOEMBOLISM%"),
    _dx("ARTERIAL_THROMBOSIS", anc=(312327, 4310996)),
    _dx("MYOCARDITIS_PERICARDITIS", anc=(314383, 320116), text=("%myocardit%", "%pericardit%")),
    _dx("AKI_DIAGNOSIS", anc=(197320,)),
    _dx_name("PROTEINURIA_DX", "%PROTEINURIA%", "%ALBUMINURIA%"),
    _dx_name(
        "POTS_ORTHOSTATIC", "%POSTURAL ORTHOSTATIC TACHYCARDIA%", "%ORTHOSTATIC HYPOTENSION%", "%ORTHOSTATIC INTOLERANCE%",
        text=("%pots%", "%orthostatic%", "%dysautonomia%", "%postural tachycardia%"),
    ),
    _rx(
        "ANTIPLATELET_THERAPY", drugs=("clopidogrel", "prasugrel", "ticagrelor", "dipyridamole"),
        text=("%clopidogrel%", "%plavix%", "%ticagrelor%", "%brilinta%"),
    ),
    _dx(
        "ARRHYTHMIA_DX", anc=(313217, 314665, 316999, 4068155, 4103295), text=("%arrhythm%", "%atrial fib%", "%atrial flutter%")
    ),
)

# Exploratory indicators.
EXPLORATORY = (
    _meas("TRYPTASE_ORDERED", ids=(4007807,), text=("%tryptase%",)),
    _rx(
        "H1_H2_BLOCKER",
        drugs=(
            "cetirizine", "loratadine", "fexofenadine", "diphenhydramine", "hydroxyzine", "famotidine", "ranitidine",
        ),
        text=(
            "%cetirizine%", "%zyrtec%", "%loratadine%", "%claritin%", "%fexofenadine%", "%allegra%", "%diphenhydramine%",
            "%benadryl%", "%famotidine%", "%pepcid%",
        ),
    ),
    _rx("LEUKOTRIENE_ANTAGONIST", drugs=("montelukast", "zafirlukast"), text=("%montelukast%", "%singulair%", "%zafirlukast%")),
    _dx_name("URTICARIA_DX", "%URTICARIA%", "%FLUSHING%", "%ANGIOEDEMA%"),
)

# Optional indicators, not part of the active set.
OPTIONAL = (
    _meas("ANY_SARS_COV2_TEST", ids=VIRUS_TESTS),
    _meas("ANY_POS_SARS_COV2_TEST", ids=VIRUS_TESTS, values=POSITIVE_RESULTS),
    _meas(
        "EBV_ANTIBODY", ids=(3007844, 3029892),
        text=("%ebv%antibod%", "%ebv%igg%", "%ebv%igm%", "%epstein%barr%antibod%"), any_value=True,
    ),
    _dx("HEPATITIS_B_DX", ids=(4281232,)),
    _dx("HEPATITIS_C_DX", ids=(197494,)),
    _row("BRONCHOSCOPY", "PROC_ANY_RECORDED", anc=(4032404,)),
    _row("GI_BIOPSY", "PROC_ANY_RECORDED", anc=(4002733,)),
    _row("LIVER_BIOPSY", "PROC_ANY_RECORDED", anc=(4314001,)),
    _meas(
        "SARS_COV2_ANTIBODY", ids=(3033147, 40763481, 4206313, 4132298, 3031372, 4196936, 4211116),
        text=("%covid%antibod%", "%sars%antibod%", "%sars%igg%", "%nucleocapsid%antibod%"), any_value=True,
    ),
    _row("ELEV_FERRITIN", "MEAS_ELEVATED_OR_ANY", codes=("2276-4",), ids=(4176561,)),
    _row("ANY_IL6_OBS", "OBS_ANY_RECORDED", ids=(4150054,), any_value=True),
    _row("ANY_TNFA_OBS", "OBS_ANY_RECORDED", ids=(4216487,), any_value=True),
    _dx("IMMUNE_RELATED_DX", anc=(4098244, 443454, 433590)),
    _row("SPECIALIST_VISITS", "VISIT_SPECIALTY_NAME", specialties=("%rheumatolog%", "%immunolog%")),
    _row("RHEUMATOLOGY_VISIT", "VISIT_SPECIALTY_NAME", specialties=("%rheumatol%",)),
    _row("IMMUNOLOGY_VISIT", "VISIT_SPECIALTY_NAME", specialties=("%immunol%", "%allerg%")),
    _dx_name(
        "MICROVASCULAR_INJURY", "%THROMBOPHLEBITIS%", "%MICROVASCULAR%", "%SMALL VESSEL%", "%ISCHEMIC%", "%ACRAL ISCHEM%"
    ),
    _row(
        "PLATELETS_ANY", "MEAS_NUMERIC_ANY", codes=("777-3", "26515-7"), ids=(4267147,), text=("%platelet%count%", "%plt%")
    ),
    _row(
        "VASCULAR_IMAGING", "PROC_NAME_PATTERN",
        names=("%ECHOCARDIOGRA%", "%CT PULMONARY ANGIO%", "%VASCULAR ULTRASOUND%", "%DOPPLER%VENOUS%"), domain="Procedure",
    ),
    _meas("PT_INR_ORDERED", codes=("34714-6", "5902-2", "6301-6"), text=("%inr%", "%prothrombin time%")),
    _meas("APTT_ORDERED", codes=("3173-2",), text=("%aptt%", "%activated partial thromboplastin%")),
    _row(
        "CARDIAC_IMAGING_ORDERED", "PROC_NAME_PATTERN",
        names=("%ECHOCARDIOGRA%", "%CARDIAC MRI%", "%CARDIAC MAGNETIC%", "%CT CORONARY%", "%MYOCARDIAL PERFUSION%"),
        domain="Procedure",
    ),
)


def grouped() -> dict[str, tuple[IndicatorSpec, ...]]:
    """Active indicators by group; the group becomes part of the column name."""
    groups = {
        "viral": VIRAL, "enh_viral": VIRAL_PLUS, "immuno": IMMUNO, "enh_immuno": IMMUNO_PLUS, "endo": ENDO,
        "enh_endo": ENDO_PLUS, "enh_exploratory": EXPLORATORY,
    }
    return {g: tuple(replace(s, group=g) for s in specs) for g, specs in groups.items()}


def active() -> list[IndicatorSpec]:
    return [s for specs in grouped().values() for s in specs]
