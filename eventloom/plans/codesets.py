"""Code sets, limits and column groups of the feature blocks: fixed values, stated as data."""

from __future__ import annotations

from ..operators.concepts import ConceptSpec
from .catalogue import RHEUMATIC

# Feature windows (days from index).
WINDOWS = ((0, 21), (0, 30), (0, 60), (0, 90), (30, 60), (60, 90))

# Comorbidity ancestors.
COMORBIDITIES = {
    "f_comor_mi": (4329847,), "f_comor_chf": (316139,), "f_comor_pvd": (321052,), "f_comor_cerebrovascular": (381591,),
    "f_comor_dementia": (4182210,), "f_comor_chronic_pulm": (4063381,), "f_comor_rheumatic": RHEUMATIC,
    "f_comor_peptic_ulcer": (4247120,), "f_comor_liver_mild": (4212540,), "f_comor_diabetes_complicated": (443767,),
    "f_comor_hemiplegia": (374022,), "f_comor_renal": (198124,), "f_comor_cancer": (443392,), "f_comor_hiv": (439727,),
    "f_comor_cardiovascular": (134057,), "f_comor_cad": (4185932,), "f_comor_obesity": (433736,),
    "f_comor_depression": (440383,), "f_comor_anxiety": (442077,), "f_comor_autoimmune": (434621,),
    "f_comor_hypertension": (316866,),
}
DIABETES = ("f_comor_diabetes_uncomplicated", (201820,), (443767,))

# Acute symptom ancestors; the last five are left out in strict mode.
SYMPTOMS = {
    "f_sym_fever": (437663,), "f_sym_cough": (254761,), "f_sym_fatigue": (4223659,), "f_sym_dyspnea": (312437,),
    "f_sym_myalgia": (442752,), "f_sym_headache": (378253,), "f_sym_anosmia": (4185711,), "f_sym_ageusia": (4289517,),
    "f_sym_diarrhea": (196523,), "f_sym_nausea": (31967,), "f_sym_sore_throat": (4147326,), "f_sym_chest_pain": (77670,),
    "f_sym_arthralgia": (77074,), "f_sym_vomiting": (441408,), "f_sym_abdominal_pain": (200219,),
    "f_sym_dizziness": (4223938,), "f_sym_malaise": (4272240,), "f_sym_rhinorrhea": (4276172,),
    "f_sym_congestion": (4195085,),
}
EXTRA_SYMPTOMS = ("f_sym_abdominal_pain", "f_sym_dizziness", "f_sym_malaise", "f_sym_rhinorrhea", "f_sym_congestion")

# The same symptoms as ontology terms.
SYMPTOM_TERMS = {
    "f_sym_hpo_fever": "HP:0001945", "f_sym_hpo_cough": "HP:0012735", "f_sym_hpo_fatigue": "HP:0012378",
    "f_sym_hpo_dyspnea": "HP:0002094", "f_sym_hpo_myalgia": "HP:0003326", "f_sym_hpo_headache": "HP:0002315",
    "f_sym_hpo_anosmia": "HP:0000458", "f_sym_hpo_ageusia": "HP:0000224", "f_sym_hpo_diarrhea": "HP:0002014",
    "f_sym_hpo_nausea": "HP:0002018", "f_sym_hpo_sore_throat": "HP:0033050", "f_sym_hpo_chest_pain": "HP:0100749",
    "f_sym_hpo_arthralgia": "HP:0002829", "f_sym_hpo_vomiting": "HP:0002013",
}
EXTRA_SYMPTOM_TERMS = {
    "f_sym_hpo_abdominal_pain": "HP:0002027", "f_sym_hpo_dizziness": "HP:0002321", "f_sym_hpo_malaise": "HP:0033834",
    "f_sym_hpo_rhinorrhea": "HP:0031417", "f_sym_hpo_congestion": "HP:0001742",
}

# Further symptom and chronic infection ancestors.
FURTHER_SYMPTOMS = {
    "f_ext_sym_palpitations": (315078, 77670), "f_ext_sym_neurocog": (46271045, 4107230, 443432),
    "f_ext_sym_insomnia": (436962, 435524), "f_ext_sym_tachycardia": (444070,),
}
CHRONIC_INFECTIONS = {"f_ext_hepatitis_b": (4281232,), "f_ext_hepatitis_c": (197494,)}

# Steroids and treatments.
STEROID_NAMES = (
    "prednisone", "dexamethasone", "methylprednisolone", "hydrocortisone", "prednisolone", "betamethasone", "triamcinolone",
)
STEROID_ANCESTORS = (1518254, 1518978, 1506270, 1507705, 1550557, 920458, 903963)
VENTILATION_ANCESTORS = (4230167,)
ECMO_ANCESTORS = (4052536,)
REMDESIVIR_ANCESTORS = (37499271,)
VENTILATION_MODE = 3004921

# Vital signs, lifestyle and intensive care.
VITALS = {"f_ext_bmi_last": 3038553, "f_ext_sbp_last": 3004249, "f_ext_dbp_last": 3012888}
LIFESTYLE = {
    "f_ext_smoking_any": ((1585856,), ("%smok%", "%tobacco%")), "f_ext_alcohol_any": ((1586197,), ("%alcohol%",)),
}
SPO2, ICU_OBSERVATION, ICU_MEASUREMENT = 3013502, 1259883, 706367
ICU_SITE_TEXT = ("%icu%", "%intensive%", "%critical care%", "%micu%", "%sicu%", "%ccu%")

# Calendar bands.
BANDS = (
    ("f_ext_wave_ancestral_1", "2020-02-09", "2020-08-30"),
    ("f_ext_wave_iota_alpha_2", "2020-08-31", "2021-06-20"),
    ("f_ext_wave_delta_3", "2021-06-21", "2021-10-31"),
    ("f_ext_wave_delta_omicron_4", "2021-11-01", "2022-03-06"),
    ("f_ext_wave_omicron_ba2_ba5_5", "2022-03-07", "2022-07-18"),
)

# Vaccines.
VACCINE_IDS = (
    724907, 724906, 702866, 702678, 724904, 702676, 724905, 702664, 702672, 702679, 702677, 702666, 905420,
)
VACCINE_TEXT = (
    "%covid%vaccin%", "%pfizer%", "%moderna%", "%comirnaty%", "%spikevax%", "%janssen%", "%johnson%", "%novavax%",
)
VACCINE_TYPES = {
    "mrna": (
        (724907, 724906, 702678, 702676, 702677, 905420), ("%pfizer%", "%biontech%", "%comirnaty%", "%moderna%", "%spikevax%"),
    ),
    "vector": ((702866, 724905), ("%janssen%", "%johnson%", "%astrazeneca%", "%vaxzevria%")),
}

# Serology codes and interpretations.
ANTIBODY_CODES = ("94661-6", "94563-4", "94769-7", "94505-5", "94762-2", "94564-2")
ANTIBODY_POSITIVE = (45884084, 45877985, 45881802)
ANTIBODY_NEGATIVE = (45878583, 45880296, 45884092)
N_CODES = ("94720-0", "94504-8", "94761-4", "94506-3", "96118-2")
S_CODES = ("94509-7", "94551-9", "96831-0", "94507-1", "94505-5")

# Primary care specialties and payer keywords.
PRIMARY_CARE = (38004446, 38004489, 38004479)
PAYERS = {
    "f_eng_insurance_commercial": ("COMMERCIAL", "PPO", "HMO", "AETNA", "CIGNA", "UNITED", "BLUE", "ANTHEM", "EMPIRE"),
    "f_eng_insurance_medicaid": ("MEDICAID",),
    "f_eng_insurance_medicare": ("MEDICARE",),
    "f_eng_insurance_self_pay": ("SELF", "UNINSURED", "CHARITY", "NO INSURANCE"),
}

# Laboratory codes and limits (codes, ids, upper limit, lower limit).
LABS = {
    "crp": (("1988-5", "30522-7", "71426-1"), (), 10.0, None),
    "esr": (("30341-2", "18184-2"), (), 20.0, None),
    "ferritin": (("2276-4",), (), 300.0, None),
    "ddimer": (("48065-7", "48066-5", "48067-3", "71427-9"), (), 0.5, None),
    "fibrinogen": (("3255-7",), (), 400.0, None),
    "albumin": (("1751-7",), (), None, 3.5),
    "ldh": (("2532-0", "14805-6"), (), 250.0, None),
    "creatinine": (("2160-0",), (), 1.2, None),
    "ast": (("1920-8",), (4189605,), 40.0, None),
    "alt": (("1742-6",), (4189605,), 40.0, None),
    "troponin": (("6598-7", "10839-9", "49563-0", "89579-7"), (), 0.04, None),
    "nt_probnp": (("33762-6", "83107-3"), (), 125.0, None),
    "lactate": (("2524-7",), (), 2.0, None),
    "platelets": (("777-3", "26515-7"), (), 400.0, 150.0),
    "pt_inr": (("34714-6", "6301-6"), (), 1.1, None),
}
BLOOD_COUNT = {
    "neut": ("751-8", "26499-4"), "lymph": ("731-0", "26474-7"), "mono": ("742-7", "26484-6"),
    "eos": ("711-2", "26449-9"), "plt": ("777-3", "26515-7"), "rdw": ("788-0", "30385-9"),
}

# Gastrointestinal cluster.
GI_SYMPTOMS = {
    "f_comp_gi_chronic_diarrhea": (196523, 4091513, 196152), "f_comp_gi_abdominal_pain": (200219, 4103703),
    "f_comp_gi_nausea_vomiting": (27674, 4101344),
}
GI_PROCEDURES = {
    "f_comp_gi_endoscopy": ("%ENDOSCOP%", "%COLONOSCOP%", "%SIGMOIDOSCOP%"),
    "f_comp_gi_biopsy": ("%BIOPSY%GI%", "%BIOPSY%INTESTIN%", "%BIOPSY%COLON%", "%BIOPSY%GASTRIC%"),
}
GI_DRUGS = {
    "f_comp_gi_ppi": ("%omeprazole%", "%pantoprazole%", "%lansoprazole%", "%esomeprazole%", "%rabeprazole%"),
    "f_comp_gi_antidiarrheal": ("%loperamide%", "%bismuth%", "%cholestyramine%", "%diphenoxylate%"),
}

# Late composites by parts of the feature name, and the mechanism prefixes.
LATE_COMPOSITES = {
    "f_comp_td_crp_esr_elevated": ("crp_abnormal_any", "esr_abnormal_any"),
    "f_comp_td_post_acute_respiratory": ("enh_viral_resp_dx_any",),
    "f_comp_td_sustained_coag": ("ddimer_abnormal_any", "endo_repeated_ddimer_testing"),
    "f_comp_td_emerging_dysautonomia": ("enh_endo_pots_orthostatic",),
    "f_comp_td_late_autoimmune": (
        "enh_immuno_ana_ordered", "enh_immuno_antiphospholipid_ordered", "enh_immuno_rheumatology_visit",
        "enh_immuno_new_rheum_dx",
    ),
    "f_comp_td_persistent_cytokine": ("immuno_any_il6", "immuno_any_tnfa"),
    "f_comp_td_unresolved_thrombosis": ("enh_endo_dvt_pe", "enh_endo_arterial_thrombosis"),
}
LATE_MECHANISMS = {"viral": ("viral_",), "immuno": ("immuno_",), "endo": ("endo_",)}

# Outcome subtypes (ancestors, name patterns).
SUBTYPES = {
    "cardiorespiratory": ConceptSpec(
        ancestors=(312437, 254761, 77670, 255573, 444070, 315078),
        names=(
            "%DYSPNEA%", "%BREATHLESSNESS%", "%CHRONIC COUGH%", "%CHEST PAIN%", "%PALPITATION%", "%TACHYCARDIA%",
            "%INTERSTITIAL LUNG%", "%EXERTIONAL BREATHLESSNESS%", "%SHORTNESS OF BREATH%", "%PLEURITIC%",
        ),
    ),
    "fatigue": ConceptSpec(
        ancestors=(4223659, 439926, 4272240),
        names=(
            "%FATIGUE%", "%MALAISE%", "%WEAKNESS%", "%ASTHENIA%", "%POST%EXERTIONAL%", "%POST-VIRAL FATIGUE%",
            "%CHRONIC FATIGUE%", "%LASSITUDE%", "%LETHARGY%", "%TIREDNESS%",
        ),
    ),
    "anxiety_depression": ConceptSpec(
        ancestors=(441542, 440383, 4152280, 436676, 4077577),
        names=(
            "%ANXIETY%", "%DEPRESSION%", "%DEPRESSIVE%", "%POST%TRAUMATIC STRESS%", "%PTSD%", "%ADJUSTMENT DISORDER%",
            "%MOOD DISORDER%", "%MOOD DISTURBANCE%", "%DYSTHYMIA%",
        ),
    ),
    "gastrointestinal": ConceptSpec(
        ancestors=(196523, 27674, 200219),
        names=(
            "%DIARRHEA%", "%DIARRHOEA%", "%NAUSEA%", "%ABDOMINAL PAIN%", "%IRRITABLE BOWEL%", "%ALTERED BOWEL%",
            "%LOSS OF APPETITE%", "%ANOREXIA%", "%VOMITING%", "%GASTROPARESIS%",
        ),
    ),
    "cognitive": ConceptSpec(
        ancestors=(373995, 374009, 40480615, 4304008),
        names=(
            "%COGNITIVE%IMPAIRMENT%", "%COGNITIVE%DYSFUNCTION%", "%MEMORY%IMPAIRMENT%", "%MEMORY%DEFICIT%",
            "%MEMORY%LOSS%", "%BRAIN FOG%", "%ATTENTION%DEFICIT%", "%CONCENTRATION%IMPAIRMENT%",
            "%CONCENTRATION%DIFFICULTY%", "%COGNITIVE%DECLINE%", "%POST%COVID%COGNITIVE%", "%AMNESIA%",
        ),
    ),
}
BLOCKLIST = {
    "cardiorespiratory": (
        "f_sym_hpo_dyspnea", "f_sym_hpo_cough", "f_sym_hpo_chest_pain", "f_ext_sym_palpitations",
        "f_ext_sym_tachycardia", "f_comor_chronic_pulm", r"re:^f_ind_enh_viral_w\d+_\d+_resp_dx_any$",
        r"re:^f_comp_td_post_acute_respiratory(_n_windows)?$",
    ),
    "fatigue": ("f_sym_hpo_fatigue", "f_sym_hpo_malaise"),
    "anxiety_depression": ("f_comor_anxiety", "f_comor_depression"),
    "gastrointestinal": (
        "f_sym_hpo_nausea", "f_sym_hpo_vomiting", "f_sym_hpo_diarrhea", "f_sym_hpo_abdominal_pain",
        r"re:^f_ind_enh_viral_w\d+_\d+_gi_dx_any$", "f_comp_gi_any", "f_comp_gi_burden_score",
        "f_comp_gi_abdominal_pain", "f_comp_gi_chronic_diarrhea",
    ),
    "cognitive": ("f_ext_sym_neurocog", "f_comor_dementia"),
}

# Pairs of configurations that are tested against each other, by correction group.
TEST_GROUPS = {
    "H2": (("baseline_ext", "baseline_core"),),
    "H3H4_plain": (("mechsig_all", "baseline_ext"),),
    "H3H4_no_td": (("mechsig_all_no_td", "baseline_ext_no_td"),),
    "H3H4_no_eng": (("mechsig_all_no_eng", "baseline_ext_no_eng"),),
    "clusters": (("mechsig_viral", "baseline_ext"), ("mechsig_immuno", "baseline_ext"), ("mechsig_endo", "baseline_ext")),
    "eng_step": (("baseline_core_eng", "baseline_core"),),
}
