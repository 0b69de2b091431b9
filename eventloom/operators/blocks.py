"""Person-level feature blocks.

Events are reduced to one row per person, set and day (or to the few sums a
feature needs) before they meet the cohort, so a person with very many events is
combined on the map side and contributes at most one row per set and day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import inside_any
from ..functions.predicates import any_of, ilike_any
from ..functions.ranks import exact_quantiles
from ..functions.skew import literal_table, lookup_join, salted_join
from ..session import materialise
from .concepts import ConceptSpec, Vocabulary, resolve_all
from .windows import in_person_window, overlapping

OneOrMany = int | Sequence[int]


# ------------------------------------------------------------------ shared shapes


def set_days(events: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct (person_id, set_id, event_date) of the rows that belong to a set."""
    pairs = lookup_join(
        events.select("person_id", "concept_id", "event_date"),
        membership.select("set_id", "concept_id").distinct(),
        ["concept_id"],
        ["person_id", "event_date"],
    )
    return pairs.select("person_id", "set_id", "event_date").distinct()


def flags(cohort: DataFrame, hits: DataFrame, names: Sequence[str], key: str = "set_id") -> DataFrame:
    """One 0/1 column per name for every cohort member; ``hits`` is (person_id, key)."""
    wide = (
        hits.select("person_id", F.col(key).alias("_name"))
        .withColumn("_one", F.lit(1))
        .groupBy("person_id")
        .pivot("_name", list(names))
        .agg(F.max("_one"))
    )
    full = cohort.select("person_id").join(wide, "person_id", "left")
    return full.select("person_id", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])


def ancestor_sets(sets: Mapping[str, Sequence[int]]) -> dict[str, list[ConceptSpec]]:
    return {name: [ConceptSpec(ancestors=tuple(ids))] for name, ids in sets.items()}


def minus_set(vocabulary: Vocabulary, name: str, include: Sequence[int], exclude: Sequence[int]) -> DataFrame:
    """Descendants of ``include`` that are not below ``exclude``, as a named set."""
    both = resolve_all(vocabulary, {name: [ConceptSpec(ancestors=tuple(include))], "": [ConceptSpec(ancestors=tuple(exclude))]})
    kept = both.groupBy("concept_id").agg(
        F.max(F.when(F.col("set_id") == name, 1)).alias("_in"), F.max(F.when(F.col("set_id") == "", 1)).alias("_out")
    )
    return kept.where(F.col("_in").isNotNull() & F.col("_out").isNull()).select(F.lit(name).alias("set_id"), "concept_id")


# ------------------------------------------------------------------ flags over the hierarchy


def history_flags(conditions: DataFrame, cohort: DataFrame, membership: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ever on or before the index date: only the first day per person and set matters."""
    first = set_days(conditions, membership).groupBy("person_id", "set_id").agg(F.min("event_date").alias("event_date"))
    hits = first.join(cohort.select("person_id", "index_date"), "person_id").where("event_date <= index_date")
    return flags(cohort, hits, names)


def ancestor_flags(
    conditions: DataFrame,
    cohort: DataFrame,
    vocabulary: Vocabulary,
    sets: Mapping[str, Sequence[int]],
    exclusion: tuple[str, Sequence[int], Sequence[int]] | None = None,
) -> DataFrame:
    """Comorbidity flags; ``exclusion`` adds a flag for one ancestor minus another."""
    members = resolve_all(vocabulary, ancestor_sets(sets))
    names = list(sets)
    if exclusion:
        members = members.unionByName(minus_set(vocabulary, *exclusion))
        names.append(exclusion[0])
    return history_flags(conditions, cohort, members, names)


def window_flags(
    events: DataFrame, cohort: DataFrame, membership: DataFrame, names: Sequence[str],
    start: str = "acute_start", end: str = "acute_end",
) -> DataFrame:
    """Any event of the set inside the person's window."""
    return flags(cohort, in_person_window(set_days(events, membership), cohort, start, end), names)


def window_ancestor_flags(events, cohort, vocabulary: Vocabulary, sets: Mapping[str, Sequence[int]], skip: Sequence[str] = ()):
    kept = {n: ids for n, ids in sets.items() if n not in skip}
    return window_flags(events, cohort, resolve_all(vocabulary, ancestor_sets(kept)), list(kept))


def ontology_flags(conditions: DataFrame, cohort: DataFrame, mapping: DataFrame, terms: Mapping[str, str]) -> DataFrame:
    """Symptoms through the concept-to-term map."""
    wanted = literal_table(conditions.sparkSession, list(terms.items()), "set_id STRING, term_id STRING")
    members = mapping.join(wanted, "term_id").select("set_id", "concept_id").distinct()
    return window_flags(conditions, cohort, members, list(terms))


# ------------------------------------------------------------------ drugs


def clean_name(name: Column) -> Column:
    """Column-safe ingredient name, cut to 60 characters before the prefix."""
    lowered = F.lower(name)
    under = F.translate(lowered, " -/", "___")
    plain = F.translate(under, ",().'", "")
    return F.concat(F.lit("f_drug_"), F.substring(plain, 1, 60))


def drug_ingredients(
    drugs: DataFrame, cohort: DataFrame, vocabulary: Vocabulary, ingredient_vocabulary: str = "RxNorm"
) -> DataFrame:
    """Distinct (person_id, ingredient_id, ingredient_name) inside the acute window."""
    roots = vocabulary.concept.where(
        (F.col("concept_class_id") == "Ingredient") & (F.col("vocabulary_id") == ingredient_vocabulary)
    ).select(F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_name").alias("ingredient_name"))
    members = vocabulary.ancestor.join(roots, "ancestor_concept_id").select(
        F.col("descendant_concept_id").alias("concept_id"),
        F.col("ancestor_concept_id").alias("ingredient_id"),
        "ingredient_name",
    )
    # Hardly a drug is told twice on a day: rows meet their person's window at once, in one shuffle, and few are left to be made distinct.
    rows = drugs.where(F.col("concept_id") > 0).select("person_id", "concept_id", "event_date")
    taken = in_person_window(rows, cohort, "acute_start", "acute_end").select("person_id", "concept_id").distinct()
    return lookup_join(taken, members, ["concept_id"], ["person_id"]).select(
        "person_id", "ingredient_id", "ingredient_name"
    ).distinct()


def qualifying_ingredients(pairs: DataFrame, cohort: DataFrame, min_prev: float = 0.01, min_count: int = 0) -> DataFrame:
    """Ingredients taken by at least max(min_count, ceil(min_prev * N), 1) persons."""
    size = cohort.agg(F.count(F.lit(1)).alias("_n"))
    need = F.greatest(F.ceil(F.lit(float(min_prev)) * size.scalar()), F.lit(1), F.lit(int(min_count)))
    counts = pairs.groupBy("ingredient_id", "ingredient_name").agg(F.count(F.lit(1)).alias("n_persons"))
    return counts.where(F.col("n_persons") >= need).withColumn("feature", clean_name(F.col("ingredient_name")))


def ingredient_hits(pairs: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Long flags (person_id, feature); ingredients with the same cleaned name merge."""
    return lookup_join(pairs, qualifying.select("ingredient_id", "feature"), ["ingredient_id"], ["person_id"]).select(
        "person_id", "feature"
    ).distinct()


def ingredient_flags(pairs: DataFrame, cohort: DataFrame, min_prev: float = 0.01, min_count: int = 0) -> DataFrame:
    """Wide form: the qualifying names (vocabulary-sized) become the pivot list.  The pairs are stored, as they are read three times."""
    pairs = materialise(pairs, "ingredient-pairs")
    qualifying = qualifying_ingredients(pairs, cohort, min_prev, min_count)
    names = [r.feature for r in qualifying.select("feature").distinct().orderBy("feature").collect()]
    return flags(cohort, ingredient_hits(pairs, qualifying), names, "feature")


def class_composite(pairs: DataFrame, cohort: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """1 if any ingredient name, before prevalence filtering, contains one of the parts."""
    hits = pairs.where(any_of(F.lower("ingredient_name").contains(p.lower()) for p in parts)).select("person_id").distinct()
    return flags(cohort, hits.withColumn("set_id", F.lit(name)), [name])


def during_visits(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Rows (person_id, event_date, ...) on a day of one of the person's visits, each once.

    Rows and visits meet by time buckets; no visit is unfolded into days.
    """
    stays = visits.select("person_id", F.col("event_date").alias("_from"), F.greatest("visit_end", "event_date").alias("_to"))
    return inside_any(rows, stays, ["person_id"], "event_date", "_from", "_to")


def index_stays(visits: DataFrame, cohort: DataFrame, types: Sequence[int], before: int = 1, after: int = 16) -> DataFrame:
    stays = visits.where(F.col("concept_id").isin(*types))
    return overlapping(
        stays, cohort.select("person_id", "index_date"), F.date_add("index_date", -before), F.date_add("index_date", after)
    )


def regimen_flag(
    drugs: DataFrame, cohort: DataFrame, visits: DataFrame, membership: DataFrame, types: Sequence[int], name: str
) -> DataFrame:
    """Inpatients given a drug of the set inside the acute window and during a qualifying visit.

    Days and stays are read several times by their join and stored before it.
    """
    inpatients = cohort.where(F.col("is_inpatient") == 1)
    given = materialise(in_person_window(set_days(drugs, membership), inpatients, "acute_start", "acute_end"), "given")
    stays = materialise(index_stays(visits, inpatients, types), "index-stays")
    hits = during_visits(given, stays).select("person_id").distinct()
    return flags(cohort, hits.withColumn("set_id", F.lit(name)), [name])


# ------------------------------------------------------------------ demographics and treatment

FEMALE, MALE = 8532, 8507


def one_hot_demographics(cohort: DataFrame) -> DataFrame:
    g = F.col("gender_concept_id")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return cohort.select(
        "person_id",
        F.col("age_at_index").alias("f_age"),
        flag(g == FEMALE).alias("f_sex_female"),
        flag(g == MALE).alias("f_sex_male"),
        (g.isNull() | ~g.isin(FEMALE, MALE)).cast("int").alias("f_sex_unknown"),
    )


def treatment_measures(
    cohort: DataFrame, procedures: DataFrame, observations: DataFrame, drugs: DataFrame,
    sets: Mapping[str, DataFrame], ventilation_mode: OneOrMany,
) -> DataFrame:
    """Length of stay (may be -1), ventilation, ECMO and antiviral of inpatients; outpatients get 0.

    ``sets`` maps ``imv``, ``ecmo`` and ``remdesivir`` to concept tables.
    """
    inpatients = cohort.where(F.col("is_inpatient") == 1)
    modes = [ventilation_mode] if isinstance(ventilation_mode, int) else list(ventilation_mode)

    def inside(events, concepts, name):
        days = set_days(events, concepts.select(F.lit(name).alias("set_id"), "concept_id"))
        return in_person_window(days, inpatients, "acute_start", "acute_end").select("person_id", "set_id")

    observed = observations.where(F.col("concept_id").isin(*modes)).select(
        "person_id", F.lit("f_tx_imv").alias("set_id"), "event_date"
    ).distinct()
    hits = (
        inside(procedures, sets["imv"], "f_tx_imv")
        .unionByName(in_person_window(observed, inpatients, "acute_start", "acute_end").select("person_id", "set_id"))
        .unionByName(inside(procedures, sets["ecmo"], "f_tx_ecmo"))
        .unionByName(inside(drugs, sets["remdesivir"], "f_tx_remdesivir"))
    )
    los = F.when(F.col("is_inpatient") == 1, F.coalesce(F.datediff("discharge_date", "index_date"), F.lit(0))).otherwise(0)
    wide = flags(cohort, hits, ["f_tx_imv", "f_tx_ecmo", "f_tx_remdesivir"])
    return cohort.select("person_id", los.alias("f_tx_los")).join(wide, "person_id")


def severity_one_hot(
    cohort: DataFrame, procedures: DataFrame, observations: DataFrame, visits: DataFrame,
    ventilation: DataFrame, ventilation_mode: OneOrMany, emergency: Sequence[int],
) -> DataFrame:
    """Five mutually exclusive levels; the deceased level stays empty by construction."""
    modes = [ventilation_mode] if isinstance(ventilation_mode, int) else list(ventilation_mode)
    vent_days = set_days(procedures, ventilation.select(F.lit("vent").alias("set_id"), "concept_id"))
    mode_days = observations.where(F.col("concept_id").isin(*modes)).select(
        "person_id", F.lit("vent").alias("set_id"), "event_date"
    )
    ed_days = visits.where(F.col("concept_id").isin(*emergency)).select(
        "person_id", F.lit("ed").alias("set_id"), "event_date"
    )
    days = vent_days.unionByName(mode_days).unionByName(ed_days).distinct()
    found = flags(cohort, in_person_window(days, cohort, "acute_start", "acute_end"), ["vent", "ed"])
    inpatient = F.col("is_inpatient") == 1
    levels = {
        "dead": F.lit(False),
        "severe_icu_vent": inpatient & (F.col("vent") == 1),
        "moderate_hosp": inpatient & (F.col("vent") == 0),
        "mild_ed": ~inpatient & (F.col("ed") == 1),
        "mild_no_ed": ~inpatient & (F.col("ed") == 0),
    }
    return cohort.select("person_id", "is_inpatient").join(found, "person_id").select(
        "person_id", *[c.cast("int").alias(f"f_tx_severity_who_{n}") for n, c in levels.items()]
    )


# ------------------------------------------------------------------ history before the index date


def last_value_before(measurements: DataFrame, cohort: DataFrame, concepts: Mapping[str, int]) -> DataFrame:
    """Latest numeric value on or before the index date; same day: the higher event id."""
    names = {v: k for k, v in concepts.items()}
    daily = (
        measurements.where(F.col("concept_id").isin(*names) & F.col("value").isNotNull())
        .groupBy("person_id", "concept_id", "event_date")
        .agg(F.max_by("value", "event_id").alias("value"))
    )
    before = daily.join(cohort.select("person_id", "index_date"), "person_id").where("event_date <= index_date")
    last = before.groupBy("person_id").agg(
        *[
            F.max_by(F.when(F.col("concept_id") == c, F.col("value")), F.when(F.col("concept_id") == c, F.col("event_date"))).alias(n)
            for c, n in names.items()
        ]
    )
    return cohort.select("person_id").join(last, "person_id", "left")


def history_text_flags(
    observations: DataFrame, cohort: DataFrame, rules: Mapping[str, tuple[Sequence[int], Sequence[str]]]
) -> DataFrame:
    """By concept or source text, on or before the index date."""
    tests = [
        F.when(F.col("concept_id").isin(*ids) | F.coalesce(ilike_any("source_text", text), F.lit(False)), F.lit(name))
        for name, (ids, text) in rules.items()
    ]
    first = (
        observations.select("person_id", "event_date", F.explode(F.filter(F.array(*tests), lambda n: n.isNotNull())).alias("set_id"))
        .groupBy("person_id", "set_id")
        .agg(F.min("event_date").alias("event_date"))
    )
    hits = first.join(cohort.select("person_id", "index_date"), "person_id").where("event_date <= index_date")
    return flags(cohort, hits, list(rules))


def acute_severity(
    cohort: DataFrame, visits: DataFrame, observations: DataFrame, measurements: DataFrame, sites: DataFrame,
    inpatient_types: Sequence[int], icu_observations: Sequence[int], icu_measurements: Sequence[int],
    spo2: Sequence[int], ventilation_mode: Sequence[int],
    icu_text: Sequence[str] = ("%icu%",), icu_site_text: Sequence[str] = ("%icu%",),
) -> DataFrame:
    """Inpatient visits that overlap the acute window and what was recorded during them."""
    stays = overlapping(
        visits.where(F.col("concept_id").isin(*inpatient_types)),
        cohort.select("person_id", "acute_start", "acute_end"), F.col("acute_start"), F.col("acute_end"),
    )
    icu_sites = sites.where(ilike_any("site_name", icu_site_text)).select("site_id", F.lit(1).alias("_icu"))
    los = F.datediff("visit_end", "event_date") + 1
    hosp = lookup_join(stays, icu_sites, ["site_id"], ["event_id"], "left").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(los).alias("los"), F.max(F.coalesce("_icu", F.lit(0))).alias("site")
    )
    obs_daily = observations.groupBy("person_id", "event_date").agg(
        F.max((F.col("concept_id").isin(*icu_observations) | F.coalesce(ilike_any("source_text", icu_text), F.lit(False))).cast("int")).alias("icu_obs"),
        F.max(F.col("concept_id").isin(*ventilation_mode).cast("int")).alias("vent"),
    ).where("icu_obs + vent > 0")
    is_spo2 = F.col("concept_id").isin(*spo2) & F.col("value").isNotNull()
    meas_daily = measurements.groupBy("person_id", "event_date").agg(
        F.max(F.col("concept_id").isin(*icu_measurements).cast("int")).alias("icu_meas"),
        F.min(F.when(is_spo2, F.col("value"))).alias("spo2_min"),
    ).where("icu_meas > 0 OR spo2_min IS NOT NULL")
    both = obs_daily.unionByName(meas_daily, allowMissingColumns=True)
    during = during_visits(both, stays).groupBy("person_id").agg(
        F.max("icu_obs").alias("icu_obs"), F.max("vent").alias("vent"), F.max("icu_meas").alias("icu_meas"),
        F.min("spo2_min").alias("spo2_min"),
    )
    df = cohort.select("person_id").join(hosp, "person_id", "left").join(during, "person_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return df.select(
        "person_id",
        (zero("n") > 0).cast("int").alias("f_ext_hosp_acute"),
        zero("n").alias("f_ext_n_admissions"),
        zero("los").alias("f_ext_los_max"),
        zero("icu_obs").alias("f_ext_icu_obs"),
        zero("icu_meas").alias("f_ext_icu_care_site"),
        zero("site").alias("f_ext_icu_site_kw"),
        F.greatest(zero("icu_obs"), zero("icu_meas"), zero("site")).alias("f_ext_icu_any"),
        F.col("spo2_min").isNotNull().cast("int").alias("f_ext_spo2_any"),
        F.col("spo2_min").alias("f_ext_spo2_min"),
        zero("vent").alias("f_ext_vent_any"),
    )


def band_of(date: Column, bands: Sequence[tuple[str, str, str]], default: int) -> Column:
    """1-based number of the date band."""
    out = F.lit(default)
    for i, (_, lo, hi) in reversed(list(enumerate(bands, start=1))):
        out = F.when(date.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), i).otherwise(out)
    return out


def calendar_bands(cohort: DataFrame, bands: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Band dummies (none set outside all bands) and index year + month fraction, null -> median."""
    month = F.year("index_date") + (F.month("index_date") - 1) / F.lit(12.0)
    base = cohort.select(
        "person_id",
        *[
            F.coalesce(F.col("index_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(False)).cast("int").alias(n)
            for n, lo, hi in bands
        ],
        month.alias("_month"),
    )
    middle = exact_quantiles(base, [], "_month", {"m": 0.5}).select("m")
    return base.withColumn("f_ext_index_year_month", F.coalesce("_month", middle.scalar())).drop("_month")


def dose_history(
    drugs: DataFrame, cohort: DataFrame, ids: Sequence[int], text: Sequence[str],
    kinds: Mapping[str, tuple[Sequence[int], Sequence[str]]],
) -> DataFrame:
    """Distinct dose days strictly before the index date, any, count, boosted (>= 3) and per type."""
    counts_as = F.col("concept_id").isin(*ids) | F.coalesce(ilike_any("source_text", text), F.lit(False))
    daily = drugs.where(counts_as).groupBy("person_id", "event_date").agg(
        *[
            F.max((F.col("concept_id").isin(*i) | F.coalesce(ilike_any("source_text", t), F.lit(False))).cast("int")).alias(k)
            for k, (i, t) in kinds.items()
        ]
    )
    before = daily.join(cohort.select("person_id", "index_date"), "person_id").where("event_date < index_date")
    agg = before.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in kinds])
    n = F.coalesce(F.col("n"), F.lit(0))
    return cohort.select("person_id").join(agg, "person_id", "left").select(
        "person_id",
        (n > 0).cast("int").alias("f_ext_vax_any"),
        n.alias("f_ext_vax_dose_count"),
        (n >= 3).cast("int").alias("f_ext_vax_boosted"),
        *[F.coalesce(F.col(k), F.lit(0)).alias(f"f_ext_vax_{k}_any") for k in kinds],
    )


# ------------------------------------------------------------------ serology

AB = "f_ext_sars_cov2_ab_"


def _until_acute_end(tests: DataFrame, cohort: DataFrame) -> DataFrame:
    people = cohort.select("person_id", "index_date", "acute_end")
    return salted_join(tests, people, ["person_id"], ["event_id"]).where("event_date <= acute_end")


def serology_interpretation(
    tests: DataFrame, cohort: DataFrame, positive: Sequence[int], negative: Sequence[int],
    bands: Sequence[tuple[str, str, str]], first_positive_only: bool = False,
) -> DataFrame:
    """Ever positive / negative, number of interpreted tests, band of the first test.

    The band uses the earliest test of any result among ever-positive persons;
    ``first_positive_only`` takes the earliest positive test instead.
    """
    code = F.col("value_concept_id")
    usable = tests.where(code.isNotNull() | F.col("value").isNotNull())
    daily = usable.groupBy("person_id", "event_date").agg(
        F.count_if(code.isin(*positive)).alias("pos"), F.count_if(code.isin(*negative)).alias("neg")
    )
    inside = daily.join(cohort.select("person_id", "acute_end"), "person_id").where("event_date <= acute_end")
    date = F.when(F.col("pos") > 0, F.col("event_date")) if first_positive_only else F.col("event_date")
    agg = inside.groupBy("person_id").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min(date).alias("first_date")
    )
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    return cohort.select("person_id").join(agg, "person_id", "left").select(
        "person_id",
        (pos > 0).cast("int").alias(AB + "ever_positive"),
        (neg > 0).cast("int").alias(AB + "ever_negative"),
        F.when(pos > 0, band_of(F.col("first_date"), bands, len(bands) + 1)).otherwise(0).alias(AB + "wave_at_first_positive"),
        (pos + neg).alias(AB + "n_tests"),
    )


def titer_features(tests: DataFrame, cohort: DataFrame) -> DataFrame:
    """Log-titer z maximum and z nearest to index per person and assay, slope over all titers, count.

    Everything comes from sums per (person, assay): no per-person loop or sort.
    Rows without an assay count in slope and number but have no z.
    """
    titers = _until_acute_end(tests.where(F.col("value") > 0), cohort)
    y = F.log(F.greatest(F.col("value"), F.lit(1e-10)))
    x = F.datediff("event_date", "index_date").cast("double")
    base = titers.select("person_id", F.col("source_concept_id").alias("assay"), "event_date", "event_id", y.alias("y"), x.alias("x"))
    per_assay = base.groupBy("person_id", "assay").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"), F.max("y").alias("top"),
        F.min_by("y", F.struct(F.abs("x"), "event_date", "event_id")).alias("near"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )

    def z(v: str) -> Column:
        return F.when(F.col("sd") > 1e-12, (F.col(v) - F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0))

    has = F.col("assay").isNotNull()
    n, sx, sy = F.sum("n"), F.sum("sx"), F.sum("sy")
    denominator = n * F.sum("sxx") - sx * sx
    slope = F.when(F.min("x0") < F.max("x1"), (n * F.sum("sxy") - sx * sy) / denominator).otherwise(F.lit(0.0))
    per_person = per_assay.groupBy("person_id").agg(
        F.max(F.when(has, z("top"))).alias("zmax"),
        F.max_by(F.when(has, z("near")), F.when(has, F.col("assay"))).alias("znear"),
        slope.alias("slope"),
        n.alias("n"),
    )
    out = cohort.select("person_id").join(per_person, "person_id", "left")
    return out.select(
        "person_id",
        F.coalesce("zmax", F.lit(0.0)).alias(AB + "titer_log_max"),
        F.coalesce("znear", F.lit(0.0)).alias(AB + "titer_log_at_index"),
        F.coalesce("slope", F.lit(0.0)).alias(AB + "titer_log_slope"),
        F.coalesce("n", F.lit(0)).alias(AB + "n_titer_measurements"),
    )


def antibody_contrast(
    tests: DataFrame, cohort: DataFrame, kinds: DataFrame, interpretation: DataFrame, tested_flag: bool = False
) -> DataFrame:
    """z within each assay over all persons, averaged per antibody kind (N / S), their contrast and profile flags.

    ``kinds`` is (concept_id, ab_type).  Assay means are aggregated and joined
    back, so a dominant assay is never sorted or held in one task.
    """
    typed = lookup_join(tests.where(F.col("value") > 0), kinds, ["concept_id"], ["event_id"])
    rows = _until_acute_end(typed, cohort).select(
        "person_id", "ab_type", F.col("source_concept_id").alias("assay"),
        F.log(F.greatest(F.col("value"), F.lit(1e-10))).alias("y"),
    ).where(F.col("assay").isNotNull())
    cells = rows.groupBy("person_id", "ab_type", "assay").agg(F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    stats = rows.groupBy("assay").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"))
    z_sum = F.when(F.col("sd") > 1e-12, (F.col("sy") - F.col("n") * F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0))
    z = lookup_join(cells, stats, ["assay"], ["person_id"]).groupBy("person_id").pivot("ab_type", ["N", "S"]).agg(
        F.sum(z_sum) / F.sum("n")
    )
    df = interpretation.join(z, "person_id", "left")
    has_n, has_s = F.col("N").isNotNull(), F.col("S").isNotNull()
    zn, zs = F.coalesce("N", F.lit(0.0)), F.coalesce("S", F.lit(0.0))
    positive = F.col(AB + "ever_positive") == 1
    wave = F.col(AB + "wave_at_first_positive")
    p = "f_ext_sars_cov2_"
    out = {
        p + "anti_n_igg_z": zn,
        p + "anti_s_igg_z": zs,
        p + "anti_n_minus_s_z": zn - zs,
        p + "has_n_titer": has_n.cast("int"),
        p + "has_s_titer": has_s.cast("int"),
        p + "immunoprofile_vax_only": (has_s & ~has_n & positive).cast("int"),
        p + "immunoprofile_infection": (zn > 0).cast("int"),
        p + "immunoprofile_breakthrough": ((zn > 0) & (zs > 0)).cast("int"),
        AB + "early_wave_positive": (positive & wave.isin(1, 2)).cast("int"),
        AB + "mid_wave_positive": (positive & wave.isin(3, 4)).cast("int"),
        AB + "late_wave_positive": (positive & wave.isin(5, 6)).cast("int"),
    }
    if tested_flag:
        out[AB + "tested"] = (F.col(AB + "n_tests") > 0).cast("int")
    return df.select("person_id", *[c.alias(n) for n, c in out.items()])


# ------------------------------------------------------------------ engagement


def engagement_controls(
    cohort: DataFrame, visits: DataFrame, providers: DataFrame, plans: DataFrame,
    primary_care: Sequence[int], payers: Mapping[str, Sequence[str]], days: int = 365,
) -> DataFrame:
    """Distinct visits and a primary-care visit in [-days, -1], and payer classes valid at index.

    ``plans`` is (person_id, payer, plan_start, plan_end) with an open end allowed.
    """
    people = cohort.select("person_id", "index_date")
    slim = visits.select("person_id", "event_id", "event_date", "provider_id").distinct()
    near = salted_join(slim, people, ["person_id"], ["event_id"], heavy=visits).where(
        F.col("event_date").between(F.date_add("index_date", -days), F.date_add("index_date", -1))
    )
    general = providers.where(F.col("specialty_concept_id").isin(*primary_care)).select(
        "provider_id", F.lit(1).alias("_pcp")
    ).distinct()
    counted = lookup_join(near, general, ["provider_id"], ["event_id"], "left").groupBy("person_id").agg(
        F.count_distinct("event_id").alias("n"), F.max("_pcp").alias("pcp")
    )
    df = cohort.select("person_id").join(counted, "person_id", "left")
    if payers:
        words_of = {n: [f"%{w}%" for w in words] for n, words in payers.items()}
        classes = plans.groupBy("person_id", "plan_start", "plan_end").agg(
            *[F.max(F.coalesce(ilike_any("payer", ws), F.lit(False)).cast("int")).alias(n) for n, ws in words_of.items()]
        )
        valid = classes.join(people, "person_id").where(
            (F.col("plan_start") <= F.col("index_date"))
            & ((F.col("plan_end") >= F.col("index_date")) | F.col("plan_end").isNull())
        )
        df = df.join(valid.groupBy("person_id").agg(*[F.max(n).alias(n) for n in payers]), "person_id", "left")
    return df.select(
        "person_id",
        F.coalesce("n", F.lit(0)).alias("f_eng_n_encounters_pre_index_1y"),
        F.coalesce("pcp", F.lit(0)).alias("f_eng_has_pcp_pre_index"),
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in payers],
    )


# ------------------------------------------------------------------ outcome subtypes


def subtype_labels(
    conditions: DataFrame, cohort: DataFrame, vocabulary: Vocabulary, groups: Mapping[str, ConceptSpec],
    start_day: int = 90, end_day: int = 540,
) -> DataFrame:
    """0/1 label per symptom group inside the day range; only cases can be 1.

    Descendants and name matches are united before the events are touched, so
    the OR over two memberships is one equi-join.
    """
    members = resolve_all(vocabulary, {g: [spec] for g, spec in groups.items()})
    cases = cohort.where(F.col("label") == 1).select("person_id", "index_date")
    hits = set_days(conditions, members).join(cases, "person_id").where(
        F.datediff("event_date", "index_date").between(start_day, end_day)
    )
    return flags(cohort, hits, list(groups))
