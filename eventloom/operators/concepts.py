"""Concept sets: resolving them through a vocabulary, its hierarchy and an ontology map."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import any_of, ilike_any
from ..functions.skew import literal_table, lookup_join


@dataclass(frozen=True)
class ConceptSpec:
    """A concept set given by ids, codes, ancestors, names or a mix of them."""

    ids: tuple[int, ...] = ()
    codes: tuple[str, ...] = ()
    ancestors: tuple[int, ...] = ()
    names: tuple[str, ...] = ()
    ingredients: tuple[str, ...] = ()
    domain: str | None = None
    code_vocabulary: str = "LOINC"
    code_domain: str = "Measurement"
    ingredient_vocabulary: str = "RxNorm"
    ingredient_domain: str = "Drug"

    def __post_init__(self):
        if not (self.ids or self.codes or self.ancestors or self.names or self.ingredients):
            raise ValueError("a concept set needs ids, codes, ancestors, names or ingredients")


class Vocabulary:
    """The vocabulary tables that concept sets are resolved against."""

    def __init__(self, concept: DataFrame, ancestor: DataFrame):
        self.concept = concept
        self.ancestor = ancestor

    @property
    def spark(self) -> SparkSession:
        return self.concept.sparkSession


def _rows(specs: Mapping[str, Sequence[ConceptSpec]], pick) -> list[tuple]:
    return sorted({row for set_id, parts in specs.items() for spec in parts for row in pick(set_id, spec)})


def _has_name(spec: ConceptSpec) -> Column:
    upper = F.upper("concept_name")
    return any_of(upper.like(p.upper()) for p in spec.names) & (F.col("domain_id") == spec.domain if spec.domain else F.lit(True))


def named(vocabulary: Vocabulary, spec: ConceptSpec) -> DataFrame:
    """The standard rows of the vocabulary that a set's names fit, as they stand."""
    return vocabulary.concept.where((F.col("standard_concept") == "S") & _has_name(spec))


def resolve_all(vocabulary: Vocabulary, specs: Mapping[str, Sequence[ConceptSpec]]) -> DataFrame:
    """All sets in one plan: distinct ``(set_id, concept_id)``.

    Every part filters the vocabulary or the closure by a literal table, so the
    full closure is never joined to events.
    """
    spark = vocabulary.spark
    parts: list[DataFrame] = []

    direct = _rows(specs, lambda s, c: [(s, int(i)) for i in c.ids])
    if direct:
        parts.append(literal_table(spark, direct, "set_id STRING, concept_id BIGINT"))

    coded = _rows(specs, lambda s, c: [(s, code, c.code_vocabulary, c.code_domain) for code in c.codes])
    if coded:
        wanted = literal_table(spark, coded, "set_id STRING, concept_code STRING, vocabulary_id STRING, domain_id STRING")
        parts.append(
            vocabulary.concept.where(F.col("standard_concept") == "S")
            .join(wanted, ["concept_code", "vocabulary_id", "domain_id"])
            .select("set_id", "concept_id")
        )

    below = _rows(specs, lambda s, c: [(s, int(a)) for a in c.ancestors])
    if below:
        wanted = literal_table(spark, below, "set_id STRING, ancestor_concept_id BIGINT")
        parts.append(
            vocabulary.ancestor.join(wanted, "ancestor_concept_id").select(
                "set_id", F.col("descendant_concept_id").alias("concept_id")
            )
        )

    drugs = _rows(
        specs,
        lambda s, c: [(s, n.upper(), c.ingredient_vocabulary, c.ingredient_domain) for n in c.ingredients],
    )
    if drugs:
        wanted = literal_table(spark, drugs, "set_id STRING, _name STRING, vocabulary_id STRING, domain_id STRING")
        roots = (
            vocabulary.concept.where((F.col("standard_concept") == "S") & (F.col("concept_class_id") == "Ingredient"))
            .withColumn("_name", F.upper("concept_name"))
            .join(wanted, ["_name", "vocabulary_id", "domain_id"])
            .select("set_id", F.col("concept_id").alias("ancestor_concept_id"))
            .distinct()
        )
        # The number of roots is bounded by the names asked for; AQE picks the join from its measured size.
        parts.append(
            vocabulary.ancestor.join(roots, "ancestor_concept_id").select(
                "set_id", F.col("descendant_concept_id").alias("concept_id")
            )
        )

    by_name = [(s, c) for s, cs in specs.items() for c in cs if c.names]
    if by_name:
        hits = [F.when(_has_name(c), F.lit(s)) for s, c in by_name]
        parts.append(
            vocabulary.concept.where(F.col("standard_concept") == "S")
            .select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("set_id"), "concept_id")
        )

    if not parts:
        return spark.createDataFrame([], "set_id STRING, concept_id BIGINT")
    out = parts[0].select("set_id", F.col("concept_id").cast("long").alias("concept_id"))
    for part in parts[1:]:
        out = out.unionByName(part.select("set_id", F.col("concept_id").cast("long").alias("concept_id")))
    return out.distinct()


def known_size(specs: Mapping[str, Sequence[ConceptSpec]]) -> int | None:
    """Rows of the resolved table if every set is plain ids, else unknown until counted."""
    parts = [c for cs in specs.values() for c in cs]
    if any(c.codes or c.ancestors or c.names or c.ingredients for c in parts):
        return None
    return sum(len(c.ids) for c in parts)


def resolve(vocabulary: Vocabulary, *specs: ConceptSpec) -> DataFrame:
    return resolve_all(vocabulary, {"set": specs}).select("concept_id")


def concepts_or_text(events: DataFrame, concepts: DataFrame | None, patterns: Sequence[str] = ()) -> DataFrame:
    """Rows whose concept is in the set or whose source text matches a pattern.

    No set and no pattern at all means no filter; an empty set without patterns
    means no rows.
    """
    if concepts is None:
        return events.where(ilike_any("source_text", patterns)) if patterns else events
    members = concepts.select("concept_id").distinct()
    if not patterns:
        return lookup_join(events, members, ["concept_id"], ["event_id"], "left_semi")
    flagged = lookup_join(events, members.withColumn("_in", F.lit(True)), ["concept_id"], ["event_id"], "left")
    return flagged.where(F.col("_in").isNotNull() | ilike_any("source_text", patterns)).drop("_in")


# --------------------------------------------------------------------------- ontology map

# Mapping qualities trusted by default.
TRUSTED = (
    "Automatic One-to-One Concept",
    "Automatic One-to-Many Concept",
    "Automatic One-to-One Ancestor",
    "Automatic One-to-Many Ancestor",
    "Manual One-to-One Concept",
    "Manual One-to-Many Concept",
)


def load_ontology_map(raw: DataFrame, tiers: Iterable[str] | None = None) -> DataFrame:
    """Split the piped term list into one row per (concept, term); labels align by position."""
    kept = raw.where(F.col("mapping_category").isin(*tiers)) if tiers is not None else raw
    split = kept.select(
        "concept_id",
        "mapping_category",
        F.split("ontology_label", r"\s*\|\s*").alias("_labels"),
        F.posexplode(F.split("ontology_id", r"\s*\|\s*")).alias("_pos", "_term"),
    )
    term = F.trim("_term")
    return split.where(term.startswith("HP_")).select(
        "concept_id",
        F.concat(F.lit("HP:"), term.substr(F.lit(4), F.length(term))).alias("term_id"),
        F.coalesce(F.trim(F.get("_labels", F.col("_pos"))), F.lit("")).alias("term_label"),
        "mapping_category",
    )


def terms_by_concept(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("concept_id").agg(F.sort_array(F.collect_set("term_id")).alias("terms"))


def concepts_by_term(mapping: DataFrame) -> DataFrame:
    """Pairs rather than arrays: a broad term may cover any number of concepts."""
    return mapping.select("term_id", "concept_id").distinct()


def coverage_stats(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    mapped = mapping.select("concept_id").distinct().withColumn("_m", F.lit(1))
    flags = concepts.select("concept_id").distinct().join(mapped, "concept_id", "left")
    total, hit = F.count(F.lit(1)), F.count("_m")
    return flags.agg(
        total.alias("n_total"),
        hit.alias("n_mapped"),
        (total - hit).alias("n_unmapped"),
        F.when(total > 0, F.lit(100.0) * hit / total).otherwise(0.0).alias("pct_mapped"),
    )


def unmapped_concepts(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    return concepts.select("concept_id").distinct().join(mapping.select("concept_id").distinct(), "concept_id", "left_anti")


def coverage_report(events: DataFrame, cohort: DataFrame, mapping: DataFrame) -> DataFrame:
    """Patients and records per concept inside the acute window, with a mapped flag.

    Records are summed per (person, day, concept) before the join with the cohort.
    """
    daily = events.groupBy("person_id", "concept_id", "event_date").agg(F.count(F.lit(1)).alias("_n"))
    inside = daily.join(cohort.select("person_id", "acute_start", "acute_end"), "person_id").where(
        F.col("event_date").between(F.col("acute_start"), F.col("acute_end"))
    )
    per_person = inside.groupBy("concept_id", "person_id").agg(F.sum("_n").alias("_n"))
    per_concept = per_person.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n_patients"), F.sum("_n").alias("n_records")
    )
    mapped = mapping.select("concept_id").distinct().withColumn("_m", F.lit(1))
    return per_concept.join(mapped, "concept_id", "left").select(
        "concept_id", "n_patients", "n_records", F.col("_m").isNotNull().cast("int").alias("is_mapped")
    )


def top_unmapped(report: DataFrame, n: int = 50) -> DataFrame:
    """The report's list of the most frequent unmapped concepts."""
    return report.where(F.col("is_mapped") == 0).orderBy(F.desc("n_patients"), "concept_id").limit(n)


def coverage_totals(report: DataFrame) -> DataFrame:
    """Totals over concepts; a patient with several concepts counts once per concept."""
    mapped = F.col("is_mapped") == 1
    return report.agg(
        F.count(F.lit(1)).alias("n_concepts"),
        F.count_if(mapped).alias("n_concepts_mapped"),
        F.coalesce(F.sum("n_patients"), F.lit(0)).alias("patient_concepts"),
        F.coalesce(F.sum(F.when(mapped, F.col("n_patients"))), F.lit(0)).alias("patient_concepts_mapped"),
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"),
        F.coalesce(F.sum(F.when(mapped, F.col("n_records"))), F.lit(0)).alias("n_records_mapped"),
    )


# Ontology roots expected below each mechanism.
MECHANISM_ROOTS = {
    "viral": ("HP:0002721", "HP:0031035", "HP:0002633"),
    "immuno": ("HP:0002960", "HP:0012649", "HP:0001875", "HP:0011893"),
    "endo": ("HP:0001907", "HP:0003256", "HP:0001626"),
}


def cross_check_routing(pairs: DataFrame, mapping: DataFrame, roots: Sequence[str], mechanism: str) -> DataFrame:
    """``pairs`` is (indicator, concept_id); tells whether a mapped term is one of the roots."""
    terms = terms_by_concept(mapping)
    expected = F.array(*[F.lit(r) for r in sorted(roots)]) if roots else F.array().cast("array<string>")
    found = F.coalesce(F.col("terms"), F.array().cast("array<string>"))
    return pairs.join(terms, "concept_id", "left").select(
        "indicator",
        "concept_id",
        F.lit(mechanism).alias("mechanism"),
        F.array_join(found, "; ").alias("terms"),
        F.lit("; ".join(sorted(roots))).alias("expected"),
        (F.size(F.array_intersect(found, expected)) > 0).cast("int").alias("direct_match"),
    )


def audit_availability(events: DataFrame, membership: DataFrame, cohort: DataFrame, numeric_only: bool = True) -> DataFrame:
    """Per concept set: cohort members with a usable row, their share, and a sparse flag below 1 %."""
    usable = events.where(F.col("value").isNotNull()) if numeric_only else events
    people = cohort.select("person_id").distinct()
    # Person x concept pairs are collapsed before any join.
    pairs = usable.select("person_id", "concept_id").distinct()
    found = (
        lookup_join(pairs, membership.select("set_id", "concept_id").distinct(), ["concept_id"], ["person_id"])
        .select("set_id", "person_id")
        .distinct()
        .join(people, "person_id", "left_semi")
        .groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("n_persons"))
    )
    size = people.agg(F.count(F.lit(1)).alias("_size"))
    every = membership.select("set_id").distinct().join(found, "set_id", "left").withColumn("_size", size.scalar())
    share = F.lit(100.0) * F.coalesce(F.col("n_persons"), F.lit(0)) / F.col("_size")
    return every.select(
        "set_id",
        F.coalesce("n_persons", F.lit(0)).alias("n_persons"),
        share.alias("pct_persons"),
        (share < 1.0).cast("int").alias("is_sparse"),
    )
