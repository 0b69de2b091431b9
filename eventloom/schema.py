"""Canonical schemas and the column roles of the event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("concept_id", T.LongType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_concept_id", T.LongType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("range_high", T.DoubleType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("source_concept_id", T.LongType()),
        T.StructField("provider_id", T.LongType()),
        T.StructField("site_id", T.LongType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.names

COHORT_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("index_date", T.DateType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("is_inpatient", T.IntegerType()),
        T.StructField("acute_start", T.DateType()),
        T.StructField("acute_end", T.DateType()),
        T.StructField("discharge_date", T.DateType()),
        T.StructField("age_at_index", T.IntegerType()),
        T.StructField("gender_concept_id", T.LongType()),
        T.StructField("first_outcome_date", T.DateType()),
    ]
)

MEASUREMENT, OBSERVATION, CONDITION = "measurement", "observation", "condition"
PROCEDURE, DRUG, VISIT = "procedure", "drug", "visit"


@dataclass(frozen=True)
class DomainSpec:
    """Which column of a warehouse table plays which role of an event."""

    table: str
    event_id: str
    concept: str
    date: str
    source_text: str | None = None
    end_date: str | None = None
    value: str | None = None
    value_concept: str | None = None
    value_text: str | None = None
    range_high: str | None = None
    source_concept: str | None = None
    provider: str | None = None
    site: str | None = None


# Table and column names of the public OMOP common data model.
DOMAINS = {
    MEASUREMENT: DomainSpec(
        "measurement", "measurement_id", "measurement_concept_id", "measurement_date", "measurement_source_value",
        value="value_as_number", value_concept="value_as_concept_id", value_text="value_source_value",
        range_high="range_high", source_concept="measurement_source_concept_id",
    ),
    OBSERVATION: DomainSpec(
        "observation", "observation_id", "observation_concept_id", "observation_date", "observation_source_value",
        value="value_as_number", value_concept="value_as_concept_id", value_text="value_as_string",
    ),
    CONDITION: DomainSpec(
        "condition_occurrence", "condition_occurrence_id", "condition_concept_id", "condition_start_date",
        "condition_source_value",
    ),
    PROCEDURE: DomainSpec(
        "procedure_occurrence", "procedure_occurrence_id", "procedure_concept_id", "procedure_date",
        "procedure_source_value",
    ),
    DRUG: DomainSpec(
        "drug_exposure", "drug_exposure_id", "drug_concept_id", "drug_exposure_start_date", "drug_source_value"
    ),
    VISIT: DomainSpec(
        "visit_occurrence", "visit_occurrence_id", "visit_concept_id", "visit_start_date", "visit_source_value",
        end_date="visit_end_date", provider="provider_id", site="care_site_id",
    ),
}


def to_events(table: DataFrame, domain: str, spec: DomainSpec) -> DataFrame:
    """Project a warehouse table into the canonical event schema (a pure select)."""
    roles = {
        "person_id": "person_id", "event_id": spec.event_id, "concept_id": spec.concept, "event_date": spec.date,
        "end_date": spec.end_date, "value": spec.value, "value_concept_id": spec.value_concept,
        "value_text": spec.value_text, "range_high": spec.range_high, "source_text": spec.source_text,
        "source_concept_id": spec.source_concept, "provider_id": spec.provider, "site_id": spec.site,
    }
    present = {c.lower() for c in table.columns}

    def role(field: T.StructField):
        if field.name == "domain":
            return F.lit(domain).alias("domain")
        column = roles[field.name]
        source = F.col(column) if column and column.lower() in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return table.select(*[role(f) for f in EVENT_SCHEMA.fields])
