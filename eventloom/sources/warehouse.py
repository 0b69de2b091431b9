"""Readers for the event warehouse, vocabulary and ontology map."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COHORT_SCHEMA, DOMAINS, DomainSpec, to_events

PERSON_TABLES = ("person", "death", "observation_period", "payer_plan_period", "provider", "care_site")
VOCABULARY_TABLES = ("concept", "concept_ancestor")
MAP_SCHEMA = "concept_id BIGINT, ontology_id STRING, ontology_label STRING, mapping_category STRING"


def read_events(spark: SparkSession, path: str, domain: str, spec: DomainSpec | None = None) -> DataFrame:
    """Scan one event table; only the columns used later are read from disk."""
    spec = spec or DOMAINS[domain]
    return to_events(spark.read.parquet(f"{path}/{spec.table}"), domain, spec)


def read_all_events(spark: SparkSession, path: str, domains: Iterable[str] = DOMAINS) -> DataFrame:
    frames = [read_events(spark, path, d) for d in domains]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Person-level or vocabulary tables with lower-cased column names."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        out[name] = df.toDF(*[c.lower() for c in df.columns])
    return out


def death_dates(death: DataFrame) -> DataFrame:
    """First death date per person; the table may hold ``death_date`` or ``death_datetime``."""
    present = [c for c in ("death_date", "death_datetime") if c in death.columns]
    if not present:
        raise ValueError("death table has neither death_date nor death_datetime")
    when = F.coalesce(*[F.to_date(c) for c in present])
    return death.where(when.isNotNull()).groupBy("person_id").agg(F.min(when).alias("death_date"))


def load_cohort(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored cohort: check columns, cast to the schema, refuse windows that end before they start."""
    raw = spark.read.parquet(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    missing = {"person_id", "acute_start", "acute_end"} - set(raw.columns)
    if missing:
        raise ValueError(f"cohort lacks {sorted(missing)}")
    types = {f.name: f.dataType for f in COHORT_SCHEMA.fields}
    df = raw.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])
    bad = df.where(F.col("acute_start") > F.col("acute_end")).select("person_id").limit(10).collect()
    if bad:
        raise ValueError(f"window starts after it ends, e.g. persons {[r.person_id for r in bad]}")
    return df


def read_ontology_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, configs: dict[str, list[str]], extra: Iterable[str] = ()) -> DataFrame:
    """Read only the union of the columns that the configurations need.

    Presence is tested on the schema, so no data is touched for it.
    """
    df = spark.read.parquet(path)
    present = set(df.columns)
    wanted = dict.fromkeys(["person_id", *extra])
    for cols in configs.values():
        wanted.update(dict.fromkeys(cols))
    missing = [c for c in wanted if c not in present]
    if missing:
        raise ValueError(f"matrix lacks {missing[:10]}")
    return df.select(*wanted)
