"""The supplied tables in the roles of an event warehouse.

Stream domain: ``events`` are measurements of 30 days.  Order domain: orders are
visits, order lines are drugs, conditions, procedures and observations.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators.concepts import Vocabulary
from ..schema import CONDITION, DRUG, EVENT_SCHEMA, MEASUREMENT, OBSERVATION, PROCEDURE, VISIT

POS, NEG = 901, 902
EVENT_TYPES = {"view": 1, "signup": 2, "purchase": 3, "error": 4, "click": 5}
STREAM_WINDOWS = ((0, 5), (0, 10), (0, 15), (5, 10), (10, 20))
STREAM_LABELS = tuple(f"w{a}_{b}" for a, b in STREAM_WINDOWS)
ORDER_WINDOWS = ((0, 21), (0, 30), (0, 60), (0, 90), (30, 60), (60, 90))
INPATIENT = (2, 3)
OUTCOME_DAYS = 90
BRAND, TYPE, NATION, REGION, SUPPLIER = 1_000_000, 2_000_000, 3_000_000, 4_000_000, 5_000_000
CUTOFF = "2001-12-31"


def canonical(df: DataFrame, domain: str, **roles) -> DataFrame:
    """Fill the canonical event columns from expressions; the rest is null."""
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in roles.items()}
    exprs["domain"] = F.lit(domain)
    return df.select(*[exprs.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])


def pair(df: DataFrame, up, down) -> DataFrame:
    return df.select(up.cast("long").alias("ancestor_concept_id"), down.cast("long").alias("descendant_concept_id"))


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # ------------------------------------------------------------------ stream domain

    @cached_property
    def stream(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        code = F.lit(None)
        for name, number in EVENT_TYPES.items():
            code = F.when(F.col("event_type") == name, number).otherwise(code)
        rows = self.table("events").withColumn("k", k)
        kk = F.col("k")
        return canonical(
            rows, MEASUREMENT, person_id="user_id", event_id="event_id", concept_id=code, event_date=F.to_date("ts"),
            value="value",
            value_concept_id=F.when(kk % 10 == 0, None).when(kk % 3 == 0, NEG).otherwise(POS),
            value_text=F.when(kk % 20 == 0, "Not detected").when(kk % 10 == 0, "Detected"),
            range_high=F.when(kk % 2 == 0, 50.0),
            source_text=F.concat("event_type", F.lit(":"), F.col("k")),
            source_concept_id=F.when(kk % 7 == 0, None).otherwise(kk % 3),
        )

    @cached_property
    def stream_concepts(self) -> DataFrame:
        """Vocabulary of the stream: the event types found in the data."""
        types = self.table("events").select("event_type").distinct()
        code = F.lit(None)
        for name, number in EVENT_TYPES.items():
            code = F.when(F.col("event_type") == name, number).otherwise(code)
        return types.select(
            code.cast("long").alias("concept_id"), F.col("event_type").alias("concept_name"),
            F.upper("event_type").alias("concept_code"), F.lit("LOINC").alias("vocabulary_id"),
            F.lit("Measurement").alias("domain_id"), F.lit("S").alias("standard_concept"), F.lit("Item").alias("concept_class_id"),
        )

    @cached_property
    def stream_vocabulary(self) -> Vocabulary:
        ids = self.stream_concepts.select(
            F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_id").alias("descendant_concept_id")
        )
        return Vocabulary(self.stream_concepts, ids)

    @cached_property
    def stream_index(self) -> DataFrame:
        return C.first_event(self.stream, [EVENT_TYPES["signup"]], "index_date")

    @cached_property
    def stream_cohort(self) -> DataFrame:
        """First signup is the index; the first error above 80 at least 5 days later is the outcome."""
        outcome = C.first_event(self.stream.where("value > 80"), [EVENT_TYPES["error"]], "first_outcome_date")
        df = C.label_outcome(self.stream_index, outcome, 5)
        return df.withColumn("acute_start", F.col("index_date")).withColumn("acute_end", F.date_add("index_date", 10))

    # ------------------------------------------------------------------ order domain

    @cached_property
    def visits(self) -> DataFrame:
        orders = self.table("orders").join(
            self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        )
        start = F.to_date("o_orderdate")
        stay = (F.col("o_orderkey") % 12).cast("int")
        return canonical(
            orders, VISIT, person_id="o_custkey", event_id="o_orderkey",
            concept_id=F.substring("o_orderpriority", 1, 1).cast("long"), event_date=start,
            end_date=F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.date_add(start, stay)),
            provider_id=F.col("o_orderkey") % 10, site_id="c_nationkey",
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    def _lines(self, flag: str | None, domain: str, concept, text, value=None) -> DataFrame:
        rows = self.lines if flag is None else self.lines.where(F.col("l_returnflag") == flag)
        extra = {} if value is None else {"value": value}
        return canonical(
            rows, domain, person_id="o_custkey", event_id=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
            concept_id=concept, event_date=F.to_date("l_shipdate"), source_text=text, **extra,
        )

    @cached_property
    def conditions(self) -> DataFrame:
        text = F.concat("l_linestatus", F.lit(":"), F.col("l_suppkey"))
        return self._lines("R", CONDITION, F.col("l_suppkey") + SUPPLIER, text)

    @cached_property
    def procedures(self) -> DataFrame:
        return self._lines("A", PROCEDURE, F.col("l_partkey"), F.concat("l_linestatus", F.lit(":"), F.col("l_linenumber")))

    @cached_property
    def observations(self) -> DataFrame:
        text = F.concat("l_linestatus", F.lit(":"), F.col("l_linenumber"))
        return self._lines("N", OBSERVATION, F.col("l_partkey"), text, F.when(F.col("l_quantity") > 10, F.col("l_quantity")))

    @cached_property
    def drugs(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_name")
        rows = self.lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return canonical(
            rows, DRUG, person_id="o_custkey", event_id=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
            concept_id="l_partkey", event_date=F.to_date("l_shipdate"), source_text="p_name",
        )

    @cached_property
    def concepts(self) -> DataFrame:
        def rows(df, cid, name, code, vocabulary, domain, cls):
            return df.select(
                cid.cast("long").alias("concept_id"), F.col(name).alias("concept_name"), F.col(code).alias("concept_code"),
                F.lit(vocabulary).alias("vocabulary_id"), F.lit(domain).alias("domain_id"), F.lit("S").alias("standard_concept"),
                F.lit(cls).alias("concept_class_id"),
            ).distinct()

        part, kinds = self.table("part"), self.part_types
        return (
            rows(part, F.col("p_partkey"), "p_name", "p_brand", "PART", "Drug", "Item")
            .unionByName(rows(part, F.lit(BRAND) + F.substring("p_brand", 7, 9).cast("long"), "p_brand", "p_brand", "PART", "Drug", "Ingredient"))
            .unionByName(rows(kinds, F.col("type_id"), "p_type", "p_type", "PART", "Drug", "Class"))
            .unionByName(rows(self.table("supplier"), F.col("s_suppkey") + SUPPLIER, "s_name", "s_name", "SUPP", "Condition", "Item"))
            .unionByName(rows(self.table("nation"), F.col("n_nationkey") + NATION, "n_name", "n_name", "SUPP", "Condition", "Class"))
            .unionByName(rows(self.table("region"), F.col("r_regionkey") + REGION, "r_name", "r_name", "SUPP", "Condition", "Class"))
        )

    @cached_property
    def part_types(self) -> DataFrame:
        """Part type classes numbered by name; rank = number of names up to it (a handful of rows)."""
        names = self.table("part").select("p_type").distinct()
        other = names.select(F.col("p_type").alias("_o"))
        lists = other.agg(F.sort_array(F.collect_set("_o")).alias("_all"))
        return names.withColumn("type_id", F.lit(TYPE) + F.array_position(lists.scalar(), F.col("p_type")))

    @cached_property
    def brand_of_part(self) -> DataFrame:
        return pair(self.table("part"), F.lit(BRAND) + F.substring("p_brand", 7, 9).cast("long"), F.col("p_partkey"))

    @cached_property
    def ancestors(self) -> DataFrame:
        part = self.table("part").join(self.part_types, "p_type")
        supplier = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        own = pair(self.concepts, F.col("concept_id"), F.col("concept_id"))
        return (
            own.unionByName(self.brand_of_part)
            .unionByName(pair(part, F.col("type_id"), F.col("p_partkey")))
            .unionByName(pair(supplier, F.col("n_nationkey") + NATION, F.col("s_suppkey") + SUPPLIER))
            .unionByName(pair(supplier, F.col("n_regionkey") + REGION, F.col("s_suppkey") + SUPPLIER))
            .unionByName(pair(self.table("nation"), F.col("n_regionkey") + REGION, F.col("n_nationkey") + NATION))
        )

    @cached_property
    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.concepts, self.ancestors)

    @cached_property
    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("person_id"), F.date_add(F.lit("1940-01-01").cast("date"), (key * 37 % 20000).cast("int")).alias("birth_date"),
            F.when(key % 3 == 0, 8507).when(key % 3 == 1, 8532).otherwise(0).cast("long").alias("gender_concept_id"),
            (F.lit(NATION) + F.col("c_nationkey")).cast("long").alias("race_concept_id"),
            (F.lit(REGION) + key % 5).cast("long").alias("ethnicity_concept_id"),
        )

    @cached_property
    def periods(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("period_start"), F.to_date("o_orderdate").alias("period_end")
        )

    @cached_property
    def deaths(self) -> DataFrame:
        poor = self.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("person_id"))
        last = self.periods.groupBy("person_id").agg(F.max("period_end").alias("_l"))
        return last.join(poor, "person_id").select("person_id", F.date_add("_l", 30).alias("death_date"))

    @cached_property
    def plans(self) -> DataFrame:
        first = self.periods.groupBy("person_id").agg(F.min("period_start").alias("plan_start"), F.max("period_end").alias("_e"))
        rows = first.join(self.table("customer"), F.col("person_id") == F.col("c_custkey"))
        return rows.select(
            "person_id", F.col("c_mktsegment").alias("payer"), "plan_start",
            F.when(F.col("person_id") % 2 == 0, None).otherwise(F.col("_e")).alias("plan_end"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("provider_id"), (F.col("s_nationkey") + NATION).cast("long").alias("specialty_concept_id"),
            F.col("s_name").alias("specialty_source_value"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("site_id"), F.col("n_name").alias("site_name"))

    @cached_property
    def ontology_raw(self) -> DataFrame:
        key = F.col("p_partkey")

        def term(shift):
            return F.concat(F.lit("HP_"), F.lpad(((key + shift) % 40).cast("string"), 7, "0"))

        return self.table("part").select(
            key.alias("concept_id"), F.concat(term(0), F.lit(" | "), term(7), F.lit(" | XX_1")).alias("ontology_id"),
            F.concat(F.col("p_name"), F.lit(" | "), F.col("p_type")).alias("ontology_label"),
            F.when(F.col("p_size") > 10, "Manual One-to-One Concept").otherwise("Unmapped").alias("mapping_category"),
        )

    # ------------------------------------------------------------------ cohort of the order domain

    @cached_property
    def outcome(self) -> DataFrame:
        return (
            self.table("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("person_id"))
            .agg(F.min(F.to_date("o_orderdate")).alias("first_outcome_date"))
        )

    @cached_property
    def index(self) -> DataFrame:
        return C.first_event(self.visits, [1], "index_date")

    @cached_property
    def labelled(self) -> DataFrame:
        return C.label_outcome(self.index, self.outcome, OUTCOME_DAYS)

    @cached_property
    def setting(self) -> DataFrame:
        return C.classify_setting(self.labelled, self.visits, INPATIENT)

    @cached_property
    def acute(self) -> DataFrame:
        return C.acute_window(self.setting, 21)

    @cached_property
    def extent(self) -> DataFrame:
        return C.observation_extent(self.periods)

    @cached_property
    def followed(self) -> DataFrame:
        cutoff = C.robust_cutoff(self.extent, "obs_end")
        return C.death_and_followup(self.acute, self.deaths, self.extent, cutoff, 90)

    @cached_property
    def cohort(self) -> DataFrame:
        return C.demographics(self.followed, self.person)

    # ------------------------------------------------------------------ evaluation domain

    @cached_property
    def results(self) -> DataFrame:
        """Events grouped to (config, window, iteration) rows with a metric each."""
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        key = [
            F.col("event_type").alias("config"), F.concat(F.lit("w"), (F.col("k") % 6).cast("string")).alias("feature_window"),
            (F.col("user_id") % 100).cast("int").alias("iteration"),
        ]
        return e.groupBy(*key).agg(
            (F.avg("value") / 499).alias("auroc"), (F.max("value") / 997).alias("auprc")
        ).withColumn("seed", F.lit(42) + F.col("iteration").cast("long") * 1000)

    @cached_property
    def predictions(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
            F.col("l_linenumber").alias("seed"), (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
            ((F.col("l_extendedprice") % 1000 + 1) / 1002).alias("p_raw"),
        )
