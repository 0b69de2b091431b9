"""Binary person x window indicators, all kinds and all windows in one pass over the events.

Plan shape: events (one scan per domain) -> membership (size-checked lookup) and
inline text match -> one row per (person, indicator, day) by a map-side combined
aggregation -> join with the cohort -> windows -> one ordered pass per (person,
window, indicator).  Everything after the daily aggregation is bounded by days
and specifications, however many rows one person has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import decode_result, has_any_value, ilike_any, is_elevated
from ..functions.skew import literal_table, lookup_join
from ..schema import CONDITION, DRUG, MEASUREMENT, OBSERVATION, PROCEDURE, VISIT
from .concepts import ConceptSpec, Vocabulary, known_size, resolve_all
from .windows import Window, cohort_windows, explode_matching, with_windows, within_cohort_dates

# kind -> (domain, reads source text, gate)
KINDS = {
    "MEAS_ANY_RECORDED": (MEASUREMENT, True, "spec"),
    "MEAS_NUMERIC_ANY": (MEASUREMENT, True, "numeric"),
    "MEAS_NUMERIC_THRESHOLD": (MEASUREMENT, True, "threshold"),
    "MEAS_ELEVATED_OR_ANY": (MEASUREMENT, True, "elevated_or_any"),
    "MEAS_PAIRED_SAME_DATE_NUMERIC": (MEASUREMENT, False, "paired"),
    "MEAS_REPEAT_AT_LEAST_N": (MEASUREMENT, True, "open"),
    "MEAS_ELEV_EPISODES_GAP": (MEASUREMENT, True, "elevated"),
    "MEAS_PERSISTENT_POSITIVITY": (MEASUREMENT, False, "decode"),
    "OBS_ANY_RECORDED": (OBSERVATION, True, "spec_text"),
    "MEAS_OR_OBS_ANY": (MEASUREMENT, True, "any"),
    "COND_ANY_RECORDED": (CONDITION, True, "open"),
    "COND_EPISODES_GAP": (CONDITION, True, "open"),
    "COND_NAME_PATTERN": (CONDITION, False, "open"),
    "PROC_ANY_RECORDED": (PROCEDURE, True, "open"),
    "PROC_NAME_PATTERN": (PROCEDURE, False, "open"),
    "DRUG_ANY_RECORDED": (DRUG, True, "open"),
    "DRUG_INGREDIENT_DESC": (DRUG, True, "open"),
    "DRUG_REPEAT_AT_LEAST_N": (DRUG, True, "open"),
    "DRUG_EPISODES_GAP": (DRUG, False, "open"),
    "VISIT_SPECIALTY_NAME": (VISIT, False, "open"),
}
EPISODE_KINDS = ("MEAS_ELEV_EPISODES_GAP", "COND_EPISODES_GAP", "DRUG_EPISODES_GAP")
REPEAT_KINDS = ("MEAS_REPEAT_AT_LEAST_N", "DRUG_REPEAT_AT_LEAST_N")


@dataclass(frozen=True)
class IndicatorSpec:
    name: str
    kind: str
    concepts: tuple[ConceptSpec, ...] = ()
    left: tuple[ConceptSpec, ...] = ()
    right: tuple[ConceptSpec, ...] = ()
    observation_ids: tuple[int, ...] = ()
    text: tuple[str, ...] = ()
    specialties: tuple[str, ...] = ()
    values: tuple[int, ...] = ()
    positive: tuple[int, ...] = ()
    negative: tuple[int, ...] = ()
    any_value: bool = False
    numeric: bool = False
    threshold: float | None = None
    gap: int | None = None
    min_n: int | None = None
    min_day: int | None = None
    anchored: bool = False
    constant_zero: bool = False
    group: str = ""
    label: str = field(default="", compare=False)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if self.constant_zero:
            return
        needs = {
            "MEAS_NUMERIC_THRESHOLD": self.threshold is not None,
            "MEAS_PAIRED_SAME_DATE_NUMERIC": bool(self.left and self.right),
            "MEAS_PERSISTENT_POSITIVITY": bool(self.concepts and self.positive and self.negative),
            "VISIT_SPECIALTY_NAME": bool(self.specialties),
            "COND_NAME_PATTERN": any(c.names for c in self.concepts),
            "PROC_NAME_PATTERN": any(c.names for c in self.concepts),
            "DRUG_INGREDIENT_DESC": any(c.ingredients for c in self.concepts),
            "DRUG_REPEAT_AT_LEAST_N": self.min_n is not None and any(c.ingredients for c in self.concepts),
            "DRUG_EPISODES_GAP": any(c.ingredients for c in self.concepts),
            "MEAS_REPEAT_AT_LEAST_N": self.min_n is not None,
        }
        if not needs.get(self.kind, True):
            raise ValueError(f"{self.name}: incomplete {self.kind}")
        if self.kind in EPISODE_KINDS and (not self.gap or self.gap < 1 or self.min_n is None):
            raise ValueError(f"{self.name}: {self.kind} needs a gap of at least a day and min_n")

    @property
    def gate(self) -> str:
        gate = KINDS[self.kind][2]
        if gate in ("spec", "spec_text"):
            if self.numeric:
                return "numeric"
            if self.any_value:
                return "any_text" if gate == "spec_text" else "any"
            return "open"
        return gate

    @property
    def is_unfiltered(self) -> bool:
        """Neither concepts nor text: every row of the domain qualifies."""
        reads_text = KINDS[self.kind][1]
        return reads_text and not self.concepts and not self.text

    @property
    def with_values(self) -> tuple[int, ...]:
        """The value list counts for recorded and repeated results only."""
        return self.values if self.kind in ("MEAS_ANY_RECORDED", "MEAS_REPEAT_AT_LEAST_N") else ()


_PARAMS = (
    "indicator STRING, kind STRING, gate STRING, vals ARRAY<BIGINT>, threshold DOUBLE, gap INT, min_n INT, "
    "min_day INT, anchored BOOLEAN"
)


def _parameters(specs: Sequence[IndicatorSpec]) -> list[tuple]:
    return [
        (
            s.name, s.kind, s.gate, [int(v) for v in s.with_values] or None,
            None if s.threshold is None else float(s.threshold), s.gap, s.min_n, s.min_day, s.anchored,
        )
        for s in specs
    ]


def membership(vocabulary: Vocabulary, specs: Sequence[IndicatorSpec]) -> tuple[DataFrame, int | None]:
    """``(domain, concept_id, hits)`` with ``hits`` the array of (indicator, role).

    The second value bounds the number of rows where all sets are plain ids.
    """
    sets: dict[str, list[ConceptSpec]] = {}
    for s in specs:
        domain = KINDS[s.kind][0]
        for role, parts in (("main", s.concepts), ("left", s.left), ("right", s.right)):
            if parts:
                sets[f"{domain}|{s.name}|{role}"] = list(parts)
        if s.observation_ids:
            sets[f"{OBSERVATION}|{s.name}|main"] = [ConceptSpec(ids=s.observation_ids)]
    pairs = resolve_all(vocabulary, sets)
    part = F.split("set_id", r"\|")
    table = pairs.groupBy(part[0].alias("domain"), "concept_id").agg(
        F.collect_set(F.struct(part[1].alias("indicator"), part[2].alias("role"))).alias("hits")
    )
    return table, known_size(sets)


_HIT = "array<struct<indicator:string,role:string>>"


def _text_hits(specs: Sequence[IndicatorSpec]) -> Column | None:
    """Indicators whose text patterns match the row, evaluated in place (no shuffle of texts)."""
    tests = []
    for s in specs:
        domain, reads_text, _ = KINDS[s.kind]
        if s.is_unfiltered:
            condition = F.col("domain") == domain
        elif reads_text and s.text:
            condition = (F.col("domain") == domain) & ilike_any("source_text", s.text)
        else:
            continue
        tests.append(F.when(condition, F.struct(F.lit(s.name).alias("indicator"), F.lit("main").alias("role"))))
    if not tests:
        return None
    return F.filter(F.array(*tests), lambda h: h.isNotNull()).cast(_HIT)


def _specialty_hits(events, specs, providers, sites, vocabulary) -> DataFrame:
    """Visits by provider specialty (concept name or source text) or by site name."""
    wanted = [s for s in specs if s.kind == "VISIT_SPECIALTY_NAME"]

    def matches(columns):
        tests = [
            F.when(
                F.coalesce(ilike_any(columns[0], s.specialties), F.lit(False))
                | (F.coalesce(ilike_any(columns[1], s.specialties), F.lit(False)) if len(columns) > 1 else F.lit(False)),
                F.struct(F.lit(s.name).alias("indicator"), F.lit("main").alias("role")),
            )
            for s in wanted
        ]
        return F.filter(F.array(*tests), lambda h: h.isNotNull()).cast(_HIT)

    names = vocabulary.concept.select(F.col("concept_id").alias("specialty_concept_id"), "concept_name")
    by_provider = (
        providers.join(names, "specialty_concept_id", "left")
        .select("provider_id", matches(["concept_name", "specialty_source_value"]).alias("_p"))
        .where(F.size("_p") > 0)
    )
    by_site = sites.select("site_id", matches(["site_name"]).alias("_s")).where(F.size("_s") > 0)
    visits = events.where(F.col("domain") == VISIT)
    visits = lookup_join(visits, by_provider, ["provider_id"], ["event_id"], "left")
    visits = lookup_join(visits, by_site, ["site_id"], ["event_id"], "left")
    none = F.array().cast(_HIT)
    return visits.withColumn("_hits", F.array_union(F.coalesce("_p", none), F.coalesce("_s", none))).drop("_p", "_s")


def daily_hits(
    events: DataFrame,
    specs: Sequence[IndicatorSpec],
    vocabulary: Vocabulary,
    providers: DataFrame | None = None,
    sites: DataFrame | None = None,
) -> DataFrame:
    """One row per (person, indicator, day) with everything the kinds need."""
    specs = [s for s in specs if not s.constant_zero]
    coded = [s for s in specs if s.kind != "VISIT_SPECIALTY_NAME"]
    frames = []
    if coded:
        domains = {KINDS[s.kind][0] for s in coded} | ({OBSERVATION} if any(s.observation_ids for s in coded) else set())
        rows = events.where(F.col("domain").isin(*sorted(domains)))
        texts = _text_hits(coded)
        members, known = membership(vocabulary, coded)
        none = F.array().cast(_HIT)
        if texts is None:
            rows = lookup_join(rows, members, ["domain", "concept_id"], ["event_id"], known_rows=known)
            rows = rows.withColumn("_hits", F.col("hits").cast(_HIT))
        else:
            rows = lookup_join(rows, members, ["domain", "concept_id"], ["event_id"], "left", known_rows=known)
            hits = F.coalesce(F.col("hits").cast(_HIT), none)
            twice = [s.name for s in coded if s.kind == "DRUG_REPEAT_AT_LEAST_N" and s.text]
            # A repeated-drug row that matches by concept and by text counts twice; elsewhere once.
            extra = F.filter(texts, lambda h: h["indicator"].isin(*twice) | ~F.array_contains(hits, h)) if twice else texts
            rows = rows.withColumn("_hits", F.concat(hits, extra) if twice else F.array_union(hits, extra))
        frames.append(rows.drop("hits"))
    if len(coded) < len(specs):
        if providers is None or sites is None:
            raise ValueError("visit specialty indicators need providers and sites")
        frames.append(_specialty_hits(events, specs, providers, sites, vocabulary))
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    params = literal_table(events.sparkSession, _parameters(specs), _PARAMS).select(
        "indicator", "gate", "vals", "threshold"
    )
    decoders: dict[tuple, list[str]] = {}
    for s in specs:
        if s.kind == "MEAS_PERSISTENT_POSITIVITY":
            decoders.setdefault((s.positive, s.negative), []).append(s.name)
    decoded = F.lit(None).cast("int")
    for (positive, negative), names in decoders.items():
        decoded = F.when(F.col("indicator").isin(*names), decode_result(positive, negative)).otherwise(decoded)

    numeric = F.col("value").isNotNull()
    passes = (
        F.when(F.col("gate") == "numeric", numeric)
        .when(F.col("gate") == "any", F.when(F.col("domain") == OBSERVATION, has_any_value(True)).otherwise(has_any_value()))
        .when(F.col("gate") == "any_text", has_any_value(True))
        .when(F.col("gate") == "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))
        .when(F.col("gate") == "elevated_or_any", is_elevated())
        .when(F.col("gate") == "elevated", is_elevated(count_concept_values=False))
        .when(F.col("gate").isin("paired", "decode"), F.lit(False))
        .otherwise(F.lit(True))
    )
    listed = F.col("vals").isNull() | F.coalesce(F.array_contains("vals", F.col("value_concept_id")), F.lit(False))
    paired = (F.col("gate") == "paired") & numeric
    flags = (
        rows.withColumn("_hit", F.explode("_hits"))
        .withColumn("indicator", F.col("_hit.indicator"))
        .join(params, "indicator")
        .select(
            "person_id",
            "indicator",
            "event_date",
            (passes & listed).cast("int").alias("n"),
            F.coalesce((decoded == 1).cast("int"), F.lit(0)).alias("n_pos"),
            F.coalesce((decoded == 0).cast("int"), F.lit(0)).alias("n_neg"),
            (paired & (F.col("_hit.role") == "left") & (F.col("value") > 0)).cast("int").alias("left"),
            (paired & (F.col("_hit.role") == "right")).cast("int").alias("right"),
        )
        .where(F.expr("n + n_pos + n_neg + left + right > 0"))
    )
    return flags.groupBy("person_id", "indicator", "event_date").agg(
        F.sum("n").alias("n"),
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        F.max("left").alias("left"),
        F.max("right").alias("right"),
    )


def indicator_hits(
    events: DataFrame,
    cohort: DataFrame,
    windows: Sequence[Window],
    specs: Sequence[IndicatorSpec],
    vocabulary: Vocabulary,
    providers: DataFrame | None = None,
    sites: DataFrame | None = None,
    min_episode_window: int = 60,
) -> DataFrame:
    """Long result ``(person_id, window, indicator)``: one row per indicator that is 1.

    Elevated-episode indicators are left out of windows shorter than
    ``min_episode_window`` days.
    """
    daily = daily_hits(within_cohort_dates(events, cohort, windows), specs, vocabulary, providers, sites)
    params = literal_table(events.sparkSession, _parameters(specs), _PARAMS).select(
        "indicator", "kind", "gap", "min_n", "min_day", "anchored"
    )
    windowed = explode_matching(daily.join(with_windows(cohort, windows), "person_id")).join(params, "indicator")
    windowed = windowed.where(
        (F.col("kind") != "MEAS_ELEV_EPISODES_GAP") | (F.col("w_end") - F.col("w_start") >= min_episode_window)
    )
    key = ["person_id", "window", "indicator"]
    # most kinds need sums and maxima only; those with episodes or runs go through the ordered pass
    in_order = F.col("kind").isin(*EPISODE_KINDS, "MEAS_PERSISTENT_POSITIVITY")
    plain = windowed.where(~in_order).groupBy(*key, "kind", "min_n").agg(
        F.sum("n").alias("n"), F.lit(0).cast("long").alias("episodes"), F.max(F.col("left") * F.col("right")).alias("paired"), F.lit(0).alias("persistent")
    )
    windowed = windowed.where(in_order)
    by_day = W.partitionBy(*key).orderBy("event_date")
    previous = F.lag(F.when(F.col("n") > 0, F.col("event_date"))).over(by_day)
    starts = F.when(
        (F.col("n") > 0)
        & (F.col("_prev").isNull() | (F.col("event_date") >= F.expr("date_add(_prev, gap)"))),
        1,
    ).otherwise(0)
    # Negatives of a day come before its positives, so a day's negatives close the run first.
    ordered = windowed.withColumn("_prev", previous).withColumn(
        "_run", F.sum("n_neg").over(by_day.rowsBetween(W.unboundedPreceding, 0))
    )
    runs = ordered.withColumn("_start", starts).groupBy(*key, "kind", "min_n", "min_day", "anchored", "_run").agg(
        F.sum("n").alias("n"),
        F.sum("_start").alias("episodes"),
        F.sum("n_pos").alias("n_pos"),
        F.max(F.when(F.col("n_pos") > 0, F.col("day_in"))).alias("last_pos_day"),
        F.max(F.col("left") * F.col("right")).alias("paired"),
    )
    enough = F.when(F.col("anchored"), (F.col("_run") == 0) & (F.col("n_pos") >= 1)).otherwise(F.col("n_pos") >= 2)
    late = F.col("min_day").isNull() | (F.col("last_pos_day") >= F.col("min_day"))
    per_key = runs.groupBy(*key, "kind", "min_n").agg(
        F.sum("n").alias("n"),
        F.sum("episodes").alias("episodes"),
        F.max("paired").alias("paired"),
        F.max((enough & late).cast("int")).alias("persistent"),
    )
    ordered_kinds = any(s.kind in (*EPISODE_KINDS, "MEAS_PERSISTENT_POSITIVITY") for s in specs)
    plain_kinds = any(s.kind not in (*EPISODE_KINDS, "MEAS_PERSISTENT_POSITIVITY") for s in specs)
    per_key = per_key.unionByName(plain) if ordered_kinds and plain_kinds else per_key if ordered_kinds else plain
    hit = (
        F.when(F.col("kind").isin(*EPISODE_KINDS), F.col("episodes") >= F.col("min_n"))
        .when(F.col("kind").isin(*REPEAT_KINDS), F.col("n") >= F.col("min_n"))
        .when(F.col("kind") == "MEAS_PAIRED_SAME_DATE_NUMERIC", F.col("paired") > 0)
        .when(F.col("kind") == "MEAS_PERSISTENT_POSITIVITY", F.col("persistent") == 1)
        .otherwise(F.col("n") > 0)
    )
    return per_key.where(hit).select(*key)


def feature_name(spec: IndicatorSpec, window: str | None = None) -> str:
    parts = ["f_ind", spec.group, window, spec.name.lower()]
    return "_".join(p for p in parts if p)


def build_signals(
    hits: DataFrame, cohort: DataFrame, windows: Sequence[Window], specs: Sequence[IndicatorSpec]
) -> DataFrame:
    """Wide 0/1 table, one row per person and window; names follow the specifications."""
    names = {s.name: feature_name(s) for s in specs}
    every = cohort_windows(cohort, windows).select("person_id", "window")
    wide = hits.withColumn("_one", F.lit(1)).groupBy("person_id", "window").pivot("indicator", list(names)).agg(F.max("_one"))
    full = every.join(wide, ["person_id", "window"], "left")
    return full.select(
        "person_id", "window", *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(out) for n, out in names.items()]
    )


def regroup(specs: Sequence[IndicatorSpec], group: str) -> list[IndicatorSpec]:
    return [replace(s, group=group) for s in specs]


def by_name(specs: Sequence[IndicatorSpec]) -> Mapping[str, IndicatorSpec]:
    return {s.name: s for s in specs}
