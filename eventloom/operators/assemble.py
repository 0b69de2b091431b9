"""Wide matrices, feature families and nested column configurations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.skew import literal_table
from ..session import materialise

PIVOT_WIDTH = 500
"""Columns per pivot; wider matrices use several pivots on the same key."""


# ------------------------------------------------------------------ long <-> wide


def to_long(wide: DataFrame, id_cols: Sequence[str] = ("person_id",), columns: Sequence[str] | None = None) -> DataFrame:
    """Unpivot feature columns to (ids, feature, value); null values are kept."""
    ids = list(id_cols)
    names = list(columns) if columns is not None else [c for c in wide.columns if c not in ids]
    cast = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return cast.unpivot(ids, names, "feature", "value")


def to_wide(long: DataFrame, features: Sequence[str], id_cols: Sequence[str] = ("person_id",)) -> DataFrame:
    """Pivot with an explicit list; chunks share the grouping key, so later joins are co-partitioned."""
    ids = list(id_cols)
    chunks = [features[i : i + PIVOT_WIDTH] for i in range(0, len(features), PIVOT_WIDTH)]
    out = None
    for chunk in chunks:
        part = long.groupBy(*ids).pivot("feature", list(chunk)).agg(F.first("value"))
        out = part if out is None else out.join(part, ids, "full_outer")
    return out


def _entries(block: DataFrame, places: Mapping[str, int], zero: set[str]) -> DataFrame:
    """(person_id, ``_e``): a block's row as the places and values of what is neither missing nor a filled 0."""
    cells = []
    for c in block.columns:
        if c != "person_id":
            value = F.col(f"`{c}`").cast("double")
            told = value.isNotNull() & (value != 0) if c in zero else value.isNotNull()
            cells.append(F.when(told, F.struct(F.lit(places[c]).alias("i"), value.alias("v"))))
    empty = F.array().cast("array<struct<i:int,v:double>>")
    return block.select("person_id", (F.array_compact(F.array(*cells)) if cells else empty).alias("_e"))


def join_blocks(cohort: DataFrame, blocks: Sequence[DataFrame], zero: Iterable[str] = ()) -> DataFrame:
    """One row per cohort member with the columns of all blocks, each in its own type.

    A block's row travels as one sparse list, so the exchange holds persons x blocks rows, whatever the number of
    columns; the lists of a person are put together in one aggregation and read out by a typed projection.  ``zero`` names
    the columns whose missing values mean 0.  A block has one row per person; of blocks that share a column the first value in order of the blocks counts.
    """
    zero = set(zero)
    types = {f.name: f.dataType for b in blocks for f in b.schema.fields if f.name != "person_id"}
    places = {c: i for i, c in enumerate(types)}
    rows = None
    for number, b in enumerate(blocks):
        part = _entries(b, places, zero).select("person_id", F.lit(number).alias("_b"), "_e")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return cohort.select("person_id")
    # as many rows a person as there are blocks
    lists = rows.groupBy("person_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_e"))), lambda x: x["_e"])).alias("_e"))
    shared = sum(len(b.columns) - 1 for b in blocks) > len(types)
    once = F.filter("_e", lambda x, k: F.array_position(F.transform("_e", lambda y: y["i"]), x["i"]) == k + 1) if shared else F.col("_e")
    sparse = lists.select("person_id", F.map_from_entries(once).alias("_m"))
    typed = sparse.select("person_id", *[F.element_at("_m", F.lit(i)).cast(types[c]).alias(c) for c, i in places.items()])
    full = cohort.select("person_id").join(typed, "person_id", "left")
    return zero_fill(full, zero)


def zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    return df.fillna(0, subset=columns) if columns else df


def to_numeric(column: Column | str) -> Column:
    """Numbers, or null where the text is not one."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("double")


# ------------------------------------------------------------------ selectors

_WINDOW = re.compile(r"_w\d+_\d+")


def base_name(column: str) -> str:
    """Column name without its window."""
    return _WINDOW.sub("", column, count=1)


def select_columns(
    columns: Iterable[str], prefix: str = "", suffix: str = "", contains: str = "", pattern: str = "", base: str = ""
) -> list[str]:
    return [
        c for c in columns
        if c.startswith(prefix) and c.endswith(suffix) and contains in c
        and (not pattern or re.search(pattern, c)) and (not base or base_name(c) == base)
    ]


def resolve_blocklist(entries: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns hit by exact names or ``re:`` patterns; an entry without a hit raises."""
    dropped, missed = set(), []
    for entry in entries:
        if entry.startswith("re:"):
            rule = re.compile(entry[3:])
            found = [c for c in columns if rule.search(c)]
        else:
            found = [c for c in columns if c == entry]
        dropped.update(found)
        if not found:
            missed.append(entry)
    if missed:
        raise ValueError(f"blocklist entries match no column: {missed}")
    return sorted(dropped)


def blocklist_audit(spark, blocklists: Mapping[str, Sequence[str]], columns: Sequence[str], configs: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = []
    for subtype, entries in blocklists.items():
        dropped = resolve_blocklist(entries, columns)
        rows += [(subtype, "__full_table__", c) for c in dropped]
        rows += [(subtype, name, c) for name, cols in configs.items() for c in dropped if c in set(cols)]
    return literal_table(spark, rows, "subtype STRING, config STRING, feature STRING")


def withhold(df: DataFrame, families: Mapping[str, Sequence[str]], configs: Mapping[str, Sequence[str]], columns: Sequence[str]):
    """Remove columns from the frame, the families and the configurations together."""
    gone = set(columns)

    def strip(groups):
        return {k: [c for c in v if c not in gone] for k, v in groups.items()}

    return df.drop(*columns), strip(families), strip(configs)


# ------------------------------------------------------------------ families and configurations

CORE_FAMILIES = ("core_comorbidities", "core_symptoms", "core_drugs", "core_demographics", "core_treatment")
MECHANISMS = ("viral", "immuno", "endo")

# Laboratories that belong to the immune mechanism; all others are endothelial.
IMMUNE_LABS = ("crp", "esr", "ferritin", "albumin", "ldh", "lactate")
ENDO_COUNTS = ("plr", "rdw")
COMPOSITE_ROUTES = (
    ("viral", ("_td_post_acute_respiratory",)),
    ("immuno", ("_td_crp_esr_elevated", "_td_late_autoimmune", "_td_persistent_cytokine")),
    ("endo", ("_td_sustained_coag", "_td_emerging_dysautonomia", "_td_unresolved_thrombosis")),
    ("none", ("_td_multisystem_late",)),
    ("viral", ("_gi_",)),
    ("immuno", ("complement",)),
)


def _first_route(name: Column, routes, default: str) -> Column:
    out = F.lit(default)
    for mechanism, parts in reversed(list(routes)):
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        out = F.when(hit, mechanism).otherwise(out)
    return out


def route_features(features: DataFrame) -> DataFrame:
    """Mechanism of every (family, feature): exactly one, or ``none`` for the cross-mechanism score."""
    name, family = F.col("feature"), F.col("family")
    by_prefix = F.when(family.startswith("mechsig_"), F.substring(family, 9, 30))
    mechanism = (
        F.when(family.isin("numeric_labs", "lab_trajectories"), _first_route(name, [("immuno", IMMUNE_LABS)], "endo"))
        .when(family == "cbc_indices", _first_route(name, [("endo", ENDO_COUNTS)], "immuno"))
        .when(family == "composites", _first_route(name, COMPOSITE_ROUTES, "endo"))
        .otherwise(F.coalesce(by_prefix, F.lit("none")))
    )
    return features.withColumn("mechanism", mechanism)


def _route(name: str, routes, default: str) -> str:
    return next((m for m, parts in routes if any(p in name for p in parts)), default)


def _routed(families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {m: [] for m in (*MECHANISMS, "none")}
    for c in [*families.get("numeric_labs", ()), *families.get("lab_trajectories", ())]:
        out[_route(c, [("immuno", IMMUNE_LABS)], "endo")].append(c)
    for c in families.get("cbc_indices", ()):
        out[_route(c, [("endo", ENDO_COUNTS)], "immuno")].append(c)
    for c in families.get("composites", ()):
        out[_route(c, COMPOSITE_ROUTES, "endo")].append(c)
    return out


def build_configs(families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The 19 nested configurations: columns in order, without repeats."""

    def family(name):
        return list(families.get(name, ()))

    def joined(*parts):
        return list(dict.fromkeys(c for p in parts for c in p))

    def without(cols, prefix):
        return [c for c in cols if not c.startswith(prefix)]

    core = joined(*[family(f) for f in CORE_FAMILIES])
    engagement = family("engagement_controls")
    ext = joined(core, family("ext_features"), engagement)
    routed = _routed(families)
    own = {m: joined(family(f"mechsig_{m}"), routed[m]) for m in MECHANISMS}
    everything = joined(*own.values(), family("mechsig_exploratory"), routed["none"])
    trends = family("temporal_trends")
    configs = {
        "baseline_core": core,
        "baseline_ext": ext,
        **{f"mechsig_{m}": joined(ext, own[m]) for m in MECHANISMS},
        "mechsig_all": joined(ext, everything),
        "mechsig_temporal": joined(ext, trends),
        "mechsig_full": joined(ext, everything, family("cross_window_summaries"), trends),
    }
    stripped = ["mechsig_viral", "mechsig_immuno", "mechsig_endo", "mechsig_all", "baseline_ext"]
    late = {f"{n}_no_td": without(configs[n], "f_comp_td_") for n in stripped}
    plain = {f"{n}_no_eng": without(configs[n], "f_eng_") for n in stripped}
    return {**configs, **late, "baseline_core_eng": joined(core, engagement), **plain}


def build_simple_configs(families: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The six-configuration variant without engagement controls and quantitative features."""
    core = [c for f in CORE_FAMILIES for c in families.get(f, ())]
    ext = core + list(families.get("ext_features", ()))
    own = {m: list(families.get(f"mechsig_{m}", ())) for m in MECHANISMS}
    return {
        "baseline_core": core,
        "baseline_ext": ext,
        **{f"mechsig_{m}": ext + own[m] for m in MECHANISMS},
        "mechsig_all": ext + [c for m in MECHANISMS for c in own[m]],
    }


def config_table(spark, configs: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(name, c, i) for name, cols in configs.items() for i, c in enumerate(cols)]
    return literal_table(spark, rows, "config STRING, feature STRING, ordinal INT")


def mechanism_families(columns: Iterable[str]) -> dict[str, list[str]]:
    """Indicator columns by mechanism; a column of no mechanism raises."""
    groups = {f"mechsig_{m}": [] for m in (*MECHANISMS, "exploratory")}
    lost = []
    for c in columns:
        hit = next((m for m in (*MECHANISMS, "exploratory") if f"_{m}_" in c), None)
        (groups[f"mechsig_{hit}"] if hit else lost).append(c)
    if lost:
        raise ValueError(f"indicator columns without mechanism: {lost[:10]}")
    return groups


# ------------------------------------------------------------------ filling


def miss_and_fill(df: DataFrame, columns: Sequence[str], exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Add ``<col>_miss`` and replace nulls by the column median (0 if the column is all null).

    All medians come from one aggregation over the unpivoted columns; exact by
    default, approximate on request.
    """
    if not columns:
        return df
    marked = df.select("*", *[F.col(f"`{c}`").isNull().cast("int").alias(f"{c}_miss") for c in columns])
    if exact:
        long = to_long(df.select(*columns), [], columns)
        rows = exact_quantiles(long, ["feature"], "value", {"m": 0.5}).select("feature", "m").collect()
        medians = {r.feature: r.m for r in rows}
    else:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns]).first()
        medians = {c: row[c] for c in columns}
    return marked.fillna({c: float(medians[c]) if medians.get(c) is not None else 0.0 for c in columns})


def needs_median(column: str) -> bool:
    """Numeric columns that get a missing flag: measured and abnormal columns mean 0 instead."""
    return not column.endswith(("_measured", "_abnormal_any", "_abnormal_count"))


def assemble_full(
    baseline: DataFrame, families: Mapping[str, Sequence[str]], signals: DataFrame, labs: DataFrame, counts: DataFrame,
    composites: DataFrame | None = None, trends: DataFrame | None = None, trajectories: DataFrame | None = None,
    cross: DataFrame | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Join the blocks of one window and fill them by the rules of their family."""
    blocks = {
        "signals": signals, "numeric_labs": labs, "cbc_indices": counts, "composites": composites,
        "temporal_trends": trends, "lab_trajectories": trajectories, "cross_window_summaries": cross,
    }
    cols = {k: [c for c in b.columns if c != "person_id"] if b is not None else [] for k, b in blocks.items()}
    out = {k: list(v) for k, v in families.items()}
    out.update(mechanism_families(cols["signals"]))
    out.update({k: v for k, v in cols.items() if k != "signals"})
    zero = cols["signals"] + cols["cross_window_summaries"]
    zero += [c for k in ("numeric_labs", "cbc_indices") for c in cols[k] if not needs_median(c)]
    zero += [c for c in cols["temporal_trends"] if "_delta_" not in c]
    continuous = [c for c in cols["composites"] if c.endswith(("_score", "_ratio"))]
    zero += [c for c in cols["composites"] if c not in continuous]
    fill = [c for k in ("numeric_labs", "cbc_indices") for c in cols[k] if needs_median(c)]
    fill += continuous + [c for c in cols["temporal_trends"] if "_delta_" in c]
    used = [baseline, *[b for b in blocks.values() if b is not None]]
    matrix = join_blocks(baseline, used, zero)
    if fill:
        # The medians and the result both read the matrix: it is written once in between.
        matrix = materialise(matrix, "matrix")
    return miss_and_fill(matrix, fill), out
