"""Features that compare windows: trajectories, cross-window summaries, trends, composites.

The inputs are the long results of the indicator and laboratory operators, so
windows are rows and a comparison is one conditional aggregation per person.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import literal_table
from .windows import Window, ordered_labels, window_label


def _at(window: str, value: Column | str) -> Column:
    """Value of one window inside a groupBy over the windows of a person."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col("window") == window, value))


def lab_trajectories(summary: DataFrame, cohort: DataFrame, labs: Mapping[str, bool], early: str, late: str) -> DataFrame:
    """Median change late - early per lab; persistent elevation for labs with an upper limit.

    ``labs`` maps a lab name to whether it has an upper limit.
    """
    pair = summary.where(F.col("window").isin(early, late) & F.col("lab").isin(*labs))
    per_lab = pair.groupBy("person_id", "lab").agg(
        (_at(late, "median") - _at(early, "median")).alias("delta"),
        (F.coalesce(_at(late, "abnormal_any"), F.lit(0)) * F.coalesce(_at(early, "abnormal_any"), F.lit(0))).alias("persist"),
    )
    wide = per_lab.groupBy("person_id").pivot("lab", list(labs)).agg(F.first("delta").alias("delta"), F.first("persist").alias("persist"))
    full = cohort.select("person_id").join(wide, "person_id", "left")
    deltas = [F.col(f"`{lab}_delta`").alias(f"f_lab_traj_{lab}_delta_{early}_to_{late}") for lab in labs]
    persist = [
        F.coalesce(F.col(f"`{lab}_persist`"), F.lit(0)).alias(f"f_lab_traj_{lab}_persistent_elev")
        for lab, has_high in labs.items()
        if has_high
    ]
    return full.select("person_id", *deltas, *persist)


def cross_window(hits: DataFrame, cohort: DataFrame, windows: Sequence[str], indicators: Sequence[str]) -> DataFrame:
    """Per indicator: hit in >= 2 windows, in the first only, in the last only.

    Windows are ordered by their days, not by their label.
    """
    labels = ordered_labels(windows)
    per = (
        hits.where(F.col("window").isin(*labels) & F.col("indicator").isin(*indicators))
        .groupBy("person_id", "indicator")
        .agg(
            F.count_distinct("window").alias("n"),
            F.max((F.col("window") == labels[0]).cast("int")).alias("first"),
            F.max((F.col("window") == labels[-1]).cast("int")).alias("last"),
        )
    )
    flags = per.select(
        "person_id", "indicator",
        (F.col("n") >= 2).cast("int").alias("persistent"),
        ((F.col("first") == 1) & (F.col("n") == 1)).cast("int").alias("early_only"),
        ((F.col("last") == 1) & (F.col("n") == 1)).cast("int").alias("late_only"),
    )
    stats = ("persistent", "early_only", "late_only")
    wide = flags.groupBy("person_id").pivot("indicator", list(indicators)).agg(*[F.first(s).alias(s) for s in stats])
    full = cohort.select("person_id").join(wide, "person_id", "left")
    return full.select(
        "person_id",
        *[
            F.coalesce(F.col(f"`{i}_{s}`"), F.lit(0)).alias(f"f_ind_xw_{s}_{i.lower()}")
            for i in indicators for s in stats
        ],
    )


def binary_trends(hits: DataFrame, cohort: DataFrame, windows: Sequence[str], features: Sequence[str], key: str = "indicator") -> DataFrame:
    """Rise and fall between adjacent windows, any rise / fall, and first against last."""
    labels = ordered_labels(windows)
    if len(labels) < 2:
        return cohort.select("person_id")
    marks = (
        hits.where(F.col("window").isin(*labels) & F.col(key).isin(*features))
        .groupBy("person_id")
        .agg(
            *[
                F.max(F.when((F.col("window") == w) & (F.col(key) == f), 1).otherwise(0)).alias(f"{f}|{w}")
                for f in features for w in labels
            ]
        )
    )
    full = cohort.select("person_id").join(marks, "person_id", "left")

    def m(f: str, w: str) -> Column:
        return F.coalesce(F.col(f"`{f}|{w}`"), F.lit(0))

    def rise(f, a, b):
        return ((m(f, a) == 0) & (m(f, b) == 1)).cast("int")

    def fall(f, a, b):
        return ((m(f, a) == 1) & (m(f, b) == 0)).cast("int")

    pairs = list(zip(labels[:-1], labels[1:]))
    out = []
    for f in features:
        p = f"f_temp_bin_{f.lower()}"
        for a, b in pairs:
            out += [rise(f, a, b).alias(f"{p}_rise_{a}_to_{b}"), fall(f, a, b).alias(f"{p}_fall_{a}_to_{b}")]
        rises, falls = [rise(f, a, b) for a, b in pairs], [fall(f, a, b) for a, b in pairs]
        out += [
            (F.greatest(*rises) if len(rises) > 1 else rises[0]).alias(f"{p}_any_rise"),
            (F.greatest(*falls) if len(falls) > 1 else falls[0]).alias(f"{p}_any_fall"),
            rise(f, labels[0], labels[-1]).alias(f"{p}_late_gt_early"),
            fall(f, labels[0], labels[-1]).alias(f"{p}_late_lt_early"),
        ]
    return full.select("person_id", *out)


def lab_trends(
    summary: DataFrame, cohort: DataFrame, windows: Sequence[str], directions: Mapping[str, str],
    stat: str = "median", min_delta: float = 0.0,
) -> DataFrame:
    """Direction of change between adjacent windows and the change itself (null without both values)."""
    labels = ordered_labels(windows)
    for lab, direction in directions.items():
        if direction not in ("up", "down", "both"):
            raise ValueError(f"unsupported direction {direction} for {lab}")
    if len(labels) < 2:
        return cohort.select("person_id")
    values = (
        summary.where(F.col("window").isin(*labels) & F.col("lab").isin(*directions))
        .groupBy("person_id")
        .agg(*[F.max(F.when((F.col("window") == w) & (F.col("lab") == lab), F.col(stat))).alias(f"{lab}|{w}") for lab in directions for w in labels])
    )
    full = cohort.select("person_id").join(values, "person_id", "left")

    def delta(lab, a, b):
        return F.col(f"`{lab}|{b}`") - F.col(f"`{lab}|{a}`")

    def test(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    pairs = list(zip(labels[:-1], labels[1:]))
    out = []
    for lab, direction in directions.items():
        p = f"f_temp_lab_{lab}"
        first, last = labels[0], labels[-1]
        ways = []
        if direction in ("up", "both"):
            ways.append(("up", "late_gt_early", lambda d: d > min_delta))
        if direction in ("down", "both"):
            ways.append(("down", "late_lt_early", lambda d: d < -min_delta))
        for way, overall, rule in ways:
            flags = [test(rule(delta(lab, a, b))) for a, b in pairs]
            out += [flag.alias(f"{p}_{way}_{a}_to_{b}") for flag, (a, b) in zip(flags, pairs)]
            out += [
                test(rule(delta(lab, first, last))).alias(f"{p}_{overall}"),
                (F.greatest(*flags) if len(flags) > 1 else flags[0]).alias(f"{p}_any_{way}"),
            ]
        out += [delta(lab, a, b).alias(f"{p}_delta_{a}_to_{b}") for a, b in pairs]
        out.append(delta(lab, first, last).alias(f"{p}_delta_overall"))
    return full.select("person_id", *out)


def and_composites(matrix: DataFrame, complement: Column, first: str, second: str, prefix: str = "f_comp_complement") -> DataFrame:
    """Complement with D-dimer, with D-dimer and CRP, and how many of the three are abnormal."""
    c = F.coalesce(complement, F.lit(0)).cast("int")
    a, b = F.coalesce(F.col(first), F.lit(0)), F.coalesce(F.col(second), F.lit(0))
    return matrix.select(
        "person_id", "window",
        (c * a).alias(f"{prefix}_ddimer"),
        (c * a * b).alias(f"{prefix}_crp_ddimer"),
        (c + a + b).alias(f"{prefix}_crp_ddimer_count"),
    )


def organ_injury(
    summary: DataFrame, every: DataFrame, cardiac: Mapping[str, float], renal: tuple[str, float]
) -> DataFrame:
    """Cardiac flag with the highest peak / limit, renal flag with peak / limit.

    ``every`` is (person_id, window); missing labs leave the score null.
    """
    lab = F.col("lab")
    ratio = F.lit(None).cast("double")
    for name, limit in cardiac.items():
        ratio = F.when(lab == name, F.col("peak") / F.lit(float(limit))).otherwise(ratio)
    agg = summary.where(lab.isin(*cardiac, renal[0])).groupBy("person_id", "window").agg(
        F.max(F.when(lab.isin(*cardiac), F.col("abnormal_any"))).alias("c"),
        F.max(ratio).alias("cs"),
        F.max(F.when(lab == renal[0], F.col("abnormal_any"))).alias("r"),
        F.max(F.when(lab == renal[0], F.col("peak") / F.lit(float(renal[1])))).alias("rs"),
    )
    df = every.select("person_id", "window").join(agg, ["person_id", "window"], "left")
    return df.select(
        "person_id", "window",
        F.coalesce("c", F.lit(0)).alias("f_comp_cardiac_injury"),
        F.col("cs").alias("f_comp_cardiac_injury_score"),
        F.coalesce("r", F.lit(0)).alias("f_comp_renal_injury"),
        F.col("rs").alias("f_comp_renal_injury_ratio"),
    )


def burden(flags: DataFrame, prefix: str = "f_comp_gi_") -> DataFrame:
    """Any flag and the number of flags over all columns with the prefix."""
    names = [c for c in flags.columns if c.startswith(prefix)]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return flags.select("*", (total > 0).cast("int").alias(f"{prefix}any"), total.alias(f"{prefix}burden_score"))


def late_windows(windows: Sequence[Window], min_start: int = 30, max_end: int | None = None) -> list[str]:
    kept = [w for w in windows if w[0] >= min_start and (max_end is None or w[1] <= max_end)]
    return [window_label(w) for w in kept]


def late_divergence(
    hits: DataFrame, cohort: DataFrame, windows: Sequence[Window], features: Sequence[str],
    composites: Mapping[str, Sequence[str]], mechanisms: Mapping[str, Sequence[str]],
    min_start: int = 30, max_end: int | None = None, score: str = "f_comp_td_multisystem_late",
) -> DataFrame:
    """Composites over late windows that end by ``max_end``: any hit, number of windows hit, mechanism count.

    ``hits`` is (person_id, window, feature) of every flag that is 1 and
    ``features`` the names on offer.  A composite that matches no name raises;
    without a late window the flags are 0 and no window counts are returned.
    """
    late = late_windows(windows, min_start, max_end)
    if not late:
        return cohort.select("person_id", *[F.lit(0).alias(c) for c in [*composites, score]])
    pairs = []
    for name, parts in composites.items():
        matched = [f for f in features if any(p in f for p in parts)]
        if not matched:
            raise ValueError(f"composite {name} matches no feature: {tuple(parts)}")
        pairs += [(f, name) for f in matched]
    for mechanism, parts in mechanisms.items():
        pairs += [(f, f"_m_{mechanism}") for f in features if any(p in f for p in parts)]
    mapping = literal_table(hits.sparkSession, pairs, "feature STRING, composite STRING")
    found = (
        hits.where(F.col("window").isin(*late))
        .join(mapping, "feature")
        .groupBy("person_id")
        .pivot("composite", [*composites, *[f"_m_{m}" for m in mechanisms]])
        .agg(F.count_distinct("window"))
    )
    df = cohort.select("person_id").join(found, "person_id", "left")

    def n(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit(0))

    out = []
    for name in composites:
        out += [(n(name) > 0).cast("int").alias(name), n(name).alias(f"{name}_n_windows")]
    total = sum(((n(f"_m_{m}") > 0).cast("int") for m in mechanisms), F.lit(0))
    return df.select("person_id", *out, total.alias(score))
