"""Ranking metrics and probability calibration, grouped over all repeats at once.

Predictions are first collapsed to one row per (key, score), so ties are merged
and a repeat with very many rows is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles, quantile, running_totals
from ..functions.sampling import flag_first_k
from ..functions.skew import LITERAL_ROWS, literal_table, lookup_join
from ..functions.stats import clip, expit, logit, mean_ci


def collapse(predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true") -> DataFrame:
    return predictions.groupBy(*keys, F.col(score).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y")
    )


def ranking_metrics(
    predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true"
) -> DataFrame:
    """Tie-aware AUROC (rank sum) and average precision (step sum) per key."""
    cells = collapse(predictions, keys, score, label).select(
        *keys, "p", F.col("y").alias("pos"), (F.col("n") - F.col("y")).alias("neg")
    )
    r = running_totals(cells, keys, "p", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    auroc = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)) / (F.max("pos_total") * F.max("neg_total"))
    ap = F.sum(F.col("pos") * tp / (tp + fp)) / F.max("pos_total")
    return r.groupBy(*keys).agg(
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        F.when(both, auroc).alias("auroc"),
        F.when(F.max("pos_total") > 0, ap).alias("auprc"),
    )


# ------------------------------------------------------------------ decision curves


def net_benefit(
    predictions: DataFrame, keys: Sequence[str], thresholds: Sequence[float], score: str = "p_raw", label: str = "y_true"
) -> DataFrame:
    """Net benefit of the model, treat-all and treat-none per threshold (``p >= t`` is positive).

    Rows are counted once by the number of thresholds they reach; the counts are
    then summed per threshold, so the input is never multiplied by the thresholds.
    """
    cuts = sorted(float(t) for t in thresholds)
    array = F.array(*[F.lit(t) for t in cuts])
    reached = F.size(F.filter(array, lambda t: t <= F.col(score)))
    cells = predictions.groupBy(*keys, reached.alias("_r")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(cuts)])
    # At most len(thresholds) + 1 cells per key, each repeated once per threshold.
    at = cells.select(*keys, "_r", "n", "y", F.explode(steps).alias("s"))
    above = F.col("_r") >= F.col("s.i")
    counts = at.groupBy(*keys, F.col("s.t").alias("threshold")).agg(
        F.sum("n").alias("n"),
        F.sum("y").alias("n_pos"),
        F.sum(F.when(above, F.col("y")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("n") - F.col("y")).otherwise(0)).alias("fp"),
    )
    odds = F.col("threshold") / (F.lit(1.0) - F.col("threshold"))
    rate = F.col("n_pos") / F.col("n")
    return counts.select(
        *keys, "threshold", "tp", "fp", "n",
        (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"),
        (rate - (F.lit(1.0) - rate) * odds).alias("treat_all"),
        F.lit(0.0).alias("treat_none"),
    )


# ------------------------------------------------------------------ logistic calibration

NEWTON_STEPS = 100
CONVERGED = 1e-9

KEY_ROWS = 20_000
"""Most repeats whose curves (a short array each) are broadcast."""


def _newton(cells: DataFrame, keys: Sequence[str], fit_slope: bool, steps: int, tolerance: float = CONVERGED) -> DataFrame:
    """Grouped Newton iterations on (keys, z, n, y).

    A step is one aggregation over the collapsed cells of all keys; only the few
    sums per key reach the driver, which holds the parameters between steps.
    The cells are cached for the duration and the plan does not grow.  A key
    has ``converged`` if its last step was below the tolerance; a singular
    system has not.
    """
    keys = list(keys)
    spark = cells.sparkSession
    schema = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys) + ", a DOUBLE, b DOUBLE"
    converged: dict[tuple, bool] = {}
    mu = expit(F.col("a") + F.col("b") * F.col("z"))
    g = F.col("y") - F.col("n") * mu
    w = F.col("n") * mu * (F.lit(1.0) - mu)
    cells = cells.persist()
    try:
        start = cells.select(*keys).distinct().limit(LITERAL_ROWS + 1).collect()
        params = {tuple(r): (0.0, 0.0 if fit_slope else 1.0) for r in start}
        for _ in range(steps):
            table = literal_table(spark, [(*k, *ab) for k, ab in params.items()], schema)
            sums = cells.join(table, keys).groupBy(*keys).agg(
                F.sum(g).alias("g0"), F.sum(g * F.col("z")).alias("g1"), F.sum(w).alias("h00"),
                F.sum(w * F.col("z")).alias("h01"), F.sum(w * F.col("z") * F.col("z")).alias("h11"),
            )
            moved = 0.0
            for r in sums.collect():
                key = tuple(r[k] for k in keys)
                da, db = _step(r, fit_slope) or (0.0, 0.0)
                a, b = params[key]
                params[key] = (a + da, b + db)
                converged[key] = _step(r, fit_slope) is not None and max(abs(da), abs(db)) < CONVERGED
                moved = max(moved, abs(da), abs(db))
            if moved < tolerance:
                break
    finally:
        cells.unpersist()
    return literal_table(spark, [(*k, *ab, converged.get(k, False)) for k, ab in params.items()], schema + ", converged BOOLEAN")


def _step(r, fit_slope: bool) -> tuple[float, float] | None:
    """The step of one key; None where the system is singular."""
    if not fit_slope:
        return (r.g0 / r.h00, 0.0) if r.h00 > 0 else None
    det = r.h00 * r.h11 - r.h01 * r.h01
    if det <= 0:
        return None
    return (r.h11 * r.g0 - r.h01 * r.g1) / det, (r.h00 * r.g1 - r.h01 * r.g0) / det


def logit_cells(predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true") -> DataFrame:
    cells = collapse(predictions, keys, score, label)
    return cells.select(*keys, logit(F.col("p")).alias("z"), "p", "n", "y")


def calibration_in_the_large(
    predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true", steps: int = NEWTON_STEPS
) -> DataFrame:
    """Intercept with slope fixed to 1, and mean prediction against observed rate."""
    cells = logit_cells(predictions, keys, score, label)
    fitted = _newton(cells, keys, False, steps).select(*keys, F.col("a").alias("_a"), "converged")
    means = cells.groupBy(*keys).agg(
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_pred"), (F.sum("y") / F.sum("n")).alias("obs_rate")
    )
    two = (F.col("obs_rate") > 0) & (F.col("obs_rate") < 1)
    return means.join(fitted, list(keys)).select(
        *keys, F.when(two, F.col("_a")).alias("citl"),
        (F.col("mean_pred") - F.col("obs_rate")).alias("mean_pred_minus_obs"), "mean_pred", "obs_rate", (two & F.col("converged")).alias("citl_converged"),
    )


def calibration_slope(
    predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true", steps: int = NEWTON_STEPS
) -> DataFrame:
    """Unpenalised logistic fit of the outcome on logit(p); null where only one class is present."""
    cells = logit_cells(predictions, keys, score, label)
    rate = cells.groupBy(*keys).agg((F.sum("y") / F.sum("n")).alias("_r"))
    two = (F.col("_r") > 0) & (F.col("_r") < 1)
    return rate.join(_newton(cells, keys, True, steps), list(keys)).select(
        *keys, F.when(two, F.col("a")).alias("intercept"), F.when(two, F.col("b")).alias("slope"), (two & F.col("converged")).alias("slope_converged")
    )


# ------------------------------------------------------------------ flexible calibration curve


def calibration_knots(
    predictions: DataFrame, keys: Sequence[str], n_knots: int = 20, frac: float = 0.66,
    score: str = "p_raw", label: str = "y_true",
) -> DataFrame:
    """Tricube local-linear fit of the outcome at quantile knots.

    Each knot uses the ``frac`` share of rows nearest to it in rank; all fits are
    one aggregation of collapsed cells.  Result: (keys, knot, p, g) with g
    clipped to [0, 1].  Between knots the curve is linear, so it departs from a
    fit at every score by at most an eighth of the squared gap of two knots
    times the curve's second derivative; more knots make the gap smaller.
    """
    keys = list(keys)
    cells = collapse(predictions, keys, score, label)
    ranked = running_totals(cells, keys, "p", ["n"])
    places = []
    for i in range(n_knots):
        middle = i / (n_knots - 1)
        low = min(max(middle - frac / 2.0, 0.0), 1.0 - frac)
        places += [(f"k{i}", middle), (f"l{i}", low), (f"h{i}", low + frac)]
    wanted = F.array(
        *[F.struct(F.lit(n).alias("n"), F.floor((F.col("n_total") - 1) * F.lit(s)).alias("r")) for n, s in places]
    )
    inside = F.filter(wanted, lambda t: (t["r"] >= F.col("n_before")) & (t["r"] < F.col("n_before") + F.col("n")))
    # Three numbers per knot and key.
    found = ranked.select(*keys, "p", F.explode(inside).alias("t")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("t.n", "p"))).alias("_m")
    )

    def at(name: str) -> Column:
        return F.col("_m")[name]

    array = F.array(
        *[
            F.struct(
                F.lit(i).alias("knot"), at(f"k{i}").alias("x0"),
                F.greatest(at(f"k{i}") - at(f"l{i}"), at(f"h{i}") - at(f"k{i}"), F.lit(1e-9)).alias("h"),
            )
            for i in range(n_knots)
        ]
    )
    knots = lookup_join(cells, found.select(*keys, array.alias("_k")), keys, ["p"], rows=KEY_ROWS)
    sums = []
    for i in range(n_knots):
        x0, h = F.get("_k", F.lit(i))["x0"], F.get("_k", F.lit(i))["h"]
        x = F.col("p") - x0
        d = F.abs(x) / h
        u = F.lit(1.0) - d * d * d
        weight = F.when(d < 1, u * u * u)
        wn, wy = F.col("n") * weight, F.col("y") * weight
        sums.append(F.struct(
            F.lit(i).alias("knot"), F.max(x0).alias("p"), F.sum(wn).alias("s0"), F.sum(wn * x).alias("s1"), F.sum(wn * x * x).alias("s2"),
            F.sum(wy).alias("t0"), F.sum(wy * x).alias("t1"),
        ))
    # five sums per knot in one row per key, combined on the map side
    fits = knots.groupBy(*keys).agg(F.array(*sums).alias("_s")).select(*keys, F.explode("_s").alias("s")).select(*keys, "s.*").where("s0 > 0")
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    fit = F.when(det > 1e-12 * F.col("s0") * F.col("s0"), line).otherwise(F.col("t0") / F.col("s0"))
    return fits.select(*keys, "knot", "p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), fit)).alias("g"))


def _interpolate(x: Column, knots: Column) -> Column:
    """Linear interpolation over an array of (p, g) sorted by p; constant outside."""
    below = F.filter(knots, lambda k: k["p"] <= x)
    above = F.filter(knots, lambda k: k["p"] > x)
    left = F.element_at(below, -1)
    right = F.get(above, F.lit(0))
    mid = left["g"] + (right["g"] - left["g"]) * (x - left["p"]) / (right["p"] - left["p"])
    return F.when(F.size(below) == 0, right["g"]).when(F.size(above) == 0, left["g"]).otherwise(mid)


def _knot_arrays(knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One short array (the knots) per key.
    return knots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "g"))).alias("_knots"))


def calibration_curve(knots: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """The fitted curve on a grid of probabilities."""
    arrays = _knot_arrays(knots, keys)
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    rows = arrays.select(*keys, "_knots", points.alias("p"))
    return rows.select(*keys, "p", _interpolate(F.col("p"), F.col("_knots")).alias("g"))


def calibration_errors(
    predictions: DataFrame, knots: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true",
) -> DataFrame:
    """ICI, E50 and E90: mean, median and 90 % quantile of abs(g(p) - p) over the rows."""
    cells = lookup_join(collapse(predictions, keys, score, label), _knot_arrays(knots, keys), keys, ["p"], rows=KEY_ROWS)
    gap = F.abs(_interpolate(F.col("p"), F.col("_knots")) - F.col("p"))
    distinct = cells.select(*keys, gap.alias("d"), "n").groupBy(*keys, "d").agg(F.sum("n").alias("n"))
    ranked = running_totals(distinct, list(keys), "d", ["n"])
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("ici"), quantile("d", 0.5).alias("e50"), quantile("d", 0.9).alias("e90")
    )


# ------------------------------------------------------------------ recalibration


def prior_shift(p: Column | str, prevalence: float) -> Column:
    """Move balanced-training probabilities to the true prevalence."""
    import math

    p = F.col(p) if isinstance(p, str) else p
    return expit(logit(p) + F.lit(math.log(prevalence / (1.0 - prevalence))))


def calibration_halves(
    predictions: DataFrame, id_col: str, keys: Sequence[str] = ("seed",), label: str = "y_true", share: float = 0.5, score: str = "p_raw"
) -> DataFrame:
    """Stratified halves by hash: ``is_cal`` = 1 on the fitting half of each (key, class).

    Of rows that bear one number, those with lower scores come first, so the halves hang neither on partitions nor on threads.
    """
    hashed = predictions.withColumn(
        "_hash", F.md5(F.concat_ws(":", F.lit("c"), F.col(id_col).cast("string"), *[F.col(k).cast("string") for k in keys]))
    )
    targets = predictions.groupBy(*keys, label).agg(F.floor(F.count(F.lit(1)) * F.lit(float(share))).alias("k"))
    return flag_first_k(hashed, [*keys, label], targets, "is_cal", id_col=id_col, ties=[score]).drop("_hash")


def logistic_recalibration(cal: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true") -> DataFrame:
    """(keys, intercept, slope) fitted on the calibration half."""
    return calibration_slope(cal, keys, score, label)


def apply_logistic(eval_rows: DataFrame, coefficients: DataFrame, keys: Sequence[str], score: str = "p_raw") -> DataFrame:
    eta = F.col("intercept") + F.col("slope") * logit(F.col(score))
    return eval_rows.join(coefficients, list(keys)).withColumn("p_corrected", expit(eta)).drop("intercept", "slope", "slope_converged")


def assess(predictions: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true", n_knots: int = 20) -> DataFrame:
    """All calibration measures of one score, one row per key."""
    keys = list(keys)
    clipped = predictions.withColumn(score, clip(F.col(score), 0.0)) if score != "p_raw" else predictions
    citl = calibration_in_the_large(clipped, keys, score, label)
    slope = calibration_slope(clipped, keys, score, label)
    knots = calibration_knots(clipped, keys, n_knots, score=score, label=label)
    errors = calibration_errors(clipped, knots, keys, score, label)
    return citl.join(slope, keys).join(errors, keys)


METRIC_NAMES = ("citl", "mean_pred_minus_obs", "intercept", "slope", "ici", "e50", "e90", "mean_pred", "obs_rate")


def summarise_across_seeds(rows: DataFrame, keys: Sequence[str] = ("method",), metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean, sd and 95 % interval of the finite values per (key, metric), and the number of seeds."""
    names = [m for m in (metrics or METRIC_NAMES) if m in rows.columns]
    long = rows.select(*keys, "seed", *[F.col(m).cast("double").alias(m) for m in names]).unpivot(
        [*keys, "seed"], names, "metric", "value"
    )
    stats = mean_ci(F.col("value"))
    return long.groupBy(*keys, "metric").agg(
        *[c.alias(n) for n, c in stats.items()], F.count_distinct("seed").alias("n_seeds")
    )


def curve_bands(curves: DataFrame, keys: Sequence[str], point: str, value: str) -> DataFrame:
    """Median and quartiles over seeds per grid point."""
    return exact_quantiles(curves, [*keys, point], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n_values")
