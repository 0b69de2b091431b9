"""Sampling, ranking metrics, calibration, paired tests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.stats import ERFC_A, ERFC_P, rounded
from ..operators import isotonic as I
from ..operators import metrics as M
from ..operators import paired as P
from ..operators import repeats as R
from ..operators import reports as T
from ..session import materialise
from ..sources.results import count_guard, pending_runs
from .q_cohort import _GATED, gated
from .registry import query

SEEDS = R.seeds_of(3)


def _rows(r):
    """The gated cohort is written once and read by every step of the sampling."""
    return materialise(gated(r).select("person_id", "label"), "gated")


# ------------------------------------------------------------------ sampling


@query("repeat_seeds", """
    SELECT CAST(i AS BIGINT) AS iteration, 42 + 1000 * i AS seed, n FROM (SELECT unnest(range(100)) AS i)
    JOIN (SELECT iteration, count(*) AS n FROM results GROUP BY 1) ON iteration = i""")
def repeat_seeds(r):
    counts = r.results.groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))
    return R.repeat_seeds(r.spark, 100).join(counts, "iteration")


_SPLIT = f"""
    WITH g AS ({_GATED}), c AS (SELECT label, count(*) AS n FROM g GROUP BY 1), t AS (SELECT ceil(0.2 * sum(n)) AS t, sum(n) AS total FROM c),
    q AS (SELECT label, floor(t * n / total) AS f, t * n / total - floor(t * n / total) AS rest, t FROM c CROSS JOIN t),
    k AS (SELECT label, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS k FROM q),
    s AS (SELECT person_id, label, seed, row_number() OVER (PARTITION BY label, seed ORDER BY md5(person_id || ':' || seed), person_id) AS rn
          FROM g CROSS JOIN (VALUES (42), (1042), (2042)) v(seed)),
    split AS (SELECT s.person_id, s.label, s.seed, CASE WHEN rn <= k THEN 1 ELSE 0 END AS is_test FROM s JOIN k USING (label))"""


@query("stratified_split", f"{_SPLIT} SELECT * FROM split")
def stratified_split(r):
    return R.stratified_split(_rows(r), SEEDS)


@query("balance", f"""
    {_SPLIT}, tr AS (SELECT * FROM split WHERE is_test = 0), n AS (SELECT seed, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM tr GROUP BY 1),
    b AS (SELECT person_id, label, tr.seed, row_number() OVER (PARTITION BY tr.seed ORDER BY md5('b:' || person_id || ':' || tr.seed), person_id) AS rn, least(p, q) AS k
          FROM tr JOIN n ON n.seed = tr.seed WHERE label = 0)
    SELECT person_id, label, seed FROM tr WHERE label = 1 UNION ALL SELECT person_id, label, seed FROM b WHERE rn <= k""")
def balance(r):
    train = R.stratified_split(_rows(r), SEEDS).where("is_test = 0").select("seed", "person_id", "label")
    return R.balance(train)


def wide_orders(r):
    """A feature table with rare, common and continuous columns from customers."""
    c = F.col("c_custkey")
    return r.table("customer").select(
        c.alias("person_id"), F.when(F.col("c_acctbal") > 9950, 1).otherwise(0).alias("rare"), F.when(F.col("c_acctbal") > 9990, 1).otherwise(0).alias("forced"),
        (c % 4 == 0).cast("int").alias("common"), F.col("c_acctbal").alias("amount"), F.when(c % 5 == 0, F.col("c_acctbal")).alias("holes"),
        F.when(F.lit(False), 1).alias("empty"),
    )


_COLS = ("rare", "forced", "common", "amount", "holes", "empty")
_WIDE = """
    w AS (SELECT CASE WHEN c_acctbal > 9950 THEN 1 ELSE 0 END AS rare, CASE WHEN c_acctbal > 9990 THEN 1 ELSE 0 END AS forced, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS common,
                 c_acctbal AS amount, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS holes FROM customer)"""


@query("prevalence_filter", f"""
    WITH {_WIDE}, p AS (
        SELECT 'rare' AS feature, count(rare) AS n_values, avg(rare) AS mean, 1 AS is_binary FROM w UNION ALL SELECT 'forced', count(forced), avg(forced), 1 FROM w
        UNION ALL SELECT 'common', count(common), avg(common), 1 FROM w UNION ALL SELECT 'amount', count(amount), avg(amount), 0 FROM w
        UNION ALL SELECT 'holes', count(holes), avg(holes), 0 FROM w UNION ALL SELECT 'empty', 0, NULL, 1)
    SELECT feature, n_values, round(mean, 6) AS mean, is_binary, CASE WHEN is_binary = 1 AND mean < 0.01 AND feature <> 'forced' THEN 0 ELSE 1 END AS kept FROM p""")
def prevalence_filter(r):
    profile = R.column_profile(wide_orders(r), _COLS)
    return R.prevalence_filter(profile, 0.01, ["forced"])


@query("median_impute", f"""
    WITH {_WIDE} SELECT round(coalesce(holes, (SELECT median(holes) FROM w)), 6) AS holes, amount FROM w""")
def median_impute(r):
    wide = wide_orders(r).select("amount", "holes")
    return R.median_impute(wide, R.train_medians(wide, ["holes"]), ["holes"])


@query("folds", f"""
    WITH g AS ({_GATED}) SELECT person_id, label, seed, CAST(floor((row_number() OVER (PARTITION BY seed, label ORDER BY md5('f:' || person_id || ':' || seed || ':' || label), person_id) - 1) * 5
        / count(*) OVER (PARTITION BY seed, label)) AS BIGINT) AS fold FROM g CROSS JOIN (SELECT 42 + 1000 * unnest(range(10)) AS seed)""")
def folds(r):
    """Exact folds of the first ten of the repeats' seeds."""
    return R.folds(R.with_seeds(_rows(r), R.seeds_of(10)))


@query("count_guard", f"SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM ({_GATED})")
def count_guard_q(r):
    return count_guard(gated(r), None)


@query("pending_runs", """
    SELECT DISTINCT config, feature_window, iteration FROM results EXCEPT SELECT config, feature_window, iteration FROM results WHERE auroc > 0.1""")
def pending(r):
    keys = ["config", "feature_window", "iteration"]
    return pending_runs(r.results.select(*keys).distinct(), r.results.where("auroc > 0.1"), keys)


# ------------------------------------------------------------------ ranking metrics

_RANK = """
    WITH c AS (SELECT seed, p_raw AS p, count(*) AS n, sum(y_true) AS y FROM predictions GROUP BY 1, 2),
    w AS (SELECT *, sum(n - y) OVER (PARTITION BY seed ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb, sum(y) OVER (PARTITION BY seed) AS pt, sum(n - y) OVER (PARTITION BY seed) AS nt,
                 sum(y) OVER (PARTITION BY seed ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY seed ORDER BY p DESC) AS tot FROM c)"""


@query("auroc", f"{_RANK} SELECT seed, CAST(max(pt) AS BIGINT) AS n_pos, CAST(max(nt) AS BIGINT) AS n_neg, round(sum(y * (coalesce(nb, 0) + (n - y) / 2.0)) / (max(pt) * max(nt)), 6) AS auroc FROM w GROUP BY 1")
def auroc(r):
    return M.ranking_metrics(r.predictions, ["seed"]).drop("auprc")


@query("average_precision", f"{_RANK} SELECT seed, round(sum(y * tp / tot) / max(pt), 6) AS auprc FROM w GROUP BY 1")
def average_precision(r):
    return M.ranking_metrics(r.predictions, ["seed"]).select("seed", "auprc")


@query("exact_quantiles", """
    SELECT l_returnflag, count(*) AS n_values, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90
    FROM lineitem GROUP BY 1""")
def quantiles(r):
    return exact_quantiles(r.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q90": 0.9})


# ------------------------------------------------------------------ calibration

_NB = """
    SELECT seed, t AS threshold, count(*) FILTER (p_raw >= t AND y_true = 1) AS tp, count(*) FILTER (p_raw >= t AND y_true = 0) AS fp, count(*) AS n, avg(y_true) AS prev
    FROM predictions CROSS JOIN (VALUES (0.05), (0.1), (0.3), (0.5)) v(t) GROUP BY 1, 2"""
THRESHOLDS = (0.05, 0.1, 0.3, 0.5)


@query("net_benefit", f"""
    SELECT seed, CAST(threshold AS DOUBLE) AS threshold, tp, fp, n, round(tp / n - fp / n * threshold / (1 - threshold), 6) AS net_benefit,
           round(prev - (1 - prev) * threshold / (1 - threshold), 6) AS treat_all, CAST(0 AS DOUBLE) AS treat_none FROM ({_NB})""")
def net_benefit(r):
    return M.net_benefit(r.predictions, ["seed"], THRESHOLDS)


@query("decision_curve_bands", f"""
    SELECT CAST(threshold AS DOUBLE) AS threshold, round(quantile_cont(nb, 0.25), 6) AS q1, round(median(nb), 6) AS median, round(quantile_cont(nb, 0.75), 6) AS q3
    FROM (SELECT *, tp / n - fp / n * CAST(threshold AS DOUBLE) / (1 - threshold) AS nb FROM ({_NB})) GROUP BY 1""")
def decision_curve_bands(r):
    return M.curve_bands(M.net_benefit(r.predictions, ["seed"], THRESHOLDS), [], "threshold", "net_benefit")


_CLIP = "least(greatest(p_raw, 0.000001), 0.999999)"


@query("prior_shift", f"SELECT row_id, round(1 / (1 + exp(-(ln({_CLIP} / (1 - {_CLIP})) + ln(0.05 / 0.95)))), 6) AS p_corrected FROM predictions")
def prior_shift(r):
    return r.predictions.select("row_id", M.prior_shift("p_raw", 0.05).alias("p_corrected"))


_CELLS = f"c AS (SELECT seed, ln({_CLIP} / (1 - {_CLIP})) AS z, count(*) AS n, sum(y_true) AS y, sum(p_raw) AS sp FROM predictions GROUP BY 1, 2)"


STEPS = 10


def _newton_sql(slope: bool, steps: int = STEPS, cells: str = _CELLS, c: str = "c", p: str = "p") -> str:
    """The same iterations, one table expression per step."""
    out = [cells, f"{p}0 AS (SELECT DISTINCT seed, 0.0::DOUBLE AS a, {0.0 if slope else 1.0}::DOUBLE AS b FROM {c})"]
    for i in range(steps):
        mu = "(1 / (1 + exp(-(a + b * z))))"
        sums = f"""SELECT seed, a, b, sum(y - n * {mu}) AS g0, sum((y - n * {mu}) * z) AS g1, sum(n * {mu} * (1 - {mu})) AS h00,
                   sum(n * {mu} * (1 - {mu}) * z) AS h01, sum(n * {mu} * (1 - {mu}) * z * z) AS h11 FROM {c} JOIN {p}{i} USING (seed) GROUP BY 1, 2, 3"""
        if slope:
            step = "a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b"
        else:
            step = "a + g0 / h00 AS a, b"
        out.append(f"{p}{i + 1} AS MATERIALIZED (SELECT seed, {step} FROM ({sums}))")
    return ", ".join(out)


_CITL = f"""WITH {_newton_sql(False)}
    SELECT c.seed, round(max(a), 6) AS citl, round(sum(sp) / sum(n) - sum(y) / sum(n), 6) AS mean_pred_minus_obs, round(sum(sp) / sum(n), 6) AS mean_pred, round(sum(y) / sum(n), 6) AS obs_rate, TRUE AS citl_converged
    FROM c JOIN p{STEPS} USING (seed) GROUP BY 1"""


@query("citl", _CITL)
def citl(r):
    return M.calibration_in_the_large(r.predictions, ["seed"])


@query("cal_slope", f"WITH {_newton_sql(True)} SELECT seed, round(a, 6) AS intercept, round(b, 6) AS slope, TRUE AS slope_converged FROM p{STEPS}")
def cal_slope(r):
    return M.calibration_slope(r.predictions, ["seed"])


@query("calibration_halves", """
    WITH h AS (SELECT row_id, seed, y_true, row_number() OVER (PARTITION BY seed, y_true ORDER BY md5('c:' || row_id || ':' || seed), row_id) AS rn,
                      floor(count(*) OVER (PARTITION BY seed, y_true) * 0.5) AS k FROM predictions)
    SELECT row_id, seed, CASE WHEN rn <= k THEN 1 ELSE 0 END AS is_cal FROM h""")
def calibration_halves(r):
    return M.calibration_halves(r.predictions, "row_id").select("row_id", "seed", "is_cal")


_CAL = f"SELECT seed, ln({_CLIP} / (1 - {_CLIP})) AS z, count(*) AS n, sum(y_true) AS y FROM halves WHERE is_cal = 1 GROUP BY 1, 2"
_FIXED = f"SELECT seed, y_true, 1 / (1 + exp(-(a + b * ln({_CLIP} / (1 - {_CLIP}))))) AS p_raw FROM halves JOIN p{STEPS} USING (seed) WHERE is_cal = 0"


@query("logistic_recalibration", f"""
    WITH halves AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed, y_true ORDER BY md5('c:' || row_id || ':' || seed), row_id)
                                        <= floor(count(*) OVER (PARTITION BY seed, y_true) * 0.5) THEN 1 ELSE 0 END AS is_cal FROM predictions),
    {_newton_sql(True, cells=f"c AS ({_CAL})")}, fixed AS ({_FIXED}),
    {_newton_sql(False, cells=f"d AS (SELECT seed, ln({_CLIP} / (1 - {_CLIP})) AS z, count(*) AS n, sum(y_true) AS y, sum(p_raw) AS sp FROM fixed GROUP BY 1, 2)", c="d", p="q")}
    SELECT d.seed, round(max(a), 6) AS citl, round(sum(sp) / sum(n) - sum(y) / sum(n), 6) AS mean_pred_minus_obs, round(sum(sp) / sum(n), 6) AS mean_pred,
           round(sum(y) / sum(n), 6) AS obs_rate, TRUE AS citl_converged FROM d JOIN q{STEPS} USING (seed) GROUP BY 1""")
def logistic_recalibration(r):
    """Fitted on one half, applied to the other, assessed per repeat."""
    halves = M.calibration_halves(r.predictions, "row_id")
    coefficients = M.logistic_recalibration(halves.where("is_cal = 1"), ["seed"])
    applied = M.apply_logistic(halves.where("is_cal = 0"), coefficients, ["seed"])
    return M.calibration_in_the_large(applied, ["seed"], score="p_corrected")


def _knots_sql(n_knots: int = 20, frac: float = 0.66) -> str:
    """Cells, ranks, knots with their reach and the local fits at them."""
    rows = []
    for i in range(n_knots):
        middle = i / (n_knots - 1)
        low = min(max(middle - frac / 2.0, 0.0), 1.0 - frac)
        rows.append(f"({i}, CAST({middle!r} AS DOUBLE), CAST({low!r} AS DOUBLE), CAST({low + frac!r} AS DOUBLE))")
    value = "max(p) FILTER (r = floor((t - 1) * {}))"
    fit = "CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END"
    return f"""cells AS (SELECT seed, p_raw AS p, count(*) AS n, sum(y_true) AS y FROM predictions GROUP BY 1, 2),
    ranked AS (SELECT seed, p_raw AS p, row_number() OVER (PARTITION BY seed ORDER BY p_raw) - 1 AS r, count(*) OVER (PARTITION BY seed) AS t FROM predictions),
    spots AS (SELECT seed, i, {value.format("m")} AS x0, {value.format("l")} AS lo, {value.format("h")} AS hi FROM ranked CROSS JOIN (VALUES {", ".join(rows)}) v(i, m, l, h) GROUP BY 1, 2),
    reach AS (SELECT seed, i, x0, greatest(x0 - lo, hi - x0, 1e-9) AS h FROM spots),
    near AS (SELECT seed, i, x0, n, y, p - x0 AS x, pow(1 - pow(abs(p - x0) / h, 3), 3) AS w FROM cells JOIN reach USING (seed) WHERE abs(p - x0) / h < 1),
    sums AS (SELECT seed, i, x0, sum(n * w) AS s0, sum(n * w * x) AS s1, sum(n * w * x * x) AS s2, sum(y * w) AS t0, sum(y * w * x) AS t1 FROM near GROUP BY 1, 2, 3),
    fits AS (SELECT seed, x0 AS k, least(1, greatest(0, {fit})) AS g FROM sums)"""


def _read_curve(points: str) -> str:
    """The curve at the points (seed, x): linear between knots, constant outside."""
    return f"""SELECT seed, x, CASE WHEN lk IS NULL THEN rg WHEN rk IS NULL THEN lg ELSE lg + (rg - lg) * (x - lk) / (rk - lk) END AS g
               FROM (SELECT seed, x, max(k) FILTER (k <= x) AS lk, arg_max(g, k) FILTER (k <= x) AS lg, min(k) FILTER (k > x) AS rk, arg_min(g, k) FILTER (k > x) AS rg
                     FROM fits JOIN ({points}) USING (seed) GROUP BY 1, 2)"""


_GRID = "SELECT DISTINCT seed, x FROM predictions CROSS JOIN (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) v(x)"


@query("calibration_curve", f"WITH {_knots_sql()} SELECT seed, x AS p, round(g, 6) AS g FROM ({_read_curve(_GRID)})")
def calibration_curve(r):
    knots = M.calibration_knots(r.predictions, ["seed"])
    return M.calibration_curve(knots, ["seed"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query("calibration_errors", f"""
    WITH {_knots_sql()}, curve AS ({_read_curve("SELECT seed, p AS x FROM cells")}),
    gaps AS (SELECT seed, abs(g - p_raw) AS d FROM predictions JOIN curve USING (seed) WHERE x = p_raw)
    SELECT seed, round(avg(d), 6) AS ici, round(median(d), 6) AS e50, round(quantile_cont(d, 0.9), 6) AS e90 FROM gaps GROUP BY 1""")
def calibration_errors(r):
    return M.calibration_errors(r.predictions, M.calibration_knots(r.predictions, ["seed"]), ["seed"])


# The value at a score is the greatest over all beginnings before it of the least mean over all ends after it.
_ISOTONIC = """
    h AS (SELECT seed, p_raw, y_true, md5('c:' || row_id || ':' || seed) < '8' AS is_cal FROM predictions),
    c AS (SELECT seed, p_raw AS p, count(*) AS n, sum(y_true) AS y FROM h WHERE is_cal GROUP BY 1, 2),
    t AS (SELECT seed, p, row_number() OVER o AS i, sum(n) OVER o AS w, sum(y) OVER o AS s, n, y FROM c WINDOW o AS (PARTITION BY seed ORDER BY p)),
    m AS (SELECT a.seed, a.i AS a, b.i AS b, b.p, min((b.s - a.s + a.y) / (b.w - a.w + a.n)) OVER (PARTITION BY a.seed, a.i ORDER BY b.i DESC) AS least FROM t a JOIN t b ON a.seed = b.seed AND a.i <= b.i),
    g AS (SELECT seed, p, max(least) AS g FROM m GROUP BY 1, 2),
    e AS (SELECT seed, p_raw AS p, count(*) AS n, sum(y_true) AS y FROM h WHERE NOT is_cal GROUP BY 1, 2),
    lo AS (SELECT e.seed, e.p, n, y, g.p AS p0, g.g AS g0 FROM e ASOF LEFT JOIN g ON e.seed = g.seed AND e.p >= g.p),
    both_ AS (SELECT lo.*, g.p AS p1, g.g AS g1 FROM lo ASOF LEFT JOIN g ON lo.seed = g.seed AND lo.p <= g.p),
    v AS (SELECT seed, p, n, y, CASE WHEN p0 IS NULL THEN g1 WHEN p1 IS NULL OR p0 = p THEN g0 ELSE g0 + (g1 - g0) * (p - p0) / (p1 - p0) END AS v FROM both_)"""


def _hashed_halves(r):
    """Halves by the row's hash alone: several rows may bear one number and then share their half."""
    return r.predictions.withColumn("is_cal", (F.md5(F.concat_ws(":", F.lit("c"), "row_id", "seed")) < "8").cast("int"))


@query("isotonic", f"WITH {_ISOTONIC} SELECT seed, round(p, 6) AS p, CAST(sum(n) AS BIGINT) AS n, round(sum(n * v) / sum(n), 6) AS p_corrected FROM v GROUP BY seed, round(p, 6)")
def isotonic(r):
    """Scores corrected by the isotonic fit of the other half, each distinct score with its rows."""
    halves = _hashed_halves(r)
    steps = I.isotonic_fit(halves.where("is_cal = 1"), ["seed"])
    applied = I.apply_isotonic(halves.where("is_cal = 0"), steps, ["seed"])
    return applied.groupBy("seed", F.round("p_raw", 6).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_corrected").alias("p_corrected"))


@query("isotonic_errors", f"WITH {_ISOTONIC} SELECT seed, round(sum(n * v) / sum(n), 6) AS mean_pred, round(sum(y) / sum(n), 6) AS obs_rate, round(sum(n * abs(v - p)) / sum(n), 6) AS mean_shift FROM v GROUP BY 1")
def isotonic_errors(r):
    """Mean corrected score against the observed rate of the half that was not fitted."""
    halves = _hashed_halves(r)
    applied = I.apply_isotonic(halves.where("is_cal = 0"), I.isotonic_fit(halves.where("is_cal = 1"), ["seed"]), ["seed"])
    shift = F.avg(F.abs(F.col("p_corrected") - F.col("p_raw")))
    return applied.groupBy("seed").agg(F.avg("p_corrected").alias("mean_pred"), F.avg("y_true").alias("obs_rate"), shift.alias("mean_shift"))


@query("seed_summary", """
    WITH s AS (SELECT seed, avg(p_raw) - avg(y_true) AS mean_pred_minus_obs, avg(p_raw) AS mean_pred, avg(y_true) AS obs_rate FROM predictions GROUP BY 1),
    u AS (SELECT 'mean_pred_minus_obs' AS metric, mean_pred_minus_obs AS v FROM s UNION ALL SELECT 'mean_pred', mean_pred FROM s UNION ALL SELECT 'obs_rate', obs_rate FROM s)
    SELECT 'raw' AS method, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(v)), 6) AS ci_low,
           round(avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(v)), 6) AS ci_high, count(*) AS n_seeds FROM u GROUP BY 2""")
def seed_summary(r):
    rows = r.predictions.groupBy("seed").agg(F.avg("p_raw").alias("mean_pred"), F.avg("y_true").alias("obs_rate")).withColumn(
        "mean_pred_minus_obs", F.col("mean_pred") - F.col("obs_rate")
    ).withColumn("method", F.lit("raw"))
    return M.summarise_across_seeds(rows)


# ------------------------------------------------------------------ paired tests

GROUPS = {"g1": (("error", "view"),), "g2": (("click", "view"), ("purchase", "view"), ("signup", "view"))}
_PAIRS = "(VALUES ('g1', 'error', 'view'), ('g2', 'click', 'view'), ('g2', 'purchase', 'view'), ('g2', 'signup', 'view')) p(grp, config_a, config_b)"
_DIFF = f"""
    SELECT grp, m AS metric, config_a, config_b, a.feature_window, a.iteration, CASE m WHEN 'auroc' THEN a.auroc - b.auroc ELSE a.auprc - b.auprc END AS d
    FROM {_PAIRS} JOIN results a ON a.config = config_a JOIN results b ON b.config = config_b AND a.feature_window = b.feature_window AND a.iteration = b.iteration
    CROSS JOIN (VALUES ('auroc'), ('auprc')) v(m)"""
_ERFC = "(" + " + ".join(f"{a!r} * power(t, {i})" for i, a in enumerate(ERFC_A, 1)) + ") * exp(-x * x)"
_KEY = "grp, metric, config_a, config_b, feature_window"
_WILCOXON = f"""
    WITH d AS ({_DIFF}), z AS (SELECT *, round(abs(d), 12) AS ad FROM d WHERE round(d, 12) <> 0),
    k AS (SELECT *, rank() OVER (PARTITION BY {_KEY} ORDER BY ad) + (count(*) OVER (PARTITION BY {_KEY}, ad) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {_KEY}, ad) AS ties FROM z),
    s AS (SELECT {_KEY}, count(*)::DOUBLE AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w, sum(ties * ties - 1)::DOUBLE AS tc FROM k GROUP BY ALL),
    v AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - tc / 48 AS var FROM s),
    x AS (SELECT *, CASE WHEN var > 0 THEN abs((w - n * (n + 1) / 4) / sqrt(var)) / sqrt(2.0) END AS x FROM v),
    t AS (SELECT *, 1 / (1 + {ERFC_P!r} * x) AS t FROM x),
    wt AS (SELECT {_KEY}, n, w, coalesce(least(1.0, {_ERFC}), 1.0) AS p FROM t)"""


@query("paired_diff", f"SELECT grp, metric, config_a, config_b, feature_window, iteration, round(d, 6) AS d FROM ({_DIFF})")
def paired_diff(r):
    return P.paired_diff(r.results, P.pair_table(r.spark, GROUPS), check_seeds=True)


@query("wilcoxon", f"""{_WILCOXON} SELECT {_KEY}, CAST(coalesce(n, 0) AS BIGINT) AS n_used, round(coalesce(w, 0), 6) AS w_plus, round(coalesce(p, 1), 6) AS p_value
    FROM (SELECT DISTINCT {_KEY} FROM d) LEFT JOIN wt USING ({_KEY})""")
def wilcoxon(r):
    diffs = P.paired_diff(r.results, P.pair_table(r.spark, GROUPS))
    return P.wilcoxon(diffs, _KEY.split(", "))


_TESTS = f"""{_WILCOXON}, a AS (SELECT {_KEY}, count(*) AS n_pairs, quantile_cont(d, 0.25) AS q1, median(d) AS median, quantile_cont(d, 0.75) AS q3, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS share_positive FROM d GROUP BY ALL),
    j AS (SELECT a.*, coalesce(p, 1) AS pw FROM a LEFT JOIN wt USING ({_KEY})),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp, metric ORDER BY pw) AS rk, count(*) OVER (PARTITION BY grp, metric) AS m FROM j),
    b AS (SELECT *, least(1.0, min(pw * m / rk) OVER (PARTITION BY grp, metric ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS pb FROM r)"""


@query("paired_tests", f"""{_TESTS} SELECT {_KEY}, n_pairs, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(share_positive, 6) AS share_positive,
    round(pw, 6) AS p_wilcoxon, m AS bh_group_size, round(pb, 6) AS p_bh, CASE WHEN pb < 0.05 THEN 1 ELSE 0 END AS sig_bh FROM b""")
def paired_tests(r):
    return P.paired_tests(r.results, GROUPS)


@query("subtype_paired_tests", f"""{_TESTS.replace('PARTITION BY grp, metric ORDER', 'PARTITION BY metric, feature_window ORDER').replace('PARTITION BY grp, metric)', 'PARTITION BY metric, feature_window)')}
    SELECT {_KEY}, round(pw, 6) AS p_wilcoxon, m AS bh_group_size, round(pb, 6) AS p_bh FROM b""")
def subtype_paired_tests(r):
    out = P.paired_tests(r.results, GROUPS, family=("metric", "feature_window"))
    return out.select(*_KEY.split(", "), "p_wilcoxon", "bh_group_size", "p_bh")


@query("bh_adjust", """
    WITH p AS (SELECT l_linenumber AS family, l_suppkey AS id, min(l_discount) + avg(l_tax) / 10 AS p FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p)
    SELECT family, id, round(p, 6) AS p, m AS bh_group_size, round(least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_bh FROM r""")
def bh_adjust(r):
    p = r.table("lineitem").groupBy(F.col("l_linenumber").alias("family"), F.col("l_suppkey").alias("id")).agg(
        (F.min("l_discount") + F.avg("l_tax") / 10).alias("p")
    )
    out = P.benjamini_hochberg(p, ["family"], "p")
    return out.withColumns({c: rounded(F.col(c)) for c in ("p", "p_bh")})  # many means lie on half of the sixth digit


@query("estimator_comparison", """
    WITH e AS (SELECT config, feature_window, median(auroc) AS m FROM results GROUP BY 1, 2)
    SELECT config, feature_window, round(m, 6) AS median, round(round(m, 3), 6) AS expected_median, CASE WHEN abs(m - round(m, 3)) > 0.0004 THEN 1 ELSE 0 END AS n_off FROM e""")
def estimator_comparison(r):
    med = exact_quantiles(r.results, ["config", "feature_window"], "auroc", {"median": 0.5}).drop("n_values")
    expected = med.withColumn("median", F.round("median", 3))
    return P.compare_to_expected(med, expected, ["config", "feature_window"], ["median"], 4e-4)


def second_estimator(r):
    """The scores that another statistic of the same events gives on the same repeats."""
    k = F.get_json_object("props", "$.k").cast("int")
    iteration = F.col("user_id") % 100
    return r.table("events").groupBy(
        F.col("event_type").alias("config"), F.concat(F.lit("w"), (k % 6).cast("string")).alias("feature_window"), iteration.alias("iteration"), (F.lit(42) + iteration * 1000).alias("seed")
    ).agg((F.min("value") / 499).alias("auroc"), (F.max("value") / 499 - F.avg("value") / 997).alias("auprc"))


_SECOND = """
    s AS (SELECT event_type AS config, 'w' || (k % 6) AS feature_window, user_id % 100 AS iteration, min(value) / 499 AS auroc, max(value) / 499 - avg(value) / 997 AS auprc
          FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY 1, 2, 3),
    d AS (SELECT m AS metric, a.config, a.feature_window, CASE m WHEN 'auroc' THEN a.auroc ELSE a.auprc END AS x, CASE m WHEN 'auroc' THEN s.auroc ELSE s.auprc END AS y
          FROM results a JOIN s ON s.config = a.config AND s.feature_window = a.feature_window AND s.iteration = a.iteration CROSS JOIN (VALUES ('auroc'), ('auprc')) v(m))"""


@query("estimators_on_shared_splits", f"""
    WITH {_SECOND} SELECT metric, config, feature_window, count(*) AS n_pairs, round(quantile_cont(y - x, 0.25), 6) AS q1, round(median(y - x), 6) AS median, round(quantile_cont(y - x, 0.75), 6) AS q3,
           round(avg(x), 6) AS mean_first, round(avg(y), 6) AS mean_second, round(avg(CASE WHEN y - x > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive, count(*) OVER (PARTITION BY metric) AS bh_group_size
    FROM d WHERE y - x IS NOT NULL GROUP BY 1, 2, 3""")
def estimators_on_shared_splits(r):
    return P.compare_estimators(r.results, second_estimator(r)).drop("p_wilcoxon", "p_bh")


# ------------------------------------------------------------------ reports


def person_table(r):
    return r.cohort.select("person_id", "label", "age_at_index", "followup_days", "is_inpatient", (F.col("gender_concept_id") == 8532).cast("int").alias("female"))


def _cont(c):
    return f"""SELECT '{c}' AS characteristic, arm, CAST(CAST(round_even(median(v), 0) AS BIGINT) AS VARCHAR) || ' (' || CAST(round_even(quantile_cont(v, 0.25), 0) AS BIGINT) || '-' || CAST(round_even(quantile_cont(v, 0.75), 0) AS BIGINT) || ')' AS txt
              FROM (SELECT arm, {c} AS v FROM t) GROUP BY 2"""


def _bin(c):
    return f"SELECT '{c}' AS characteristic, arm, CAST(CAST(sum({c}) AS BIGINT) AS VARCHAR) || ' (' || printf('%.1f', round(100.0 * avg({c}), 1)) || '%)' AS txt FROM t GROUP BY 2"


_T1 = """WITH b AS (SELECT label, age_at_index, followup_days, is_inpatient, CASE WHEN gender_concept_id = 8532 THEN 1 ELSE 0 END AS female FROM cohort),
    t AS (SELECT *, 'overall' AS arm FROM b UNION ALL SELECT *, CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END FROM b)"""


@query("table_one", f"""{_T1}, u AS ({_cont('age_at_index')} UNION ALL {_cont('followup_days')} UNION ALL {_bin('is_inpatient')} UNION ALL {_bin('female')})
    SELECT characteristic, max(txt) FILTER (arm = 'overall') AS overall, max(txt) FILTER (arm = 'pos') AS pos, max(txt) FILTER (arm = 'neg') AS neg FROM u GROUP BY 1""")
def table_one(r):
    return T.table_one(person_table(r), ["age_at_index", "followup_days"], ["is_inpatient", "female"])


def _smd(c, kind):
    pbar = f"(avg({c}) FILTER (label = 1) + avg({c}) FILTER (label = 0)) / 2"
    spread = f"sqrt((var_samp({c}) FILTER (label = 1) + var_samp({c}) FILTER (label = 0)) / 2)" if kind == "cont" else f"sqrt({pbar} * (1 - {pbar}))"
    return f"SELECT '{c}' AS characteristic, '{kind}' AS kind, round((avg({c}) FILTER (label = 1) - avg({c}) FILTER (label = 0)) / {spread}, 6) AS smd FROM b"


@query("smd", f"{_T1} {_smd('age_at_index', 'cont')} UNION ALL {_smd('followup_days', 'cont')} UNION ALL {_smd('is_inpatient', 'bin')} UNION ALL {_smd('female', 'bin')}")
def smd(r):
    return T.smd(person_table(r), ["age_at_index", "followup_days"], ["is_inpatient", "female"])


@query("race_buckets", """
    SELECT c.person_id, CASE WHEN lower(e.r_name) LIKE '%hispanic%' AND lower(e.r_name) NOT LIKE '%not hispanic%' THEN 'Hispanic / Latino' WHEN lower(n_name) LIKE '%white%' THEN 'Non-Hispanic white'
           WHEN lower(n_name) LIKE '%black%' OR lower(n_name) LIKE '%african%' THEN 'Non-Hispanic black' ELSE 'Asian / other / unknown' END AS race_bucket
    FROM (SELECT person_id FROM person) c JOIN (SELECT c_custkey, r_regionkey, CASE WHEN r_regionkey = 1 THEN 'Hispanic or Latino' WHEN r_regionkey = 2 THEN 'Not Hispanic' ELSE r_name END AS r_name,
        CASE WHEN n_nationkey % 4 = 0 THEN 'White' WHEN n_nationkey % 4 = 1 THEN 'African American' ELSE n_name END AS n_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = c_custkey % 5) e
      ON e.c_custkey = c.person_id""")
def race_buckets(r):
    n, g = F.col("n_nationkey"), F.col("r_regionkey")
    names = r.table("nation").select(
        (n + 3_000_000).cast("long").alias("concept_id"),
        F.when(n % 4 == 0, "White").when(n % 4 == 1, "African American").otherwise(F.col("n_name")).alias("concept_name"),
    ).unionByName(r.table("region").select(
        (g + 4_000_000).cast("long").alias("concept_id"),
        F.when(g == 1, "Hispanic or Latino").when(g == 2, "Not Hispanic").otherwise(F.col("r_name")).alias("concept_name"),
    ))
    return T.race_buckets(r.person, names)


_MATRIX = "(SELECT l_linenumber AS win, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS q, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS d FROM lineitem)"


@query("missingness", f"""
    SELECT win, 'q' AS lab, round(100.0 * (1 - avg(q)), 6) AS pct_missing, 'recorded' AS status FROM {_MATRIX} GROUP BY 1 UNION ALL SELECT win, 'd', round(100.0 * (1 - avg(d)), 6), 'recorded' FROM {_MATRIX} GROUP BY 1
    UNION ALL SELECT DISTINCT win, 'zz', NULL, 'not recorded' FROM {_MATRIX}""")
def missingness(r):
    m = r.table("lineitem").select(
        F.col("l_linenumber").alias("window"), (F.col("l_quantity") > 10).cast("int").alias("f_lab_q_measured"),
        (F.col("l_discount") > 0.05).cast("int").alias("f_lab_d_measured"),
    )
    return T.missingness_by_window(m, ["q", "d", "zz"]).withColumnRenamed("window", "win")


@query("scalars", """
    WITH s AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p, 100.0 * avg(label) AS pct, quantile_cont(age_at_index, 0.25) AS a, quantile_cont(age_at_index, 0.5) AS b, quantile_cont(age_at_index, 0.75) AS c, quantile_cont(age_at_index, 0.95) AS d FROM cohort)
    SELECT 'n_total' AS name, n AS value FROM s UNION ALL SELECT 'n_pos', p FROM s UNION ALL SELECT 'prevalence_pct', round(pct, 6) FROM s UNION ALL SELECT 'age_at_index_p25', round(a, 6) FROM s
    UNION ALL SELECT 'age_at_index_p50', round(b, 6) FROM s UNION ALL SELECT 'age_at_index_p75', round(c, 6) FROM s UNION ALL SELECT 'age_at_index_p95', round(d, 6) FROM s""")
def scalars(r):
    return T.scalars(r.cohort, ["age_at_index"])


@query("results_summary", """
    WITH u AS (SELECT config, feature_window, 'auroc' AS metric, auroc AS v FROM results UNION ALL SELECT config, feature_window, 'auprc', auprc FROM results)
    SELECT config, feature_window, metric, count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM u GROUP BY 1, 2, 3""")
def results_summary(r):
    return T.summary_table(r.results, ["config", "feature_window"])


@query("lift_table", """
    WITH m AS (SELECT config, feature_window, median(auroc) AS m FROM results GROUP BY 1, 2)
    SELECT a.config, a.feature_window, round(a.m, 6) AS median, round(b.m, 6) AS reference_median, round(a.m - b.m, 6) AS lift FROM m a JOIN m b ON b.config = 'view' AND a.feature_window = b.feature_window WHERE a.config <> 'view'""")
def lift_table(r):
    return T.lift_table(r.results, "view")


def _selections(r):
    """An order is a repeat; its parts' brands are the selected features."""
    rows = r.lines.join(r.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("o_orderkey", F.col("l_linestatus").alias("cluster")).agg(F.collect_set("p_brand").alias("features"))


_SEL = """SELECT cluster, b AS feature, coalesce(n, 0) AS n_selected, CASE WHEN coalesce(n, 0) >= 50 THEN 1 ELSE 0 END AS kept
    FROM (SELECT DISTINCT l_linestatus AS cluster FROM lineitem) CROSS JOIN (SELECT DISTINCT p_brand AS b FROM part UNION ALL SELECT 'Brand#99')
    LEFT JOIN (SELECT l_linestatus AS cluster, p_brand AS b, count(DISTINCT l_orderkey) AS n FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) USING (cluster, b)"""


def _frequency(r):
    brands = r.table("part").select(F.col("p_brand").alias("feature")).distinct().unionByName(r.spark.range(1).select(F.lit("Brand#99").alias("feature")))
    clusters = r.table("lineitem").select(F.col("l_linestatus").alias("cluster")).distinct()
    offered = brands.select("feature", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("cluster")).join(clusters, "cluster")
    return T.selection_frequency(_selections(r), ["cluster"], offered)


@query("selection_frequency", _SEL)
def selection_frequency(r):
    return _frequency(r)


@query("offered_and_kept", f"SELECT cluster, count(*) AS offered, CAST(sum(kept) AS BIGINT) AS kept FROM ({_SEL}) GROUP BY 1")
def offered_and_kept(r):
    return T.offered_and_kept(_frequency(r), ["cluster"])


_IMP = "SELECT 'w' || l_linenumber AS win, p_brand AS feature, sum(abs(l_discount - 0.05)) / 100 AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def _importance(r):
    rows = r.table("lineitem").join(r.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("w"), F.col("l_linenumber")).alias("window"), F.col("p_brand").alias("feature"), (F.col("l_discount") - 0.05).alias("importance")
    )
    return T.mean_abs_importance(rows, ["window"])


@query("mean_abs_importance", f"SELECT win, feature, round(m, 6) AS mean_abs FROM ({_IMP})")
def mean_abs_importance(r):
    return _importance(r).withColumnRenamed("window", "win")


@query("top_features", f"""
    WITH i AS ({_IMP}), k AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY round(m, 9) DESC, feature) AS rn FROM i WHERE win IN ('w1', 'w3'))
    SELECT DISTINCT k.feature, round(i.m, 6) AS mean_abs FROM k JOIN i ON i.feature = k.feature AND i.win = 'w1' WHERE rn <= 5""")
def top_features(r):
    return T.top_features(_importance(r).withColumn("mean_abs", F.round("mean_abs", 9)), ["w1", "w3"], "w1", 5)
