"""Ranks, skew handling, sampling, metrics and tests against brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from eventloom.functions.ranks import exact_quantiles, running_totals, value_range
from eventloom.functions.sampling import flag_first_k, with_hash
from eventloom.functions.skew import lookup_join, salted_join
from eventloom.operators import metrics as M
from eventloom.operators import paired as P
from eventloom.operators import repeats as R
from eventloom.operators import reports as T


def quantile(values, q):
    values = sorted(values)
    pos = (len(values) - 1) * q
    lo, hi = math.floor(pos), math.ceil(pos)
    return values[lo] + (values[hi] - values[lo]) * (pos - lo)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e7])
def test_quantiles_of_a_dominant_group(spark, scale):
    rnd = random.Random(3)
    groups = {"hot": [rnd.gauss(0, 1) * scale for _ in range(3000)], "cold": [rnd.choice([1.0, 2.0, 2.0]) for _ in range(40)], "one": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, v DOUBLE")
    out = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.25, "m": 0.5, "z": 0.999}).collect()}
    for g, vs in groups.items():
        assert out[g].n_values == len(vs)
        for name, q in (("a", 0.25), ("m", 0.5), ("z", 0.999)):
            assert out[g][name] == pytest.approx(quantile(vs, q), rel=1e-9, abs=1e-12 * scale)


def test_quantiles_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 7.0), ("a", None)], "g STRING, v DOUBLE")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 3.0
    assert {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 7.0}


def test_value_ranges_rise_with_the_value(spark):
    values = sorted([0.0, -0.0, 1e-12, -1e-12, 0.1, 0.10001, 5, -5, 1e9, -1e9, 1e308, -1e308, float("inf"), float("-inf"), float("nan")], key=lambda v: (v != v, v))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i INT, v DOUBLE").select("i", value_range(F.col("v")).alias("r"))
    ranges = [r.r for r in rows.orderBy("i").collect()]
    assert ranges == sorted(ranges)


def test_running_totals(spark):
    df = spark.createDataFrame([("a", float(v), v % 3, 1) for v in range(-50, 50)], "g STRING, v DOUBLE, x INT, n INT")
    for r in running_totals(df, ["g"], "v", ["x", "n"]).collect():
        assert r.n_before == r.v + 50 and r.n_total == 100
        assert r.x_before == sum(v % 3 for v in range(-50, int(r.v)))


def test_heavy_keys_are_split_and_nothing_is_lost(spark):
    facts = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1000), (3, 1001)], "k INT, id INT")
    other = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k INT, t STRING")
    want = sorted(map(tuple, facts.join(other, ["k"]).collect()))
    joined = salted_join(facts, other, ["k"], ["id"], heavy_rows=100, fraction=1.0, salts=8)
    assert "_salt" not in joined.columns and sorted(map(tuple, joined.collect())) == want
    assert "explode" in joined._jdf.queryExecution().toString()
    left = salted_join(facts, other, ["k"], ["id"], how="left", heavy_rows=100, fraction=1.0, salts=8)
    assert left.count() == 502 and left.where("t IS NULL").count() == 1
    plain = salted_join(facts, other, ["k"], ["id"], heavy_rows=10_000, fraction=1.0)
    assert "explode" not in plain._jdf.queryExecution().toString()


def test_lookup_join_beyond_the_broadcast_bound(spark):
    facts = spark.createDataFrame([(i % 5, i) for i in range(50)], "k INT, id INT")
    table = spark.createDataFrame([(i, i * 10) for i in range(4)], "k INT, v INT")
    small = sorted(map(tuple, lookup_join(facts, table, ["k"], ["id"]).collect()))
    large = lookup_join(facts, table, ["k"], ["id"], rows=2)
    assert "BroadcastHint" not in large._jdf.queryExecution().logical().toString()
    assert sorted(map(tuple, large.collect())) == small


def test_exact_k_equals_a_global_sort(spark):
    import hashlib

    df = with_hash(spark.range(5000).select(F.col("id").alias("person_id"), F.lit(42).alias("seed")), "person_id", "seed")
    for k in (0, 1, 777, 5000, 9999):
        targets = spark.createDataFrame([(42, k)], "seed INT, k BIGINT")
        got = {r.person_id for r in flag_first_k(df.repartition(7), ["seed"], targets, "take").where("take = 1").collect()}
        order = sorted(range(5000), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        assert got == set(order[:k])


def test_split_and_balance_sizes(spark):
    rows = spark.range(1003).select(F.col("id").alias("person_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = R.stratified_split(rows, [42, 1042])
    counts = {(r.seed, r.label): r.t for r in split.groupBy("seed", "label").agg(F.sum("is_test").alias("t")).collect()}
    assert counts[(42, 1)] + counts[(42, 0)] == 201 and counts[(42, 1)] == 20
    a = {r.person_id for r in split.where("seed = 42 AND is_test = 1").collect()}
    assert a != {r.person_id for r in split.where("seed = 1042 AND is_test = 1").collect()}
    train = split.where("is_test = 0").select("seed", "person_id", "label")
    sizes = {(r.seed, r.label): r["count"] for r in R.balance(train).groupBy("seed", "label").count().collect()}
    assert sizes == {(42, 0): 81, (42, 1): 81, (1042, 0): 81, (1042, 1): 81}
    only = train.where("label = 0")
    assert R.balance(only).count() == only.count()


def test_prevalence_filter_rules(spark):
    df = spark.createDataFrame([(int(i == 0), int(i == 0), i * 0.1, None) for i in range(200)], "rare INT, forced INT, cont DOUBLE, empty DOUBLE")
    kept = R.kept_features(R.prevalence_filter(R.column_profile(df, df.columns), 0.01, ["forced"]), df.columns)
    assert kept == ["forced", "cont", "empty"]


def brute_auroc(y, p):
    pos = [b for a, b in zip(y, p) if a]
    neg = [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(y, p):
    total, out, last = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(a for a, b in zip(y, p) if b >= t)
        out += (tp / total - last) * tp / sum(b >= t for b in p)
        last = tp / total
    return out


def test_ranking_metrics_merge_ties(spark):
    rnd = random.Random(1)
    y = [int(rnd.random() < 0.3) for _ in range(200)]
    p = [round(min(1, max(0, 0.3 * a + rnd.random() * 0.6)), 1) for a in y]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(y, p)] + [(2, 0, 0.5)], "seed INT, y_true INT, p_raw DOUBLE")
    out = {r.seed: r for r in M.ranking_metrics(df, ["seed"]).collect()}
    assert out[1].auroc == pytest.approx(brute_auroc(y, p)) and out[1].auprc == pytest.approx(brute_ap(y, p))
    assert out[2].auroc is None


def _calibrated(n=20000, shift=0.0):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        p = min(0.99, max(0.001, rnd.betavariate(1, 8)))
        z = math.log(p / (1 - p)) + shift
        rows.append((i, 1 + i % 2, int(rnd.random() < p), 1 / (1 + math.exp(-z))))
    return rows


def test_calibration_of_calibrated_and_shifted_scores(spark):
    schema = "row_id BIGINT, seed INT, y_true INT, p_raw DOUBLE"
    good = spark.createDataFrame(_calibrated(), schema)
    row = M.calibration_in_the_large(good, ["seed"]).join(M.calibration_slope(good, ["seed"]), "seed").first()
    assert abs(row.citl) < 0.1 and abs(row.slope - 1) < 0.1 and abs(row.mean_pred_minus_obs) < 0.01
    assert M.calibration_errors(good, M.calibration_knots(good, ["seed"]), ["seed"]).first().ici < 0.02
    bad = spark.createDataFrame(_calibrated(shift=3.0), schema)
    assert M.calibration_in_the_large(bad, ["seed"]).first().citl == pytest.approx(-3.0, abs=0.15)
    halves = M.calibration_halves(bad, "row_id")
    fixed = M.apply_logistic(halves.where("is_cal = 0"), M.logistic_recalibration(halves.where("is_cal = 1"), ["seed"]), ["seed"])
    assert abs(M.calibration_in_the_large(fixed, ["seed"], score="p_corrected").first().citl) < 0.15
    rows = M.net_benefit(good, ["seed"], [0.05, 0.1, 0.2]).collect()
    assert len(rows) == 6 and all(r.net_benefit >= r.treat_all - 1e-9 for r in rows)


def test_single_class_has_no_slope(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.4)], "seed INT, y_true INT, p_raw DOUBLE")
    assert M.calibration_slope(df, ["seed"]).first().slope is None


def test_summary_interval(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 2.0), (2, "b", float("nan"))], "seed INT, method STRING, citl DOUBLE")
    out = {r.method: r for r in M.summarise_across_seeds(df).collect()}
    half = 1.959963984540054 * math.sqrt(2) / math.sqrt(2)
    assert out["a"].mean == 2.0 and out["a"].ci_high == pytest.approx(2 + half)
    assert out["b"].sd == 0.0 and out["b"].ci_low == 2.0


def test_bh_and_signed_rank(spark):
    p = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.001, 0.04, 0.03, 0.5])], "grp STRING, i INT, p DOUBLE")
    out = [round(r.p_bh, 4) for r in P.benjamini_hochberg(p, ["grp"], "p").orderBy("i").collect()]
    assert out == [0.004, 0.0533, 0.0533, 0.5]
    d = spark.createDataFrame([("z", 0.0)] * 5 + [("t", v) for v in (1.0, 2.0, 3.0, -1.0, 0.0, 4.0)], "k STRING, d DOUBLE")
    rows = {r.k: r for r in P.wilcoxon(d, ["k"]).collect()}
    assert rows["z"].p_value == 1.0 and rows["z"].n_used == 0
    assert rows["t"].w_plus == pytest.approx(1.5 + 3 + 4 + 5) and 0 < rows["t"].p_value < 1


def test_paired_tests_on_seeded_results(spark):
    rnd = random.Random(0)
    rows = []
    for w in ("w0_21", "w0_90"):
        for i in range(100):
            base = rnd.gauss(0.8, 0.01)
            rows += [("base", w, i, 42 + 1000 * i, base, base / 2), ("more", w, i, 42 + 1000 * i, base + 0.02 + rnd.gauss(0, 0.002), base / 2)]
    results = spark.createDataFrame(rows, "config STRING, feature_window STRING, iteration INT, seed BIGINT, auroc DOUBLE, auprc DOUBLE")
    out = {(r.metric, r.feature_window): r for r in P.paired_tests(results, {"g": [("more", "base")]}, check_seeds=True).collect()}
    assert len(out) == 4
    r = out[("auroc", "w0_90")]
    assert r.n_pairs == 100 and r.share_positive == 1.0 and r.sig_bh == 1 and r.bh_group_size == 2 and abs(r.median - 0.02) < 0.002
    assert out[("auprc", "w0_90")].p_wilcoxon == 1.0
    bad = results.withColumn("seed", F.when(F.col("config") == "more", 7).otherwise(F.col("seed")))
    with pytest.raises(ValueError, match="seeds differ"):
        P.paired_tests(bad, {"g": [("more", "base")]}, check_seeds=True)


def test_reproduce_or_stop(spark):
    found = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "k STRING, m DOUBLE")
    want = spark.createDataFrame([("a", 0.5002), ("b", 0.71)], "k STRING, m DOUBLE")
    out = P.compare_to_expected(found, want, ["k"], ["m"])
    assert {r.k: r.n_off for r in out.collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        P.reproduce_or_stop(out)


def test_selection_frequency_and_importance(spark):
    s = spark.createDataFrame([("w", ["a", "b"]), ("w", ["a"])], "window STRING, features ARRAY<STRING>")
    offered = spark.createDataFrame([("w", "a"), ("w", "b"), ("w", "c")], "window STRING, feature STRING")
    out = {r.feature: (r.n_selected, r.kept) for r in T.selection_frequency(s, ["window"], offered, keep_min=2).collect()}
    assert out == {"a": (2, 1), "b": (1, 0), "c": (0, 0)}


def test_table_one_text(spark):
    df = spark.createDataFrame([(i % 2, i, int(i < 3)) for i in range(10)], "label INT, age INT, flag INT")
    out = {r.characteristic: r for r in T.table_one(df, ["age"], ["flag"]).collect()}
    assert out["age"].overall == "4 (2-7)" and out["flag"].overall == "3 (30.0%)"
    s = {r.characteristic: r.smd for r in T.smd(df, ["age"], ["flag"]).collect()}
    pos, neg = [1, 3, 5, 7, 9], [0, 2, 4, 6, 8]
    want = (statistics.mean(pos) - statistics.mean(neg)) / math.sqrt((statistics.variance(pos) + statistics.variance(neg)) / 2)
    assert s["age"] == pytest.approx(want)
