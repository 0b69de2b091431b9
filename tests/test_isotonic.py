import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions.ranks import in_range, range_splitters
from eventloom.operators import isotonic as I


def plain_fit(p, y):
    """Greatest over beginnings of the least mean over ends."""
    xs = np.unique(p)
    n, s = np.array([(p == x).sum() for x in xs]), np.array([y[p == x].sum() for x in xs])
    w, c = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(s))
    mean = np.array([[(c[b + 1] - c[a]) / (w[b + 1] - w[a]) if b >= a else np.inf for b in range(len(xs))] for a in range(len(xs))])
    return xs, np.array([max(mean[a, i:].min() for a in range(i + 1)) for i in range(len(xs))])


def shapes(rng, n):
    p = np.round(rng.random(n), 2)
    yield "noisy", p, (rng.random(n) < p).astype(int)
    yield "falling", p, (rng.random(n) < 1 - p).astype(int)
    yield "flat", p, rng.integers(0, 2, n)
    yield "rising", np.arange(n) / n, (np.arange(n) > n // 2).astype(int)
    yield "narrow", 0.5 + rng.integers(0, 90, n) * 1e-9, rng.integers(0, 2, n)
    yield "one", np.full(n, 0.3), rng.integers(0, 2, n)


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_steps_meet_max_min_for_all_keys_at_once(spark, chunk):
    rng = np.random.default_rng(1)
    data = {k: (p, y) for k, p, y in shapes(rng, 120)}
    rows = [(k, float(a), int(b)) for k, (p, y) in data.items() for a, b in zip(p, y)]
    df = spark.createDataFrame([*rows, ("noisy", None, 1), ("noisy", 0.5, None)], "seed STRING, p_raw DOUBLE, y_true INT").repartition(5)
    steps = I.isotonic_fit(df, ["seed"], chunk=chunk)
    queries = {k: np.unique(np.concatenate([p, rng.random(40), [-1.0, 2.0]])) for k, (p, _) in data.items()}
    asked = spark.createDataFrame([(k, float(x), 1) for k, xs in queries.items() for x in xs] + [("noisy", None, 1), ("gone", 0.1, 1)], "seed STRING, p_raw DOUBLE, g INT")
    got = I.apply_isotonic(asked, steps, ["seed"], parts=5)
    assert got.columns == ["seed", "p_raw", "g", "p_corrected"]
    found = {(r.seed, r.p_raw): r.p_corrected for r in got.collect()}
    assert found.pop(("noisy", None)) is None and len(found) == sum(map(len, queries.values()))
    for k, (p, y) in data.items():
        xs, g = plain_fit(p, y)
        want = np.interp(queries[k], xs, g)
        assert np.allclose([found[k, float(x)] for x in queries[k]], want, atol=1e-12), k


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seed INT, p_raw DOUBLE, y_true INT")
    steps = I.isotonic_fit(none, ["seed"])
    assert steps.count() == 0 and I.apply_isotonic(none, steps, ["seed"]).count() == 0


def test_cuts_spread_a_narrow_band(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), (F.lit(0.5) + F.col("id") * 1e-9).alias("v"))
    cuts = range_splitters(rows, ["k"], "v", 16)
    sizes = [r["count"] for r in in_range(rows, cuts, ["k"], "v", "r").groupBy("r").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * min(sizes)


def test_no_frame_over_the_rows_reaches_to_the_end(spark, capsys):
    """Such a frame is summed anew for each row; only the one over the ranges, a row each, may be of this kind."""
    df = spark.createDataFrame([(1, i / 9, i % 2) for i in range(9)], "seed INT, p_raw DOUBLE, y_true INT")
    I.apply_isotonic(df, I.isotonic_fit(df, ["seed"]), ["seed"]).explain("extended")
    frames = [s for s in capsys.readouterr().out.split("\n") if "windowspecdefinition" in s and "unboundedfollowing" in s.lower()]
    assert frames and all("_from_right" in s for s in frames)
