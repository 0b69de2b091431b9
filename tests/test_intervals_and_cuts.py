import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from days import day
from eventloom.functions import intervals as I
from eventloom.functions.ranks import suffix_minima
from eventloom.functions.sampling import cut_in_parts, flag_first_k
from eventloom.operators import paired, repeats


def made(spark, seed=3, n=300):
    rng = random.Random(seed)
    visits = [(1 if i % 2 else rng.randint(2, 6), i, day(rng.randint(0, 900)), None) for i in range(n)]
    visits = [(p, i, s, s + dt.timedelta(days=rng.choice([0, 1, 5, 40, 400]))) for p, i, s, _ in visits]
    visits += [(1, n, day(100), dt.date(9999, 12, 31)), (2, n + 1, day(50), day(40)), (3, n + 2, None, day(9)), (None, n + 3, day(1), day(9))]
    rows = [(rng.choice([1, 1, 1, 2, 3, 7]), k, day(rng.randint(-50, 1000))) for k in range(n)] + [(None, -1, day(5)), (1, -2, None)]
    return (
        spark.createDataFrame(visits, "person_id BIGINT, v INT, s DATE, e DATE"), visits,
        spark.createDataFrame(rows, "person_id BIGINT, k INT, d DATE"), rows,
    )


@pytest.mark.parametrize("days, slice_rows", [(1, 10**6), (32, 10**6), (32, 3), (10_000, 5)])
def test_dates_in_intervals_and_overlaps_meet_all_pairs(spark, days, slice_rows):
    vdf, visits, rdf, rows = made(spark)
    got = sorted(r.k for r in I.inside_any(rdf, vdf, ["person_id"], "d", "s", "e", days, slice_rows).collect())
    assert got == sorted(k for p, k, d in rows if p and d and any(q == p and s and s <= d <= e for q, _, s, e in visits))
    own = [(p, day(60 * p), day(60 * p + 100)) for p in range(1, 7)]
    odf = spark.createDataFrame(own, "person_id BIGINT, a DATE, b DATE")
    got = sorted((r.person_id, r.v) for r in I.overlaps(vdf, odf, ["person_id"], "s", "e", "a", "b", days, slice_rows).collect())
    assert got == sorted((p, v) for p, v, s, e in visits for q, a, b in own if p == q and s and s <= b and e >= a)


def test_a_person_with_half_of_all_visits_is_spread(spark):
    # the rows that each (person, bucket, slice) holds are what a task gets at most
    visits = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("person_id"), F.col("id").alias("v"), F.expr("date_add(date'2020-01-01', cast(id % 64 as int))").alias("s"))
    few = visits.select("person_id", F.lit(dt.date(2020, 1, 1)).alias("a"), F.lit(dt.date(2020, 3, 1)).alias("b")).distinct()
    dealt = I.in_buckets(visits.withColumn("e", F.col("s")), "s", "e", I.reach(few, F.col("a"), F.col("b")))
    left, right = I.sliced(dealt, few.withColumn("_bucket", I.bucket_of("a")), ["person_id", "_bucket"], ["v"], slice_rows=500)
    sizes = [r["count"] for r in left.groupBy("person_id", "_bucket", "_slice").count().collect()]
    assert max(sizes) <= 2 * 500 and sum(sizes) == left.count() and left.select("_slice").distinct().count() > 10
    spread = left.repartition(16, "person_id", "_bucket", "_slice").groupBy(F.spark_partition_id()).count().collect()
    counts = sorted(r["count"] for r in spread)
    assert counts[-1] <= 2 * counts[len(counts) // 2]


def test_parts_differ_by_one_row_and_edges_alone_are_ordered(spark):
    df = spark.range(1003).select(F.col("id").alias("person_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit(42).alias("seed"))
    out = repeats.folds(df, 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in out if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    hashed = df.withColumn("_hash", F.md5(F.col("person_id").cast("string")))
    got = {r.person_id: r.part for r in cut_in_parts(hashed, ["label"], 7, "part").collect()}
    for label in (0, 1):
        order = [r.person_id for r in hashed.where(F.col("label") == label).orderBy("_hash").collect()]
        assert [got[i] for i in order] == [k * 7 // len(order) for k in range(len(order))]
    # rows with one hash prefix are at the edge altogether
    same = df.withColumn("_hash", F.concat(F.lit("0000"), F.lpad(F.col("person_id").cast("string"), 6, "0")))
    targets = spark.createDataFrame([(0, 100), (1, 5000)], "label INT, k BIGINT")
    taken = flag_first_k(same, ["label"], targets, "f").where("f = 1")
    assert taken.where("label = 0").count() == 100 and taken.where("label = 1").count() == 101
    assert taken.where("label = 0").agg(F.max("person_id")).first()[0] == 111


def test_step_up_meets_its_definition_and_is_spread(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(p)) for g in ("a", "b") for p in np.round(rng.random(400) ** 3, 3)] + [("a", None), (None, 0.01), (None, 0.02)]
    got = paired.benjamini_hochberg(spark.createDataFrame(rows, "grp STRING, p DOUBLE"), ["grp"], "p").collect()
    for g in ("a", "b", None):
        p = np.sort([x for h, x in rows if h == g and x is not None])
        adj = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        want = {x: min(1.0, adj[np.searchsorted(p, x)]) for x in p}
        mine = [r for r in got if r.grp == g and r.p is not None]
        assert len(mine) == len(p) and all(r.p_bh == pytest.approx(want[r.p]) and r.bh_group_size == len(p) for r in mine)
    assert [r.p_bh for r in got if r.p is None] == [None]
    big = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") / 200_000.0).alias("p"), F.rand(1).alias("m"))
    out = suffix_minima(big, ["g"], "p", "m", "low")
    # the pass over one family is cut into ranges, none of which holds more than a small part of it
    from eventloom.functions.ranks import value_range

    sizes = [r["count"] for r in big.groupBy(value_range(F.col("p"))).count().collect()]
    assert len(sizes) > 500 and max(sizes) < 2_000
    top = out.orderBy(F.desc("p")).limit(50).collect()
    assert all(b.low <= a.low for a, b in zip(top, top[1:]))
