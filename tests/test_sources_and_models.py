import random

import pytest
from pyspark.sql import functions as F

from days import day
from eventloom import session
from eventloom.operators import models as M
from eventloom.session import checkpoint_dir, materialise
from eventloom.sources import results as S
from eventloom.sources import warehouse as R


def test_event_scan_reads_only_used_columns(spark, tmp_path):
    rows = [(7, 1, 5, day(3), 1.5, "x", "unused")]
    schema = "measurement_id BIGINT, person_id BIGINT, measurement_concept_id INT, measurement_date DATE, value_as_number DOUBLE, measurement_source_value STRING, note STRING"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "measurement"))
    events = R.read_events(spark, str(tmp_path), "measurement")
    row = events.first()
    assert (row.person_id, row.event_id, row.concept_id, row.value, row.source_text, row.domain) == (1, 7, 5, 1.5, "x", "measurement")
    plan = events.where("concept_id = 5").select("person_id")._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan and "value_as_number" not in plan and "measurement_concept_id" in plan


def test_death_column_is_detected(spark):
    a = spark.createDataFrame([(1, day(3)), (1, day(2))], "person_id BIGINT, death_date DATE")
    b = a.select("person_id", F.col("death_date").cast("timestamp").alias("death_datetime"))
    assert R.death_dates(a).first().death_date == R.death_dates(b).first().death_date == day(2)
    with pytest.raises(ValueError):
        R.death_dates(a.select("person_id"))


def test_cohort_roundtrip_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, day(0), day(21), 0), (2, day(5), day(1), 1)], "PERSON_ID INT, acute_start DATE, acute_end DATE, is_inpatient INT")
    S.write_cohort(df, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="2"):
        R.load_cohort(spark, str(tmp_path / "c"))
    S.write_cohort(df.where("PERSON_ID = 1"), str(tmp_path / "c"))
    good = R.load_cohort(spark, str(tmp_path / "c"))
    assert dict(good.dtypes)["person_id"] == "bigint" and good.count() == 1
    df.drop("acute_end").write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="acute_end"):
        R.load_cohort(spark, str(tmp_path / "d"))


def test_matrix_windows_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "m")
    S.write_matrix(spark.createDataFrame([(1, "w0_21", 1), (1, "w0_90", 2)], "person_id INT, window STRING, a INT"), path)
    S.write_matrix(spark.createDataFrame([(1, "w0_90", 9)], "person_id INT, window STRING, a INT"), path)
    assert {r.window: r.a for r in spark.read.parquet(path).collect()} == {"w0_21": 1, "w0_90": 9}
    assert R.read_matrix(spark, path, {"c": ["a"]}, ["window"]).columns == ["person_id", "window", "a"]
    with pytest.raises(ValueError, match="zz"):
        R.read_matrix(spark, path, {"c": ["zz"]})


def test_families_and_results(spark, tmp_path):
    S.write_families(spark, {"f": ["b", "a"], "g": []}, str(tmp_path / "f"))
    assert S.read_families(spark, str(tmp_path / "f")) == {"f": ["b", "a"]}
    rows = spark.createDataFrame([("c", "w", i, 0.5) for i in range(3)], "config STRING, feature_window STRING, iteration INT, auroc DOUBLE")
    for i in (2, 0, 1):
        rows.where(f"iteration = {i}").write.option("header", True).csv(str(tmp_path / f"iterations_{i}"))
    back = S.read_result_files(spark, [str(tmp_path / "iterations_*")])
    assert [r.iteration for r in back.collect()] == [0, 1, 2]
    grid = spark.createDataFrame([("c", i) for i in range(5)], "config STRING, iteration INT")
    assert sorted(r.iteration for r in S.pending_runs(grid, back, ["config", "iteration"]).collect()) == [3, 4]
    S.write_results(rows, str(tmp_path / "r"))
    S.write_results(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    with pytest.raises(ValueError):
        S.count_guard(rows.withColumn("label", F.lit(1)), (3, 2))


def test_materialise_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return str(tmp_path) if key == "spark.checkpoint.dir" else default

    assert checkpoint_dir(spark).startswith("/tmp/")
    assert checkpoint_dir(Cluster()) == str(tmp_path)
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    out = materialise(spark.range(5), "t")
    assert out.count() == 5 and str(tmp_path) in out.inputFiles()[0]


# ------------------------------------------------------------------ models


@pytest.fixture(scope="module")
def matrix(spark):
    import math

    rnd = random.Random(11)
    rows = []
    for i in range(600):
        x = [rnd.gauss(0, 1) for _ in range(3)] + [int(rnd.random() < 0.3) for _ in range(2)] + [int(rnd.random() < 0.005)]
        z = 2.0 * x[0] - x[3] - 1.0
        rows.append((i, int(rnd.random() < 1 / (1 + math.exp(-z))), i % 3, *map(float, x)))
    return spark.createDataFrame(rows, "person_id BIGINT, label INT, site INT, x0 DOUBLE, x1 DOUBLE, x2 DOUBLE, b0 DOUBLE, b1 DOUBLE, rare DOUBLE").cache()


FEATURES = ["x0", "x1", "x2", "b0", "b1", "rare"]


def test_shadows_are_permutations(spark, matrix):
    out = M.add_shadows(matrix, ["x0", "b0"], 5)
    a, b = zip(*[(r.x0, r.shadow_x0) for r in out.select("x0", "shadow_x0").collect()])
    assert sorted(a) == sorted(b) and a != b
    assert out.select(F.corr("x0", "shadow_x0")).first()[0] == pytest.approx(0, abs=0.15)


def test_seeded_repeat_is_reproducible_and_keeps_forced(spark, matrix):
    settings = M.RepeatSettings(grid={"numTrees": (8,), "maxDepth": (3,)}, n_folds=2, selection_rounds=10, selection_trees=8, forced=("rare",))
    one = M.run_repeat(matrix, FEATURES, 2, "RF", settings)
    two = M.run_repeat(matrix.repartition(5), FEATURES, 2, "RF", settings, selected=one.features)
    assert one.seed == 2042 and "rare" in one.features and "x0" in one.features
    assert one.n_features_before == 6 and one.auroc > 0.7 and two.n_features_selected == len(one.features)
    importance = {r.feature: r.importance for r in M.permutation_importance(one).collect()}
    assert max(importance, key=importance.get) == "x0" and set(importance) == set(one.features)
    test_ids = {r.person_id for r in one.predictions.collect()}
    assert test_ids == {r.person_id for r in two.predictions.collect()} and len(test_ids) == 120


def test_cross_site_pairs(spark, matrix):
    rows = M.cross_site(matrix, ["x0", "b0"], "site", kinds=("LR",)).collect()
    assert {(r.train_site, r.test_site) for r in rows} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert all(r.auroc > 0.6 for r in rows)


def test_subtypes_need_enough_positives(spark, matrix):
    labels = matrix.select("person_id", F.col("label").alias("a"), F.lit(0).alias("b"))
    assert M.subtype_labels_for(matrix, labels, "a") is not None
    assert M.subtype_labels_for(matrix, labels, "b") is None
