import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom import session
from eventloom.functions.sampling import with_rank
from eventloom.operators import blocks, models
from eventloom.operators.assemble import join_blocks
from eventloom.operators.windows import within_cohort_dates


def test_cohort_dates_reach_the_files(spark, tmp_path, cohort):
    rows = [(i, 1, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(900)]
    spark.createDataFrame(rows, "event_id BIGINT, person_id BIGINT, event_date DATE").write.parquet(str(tmp_path / "e"))
    near = within_cohort_dates(spark.read.parquet(str(tmp_path / "e")), cohort, [(-5, 10), (0, 21)])
    plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(event_date,2020-12-27)" in plan and "LessThanOrEqual(event_date,2021-01-22)" in plan
    assert near.count() == 27
    assert within_cohort_dates(near, cohort.limit(0), [(0, 1)]).count() == 0


def test_a_visit_without_end_is_not_unfolded(spark):
    visits = spark.createDataFrame([(1, dt.date(2021, 1, 1), dt.date(9999, 12, 31)), (2, dt.date(2021, 1, 5), dt.date(2021, 1, 6))], "person_id BIGINT, event_date DATE, visit_end DATE")
    rows = spark.createDataFrame([(1, dt.date(2024, 5, 5)), (1, dt.date(2020, 5, 5)), (2, dt.date(2021, 1, 6)), (2, dt.date(2021, 1, 7))], "person_id BIGINT, event_date DATE")
    assert sorted(map(tuple, blocks.during_visits(rows, visits).collect())) == [(1, dt.date(2024, 5, 5)), (2, dt.date(2021, 1, 6))]


def test_ranks_are_whole_and_shadows_permute_all_rows(spark):
    n = 9000
    df = spark.range(n).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"), F.md5(F.col("id").cast("string")).alias("h"))
    ranks = Counter((r.g, r.r) for r in with_rank(df, ["g"], "h", "r").collect())
    assert set(ranks.values()) == {1} and {r for _, r in ranks} == set(range(1, n // 3 + 1))
    got = models.add_shadows(df.select("person_id", "x"), ["x"], 7).collect()
    assert sorted(r.shadow_x for r in got) == [float(i) for i in range(n)]
    # donors come from everywhere, not from a neighbourhood
    assert sum(abs(r.x - r.shadow_x) > n / 4 for r in got) > n / 3


def test_grids_are_whole():
    cells = lambda g: len(list(g["elementNames"])) if "elementNames" in g else __import__("math").prod(map(len, g.values()))
    assert cells(models.LOGISTIC_GRID) == 12 and cells(models.BOOSTED_GRID) == 36 and cells(models.FOREST_GRID) == 36
    assert models.RepeatSettings().grid is None


def test_model_queries_ask_for_the_whole_job(monkeypatch):
    from types import SimpleNamespace

    from eventloom.queries import q_models

    asked = []

    def repeat(matrix, features, iteration, kind="RF", settings=None, selected=None, **_):
        asked.append((kind, settings, selected))
        return SimpleNamespace(auroc=0.5)

    def repeats(matrices, configs, n_repeats, kinds=("RF",), settings=None, **_):
        assert n_repeats > 1
        asked.extend((k, settings, None) for k in kinds)
        return SimpleNamespace(select=lambda *_: None)

    def select(train, features, seed, **other):
        assert set(other) <= {"forced"}
        return list(features)

    def sites(matrix, features, site_col, **other):
        assert not other

    frame = SimpleNamespace(fillna=lambda *_: None, select=lambda *_: None)
    for name, value in {"run_repeat": repeat, "run_repeats": repeats, "shadow_select": select, "cross_site": sites}.items():
        monkeypatch.setattr(q_models.M, name, value)
    monkeypatch.setattr(q_models.M, "permutation_importance", lambda result: None)
    monkeypatch.setattr(q_models.M, "subtype_labels_for", lambda m, labels, subtype: m if subtype == "many" else None)
    monkeypatch.setattr(q_models, "model_matrix", lambda r: frame)
    monkeypatch.setattr(q_models, "result_row", lambda r, result: None)
    monkeypatch.setattr(q_models, "literal_table", lambda *_: None)
    monkeypatch.setattr(q_models, "F", SimpleNamespace(col=lambda *_: _Any(), lit=lambda *_: _Any()))
    for run in ("boruta", "forest_repeat", "logistic_repeat", "boosted_repeat", "importance", "run_repeats", "cross_site", "subtype_runs"):
        getattr(q_models, run)(SimpleNamespace(spark=None))
    assert {k for k, _, _ in asked} == {"RF", "LR", "GBT"}
    for _, s, selected in asked:
        assert selected is None and (s.grid, s.n_folds, s.selection_rounds, s.selection_trees) == (None, 5, 50, 500)


class _Any:
    """Stands for a column."""

    def __getattr__(self, name):
        return lambda *_: self

    __mul__ = __gt__ = lambda self, other: self


def test_blocks_keep_their_types(spark):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "person_id BIGINT")
    a = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "person_id BIGINT, flag INT, none BIGINT")
    b = spark.createDataFrame([(1, 2.5), (3, None)], "person_id BIGINT, level DOUBLE")
    out = join_blocks(cohort, [a, b], ["flag", "none"])
    assert dict(out.dtypes) == {"person_id": "bigint", "flag": "int", "none": "bigint", "level": "double"}
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 2.5), (2, 0, 0, None), (3, 0, 0, None)]


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
    Context.master = "local[4]"
    assert session.checkpoint_dir(Session()).startswith("/tmp/")
