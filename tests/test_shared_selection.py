import random

from eventloom.operators import models as M


def test_kinds_of_one_repeat_share_their_selection(spark, tmp_path, monkeypatch):
    """One selection for a config and iteration, whatever the kinds; a later call takes it from the ledger; results are those of separate runs."""
    rng = random.Random(3)
    rows = [(i, int(i % 3 == 0), float(i % 3 == 0) + rng.random() / 2, rng.random(), rng.random()) for i in range(300)]
    matrix = spark.createDataFrame(rows, "person_id BIGINT, label INT, a DOUBLE, b DOUBLE, c DOUBLE")
    grids = {"RF": {"numTrees": (5,), "maxDepth": (3,), "minInstancesPerNode": (1,)}, "GBT": {"maxIter": (4,), "maxDepth": (2,), "minInstancesPerNode": (1,)}}
    monkeypatch.setattr(M, "DEFAULT_GRIDS", grids)
    settings = M.RepeatSettings(selection_rounds=9, selection_trees=8, n_folds=2)
    alone = {k: M.run_repeat(matrix, ["a", "b", "c"], 0, k, settings) for k in ("RF", "GBT")}
    calls, select = [], M.shadow_select
    monkeypatch.setattr(M, "shadow_select", lambda *a, **k: calls.append(1) or select(*a, **k))
    run = dict(n_repeats=1, settings=settings, ledger=str(tmp_path / "ledger"), pool=1)
    M.run_repeats({"w": matrix}, {"all": ["a", "b", "c"]}, kinds=("RF",), **run)
    out = M.run_repeats({"w": matrix}, {"all": ["a", "b", "c"]}, kinds=("RF", "GBT"), **run)
    assert len(calls) == 1
    got = {r.model: (r.features, r.auroc) for r in out.collect()}
    assert got == {k: (alone[k].features, alone[k].auroc) for k in alone} and "a" in got["RF"][0]
