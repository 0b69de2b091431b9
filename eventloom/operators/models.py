"""Repeated, class-balanced models on MLlib: selection, fitting, scoring, importance."""

from __future__ import annotations

import dataclasses
import itertools
import json
import math
import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.sampling import flag_first_k, with_hash, with_rank
from ..functions.skew import literal_table
from ..session import checkpoint_dir, materialise
from ..sources.results import pending_runs
from . import forests as T
from . import logistic as L
from .metrics import ranking_metrics
from .repeats import (
    balance,
    column_profile,
    folds,
    kept_features,
    median_impute,
    prevalence_filter,
    seeds_of,
    stratified_split,
    train_medians,
)

# The tuning grids.
FOREST_GRID = {"numTrees": (100, 300, 500), "maxDepth": (5, 10, 20, 30), "minInstancesPerNode": (1, 5, 10)}
# The strength C of the logistic grid becomes regParam = 1 / (C * training rows).  A depth of 30, the deepest that the
# tree learners take, stands for unlimited.
LOGISTIC_GRID = {"C": (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), "elasticNetParam": (0.0, 1.0)}
BOOSTED_GRID = {"maxIter": (100, 300, 500), "maxDepth": (5, 10, 20, 30), "minInstancesPerNode": (1, 5, 10)}
DEFAULT_GRIDS = {"RF": FOREST_GRID, "LR": LOGISTIC_GRID, "GBT": BOOSTED_GRID}


@dataclass(frozen=True)
class RepeatSettings:
    """``grid`` None: the whole grid of the model kind."""

    min_prevalence: float = 0.01
    forced: tuple[str, ...] = ()
    test_share: float = 0.2
    n_folds: int = 5
    grid: Mapping[str, Sequence] | None = None
    selection_rounds: int = 50
    selection_trees: int = 500
    selection_percentile: float = 97.0
    parallelism: int = 4


def assemble_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def _double(df: DataFrame, features: Sequence[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in set(features)]
    return df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])


# ------------------------------------------------------------------ selection against shadows

def ranked_once(df: DataFrame, seed: int, id_col: str = "person_id") -> DataFrame:
    """Add ``_at``, the row's place from 0 in a hash order of all rows, and ``_n``, their number; stored."""
    hashed = df.withColumn("_g", F.lit(0)).withColumn("_a", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(f"{seed}a"))))
    ranked = with_rank(hashed, ["_g"], "_a", "_at", id_col).drop("_a", "_g")
    return materialise(ranked.withColumn("_at", F.col("_at").cast("long") - 1), "ranked")


def add_shadows(df: DataFrame, features: Sequence[str], seed: int, id_col: str = "person_id") -> DataFrame:
    """Append a permuted copy ``shadow_<feature>`` of every feature.

    Rows are ranked once (``ranked_once``, done here for a table without ``_at``); a round's permutation is arithmetic on the rank, a
    keyed bijection of the row numbers, and one equal join.  It repeats exactly, whatever the partitions.
    """
    ranked = df if "_at" in df.columns else ranked_once(df, seed, id_col)
    n = ranked.count()
    donors = ranked.select(T.permuted_column(F.col("_at"), n, seed).alias("_at"), *[F.col(f"`{f}`").alias(f"shadow_{f}") for f in features])
    return ranked.join(donors, "_at").drop("_at")


def _upper_tail(hits: int, n: int) -> float:
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2.0**n


def _lower_tail(hits: int, n: int) -> float:
    return sum(math.comb(n, k) for k in range(0, hits + 1)) / 2.0**n


def _passes_both_corrections(p_values: Mapping[str, float], rounds: int, alpha: float) -> set[str]:
    """False-discovery step-up over the features, then a bound for the number of rounds."""
    order = sorted(p_values, key=p_values.get)
    m = len(order)
    limit = max((i for i, f in enumerate(order, 1) if p_values[f] <= alpha * i / m), default=0)
    return {f for f in order[:limit] if p_values[f] <= alpha / rounds}


def decide(open_features: Sequence[str], hits: Mapping[str, int], rounds: int, alpha: float = 0.05) -> tuple[set[str], set[str]]:
    """The features whose hits after a number of rounds are too many, and too few, for a fair coin."""
    up = _passes_both_corrections({f: _upper_tail(hits[f], rounds) for f in open_features}, rounds, alpha)
    down = _passes_both_corrections({f: _lower_tail(hits[f], rounds) for f in open_features}, rounds, alpha)
    return up, down


def shadow_bar(shadows: Sequence[float], percentile: float) -> float:
    """Percentile of the shadows' importances, linear between neighbours."""
    return float(np.percentile(np.asarray(shadows, float), percentile))


def shadow_hits(importances: DataFrame, percentile: float = 97.0) -> DataFrame:
    """(feature, rounds, hits) of a stored history of rounds: (round, feature, importance, shadow).

    A round's bar is the percentile of its shadows' importances; a feature hits if its own exceeds it.
    """
    bars = exact_quantiles(importances, ["round"], "shadow", {"bar": percentile / 100.0}).drop("n_values")
    return importances.join(bars, "round").groupBy("feature").agg(
        F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("importance") > F.col("bar")).alias("hits")
    )


def shadow_select(
    train: DataFrame, features: Sequence[str], seed: int, rounds: int = 50, trees: int = 500, percentile: float = 97.0,
    forced: Sequence[str] = (), depth: int = 7, alpha: float = 0.05, label: str = "label", id_col: str = "person_id", on_round=None,
) -> list[str]:
    """Keep the features whose forest importance beats their permuted shadows.

    A round is a hit if the importance exceeds the percentile of the shadow
    importances; hits over rounds are tested against a fair coin.  Stops early
    once every feature is decided; nothing kept means all are kept.  ``on_round``
    receives (round, features, importances, bar).  A table within the bound of what tasks
    hold is sent to them, and each grows some of the trees; a larger one is ranked once and fitted by MLlib.
    """
    spark = train.sparkSession
    # the forests are not kept, so only the table is bounded
    table = T.gathered(train, features, label, id_col, bins_only=True)
    ranked = None if table is not None else ranked_once(train.select(id_col, label, *features), seed, id_col)
    open_features, accepted = list(features), []
    hits = dict.fromkeys(features, 0)
    place = {f: i for i, f in enumerate(features)}
    held = None if table is None else spark.sparkContext.broadcast(dataclasses.replace(table, x=table.bins))
    # no run of hits is long enough to decide before this round, so the first ones use the same features and go together
    early = next(r for r in itertools.count(1) if 2.0**-r <= alpha / r)
    known: dict[int, np.ndarray] = {}
    for r in range(1, rounds + 1):
        if not open_features:
            break
        used = [*accepted, *open_features]
        if table is not None:
            if seed + r not in known:
                known = T.shadow_importances(spark, held, [place[f] for f in used], trees, depth, [seed + q for q in range(r, max(r, min(early, rounds)) + 1)])
            importance = known[seed + r]
        else:
            shadowed = add_shadows(ranked.select("_at", label, *used), used, seed + r, id_col)
            names = [*used, *[f"shadow_{f}" for f in used]]
            forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed + r)
            importance = forest.fit(assemble_vector(shadowed, names)).featureImportances.toArray()
        bar = shadow_bar(importance[len(used) :], percentile)
        if on_round:
            on_round(r, used, importance[: len(used)], bar)
        for f, value in zip(used, importance):
            hits[f] += int(value > bar)
        up, down = decide(open_features, hits, r, alpha)
        accepted += [f for f in open_features if f in up]
        open_features = [f for f in open_features if f not in up and f not in down]
    if held is not None:
        held.destroy()
    chosen = set(accepted) | (set(forced) & set(features))
    return [f for f in features if f in chosen] or list(features)


# ------------------------------------------------------------------ fitting


def _grid(estimator, grid: Mapping[str, Sequence]):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def fit_tuned(estimator, grid: Mapping[str, Sequence], train: DataFrame, n_folds: int = 5, parallelism: int = 4, label: str = "label"):
    """Grid search on accuracy with the folds of the ``fold`` column; refits the best model on all rows."""
    strengths = grid.get("C")
    if strengths:
        rows = train.count()
        grid = {"regParam": tuple(1.0 / (c * max(1, rows)) for c in strengths)} | {k: v for k, v in grid.items() if k != "C"}
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=_grid(estimator, grid),
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=n_folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    model = search.fit(train)
    best = model.bestModel
    params = {name: best.getOrDefault(best.getParam(name)) for name in grid}
    if strengths:
        params["C"] = min(strengths, key=lambda c: abs(math.log(1.0 / (c * max(1, rows)) / params["regParam"])))
    return best, params


def fit_trees(train: DataFrame, features: Sequence[str], kind: str, grid: Mapping[str, Sequence], seed: int, n_folds: int, label: str = "label", id_col: str = "person_id"):
    """Grid search over trees whose fits are dealt to tasks; None if the training table passes their bound.

    The best mean accuracy over the ``fold`` column wins, the first cell of the grid on ties.
    """
    name = "numTrees" if kind == "RF" else "maxIter"
    whole = {name: (20,), "maxDepth": (5,), "minInstancesPerNode": (1,)} | dict(grid)
    table = T.gathered(train, features, label, id_col, "fold")
    if table is None:
        return None
    cells = T.grid_accuracy(train.sparkSession, table, kind, whole, seed, n_folds)
    best = max(range(len(cells)), key=lambda i: (-1.0 if cells[i][0] is None else round(cells[i][0], 9), -i))
    params = cells[best][1]
    if len(table.y) * 2 * params[name] * T.NODE_BYTES > T.MODEL_BYTES:
        return T.GrownModel(table, kind, params, seed, features), params
    return T.TreeModel(T.fitted_nodes(train.sparkSession, table, kind, params, seed), kind, features), params


def fit_linear(train: DataFrame, features: int, grid: Mapping[str, Sequence], n_folds: int, label: str = "label"):
    """Grid search over logistic models whose fits share their passes over the rows; None if the grid has other keys or the sums pass their bound."""
    mixes = tuple(grid.get("elasticNetParam", (0.0,)))
    if set(grid) - {"C", "elasticNetParam"} or "C" not in grid or not L.fits_bounded(features, len(grid["C"]) * len(mixes) * (n_folds + 1)):
        return None
    held = materialise(train.select(label, "fold", vector_to_array("features").alias("features")), "logistic-rows")
    rows = max(1, held.count())
    model, best = L.fit_grid(held, features, [1.0 / (c * rows) for c in grid["C"]], mixes, n_folds, label)
    c, mix = grid["C"][best // len(mixes)], mixes[best % len(mixes)]
    return model, {"regParam": 1.0 / (c * rows), "elasticNetParam": mix, "C": c}


def make_estimator(kind: str, seed: int, label: str = "label"):
    if kind == "RF":
        return RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed)
    if kind == "LR":
        return LogisticRegression(featuresCol="features", labelCol=label)
    if kind == "GBT":
        return GBTClassifier(featuresCol="features", labelCol=label, seed=seed)
    raise ValueError(f"unknown model kind {kind}")


def score_rows(model, rows: DataFrame) -> DataFrame:
    if isinstance(model, (T.TreeModel, T.GrownModel)):
        return model.score(rows.withColumn("features", vector_to_array("features"))).withColumn("features", array_to_vector("features"))
    if isinstance(model, L.LinearModel):
        return model.score(rows)
    return model.transform(rows).withColumn("p_raw", vector_to_array("probability")[1])


@dataclass
class RepeatResult:
    iteration: int
    seed: int
    kind: str
    auroc: float | None
    auprc: float | None
    n_features_before: int
    n_features_filtered: int
    n_features_selected: int
    params: dict
    features: list[str]
    predictions: DataFrame
    model: object


def run_repeat(
    matrix: DataFrame, features: Sequence[str], iteration: int, kind: str = "RF", settings: RepeatSettings | None = None,
    selected: Sequence[str] | None = None, label: str = "label", id_col: str = "person_id",
) -> RepeatResult:
    """Split -> balance -> prevalence filter -> selection -> impute -> tune -> score on the unbalanced test rows.

    ``selected`` pins an earlier selection (robustness estimator on the same splits).
    """
    s = settings or RepeatSettings()
    seed = seeds_of(iteration + 1)[-1]
    data = _double(matrix.select(id_col, label, *[F.col(f"`{f}`") for f in features]), features)
    split = stratified_split(data, [seed], s.test_share, id_col, label).select(id_col, "seed", "is_test")
    placed = data.join(split, id_col).persist()
    train_ids = balance(placed.where("is_test = 0").select("seed", id_col, label), id_col, label).select(id_col)
    train = placed.where("is_test = 0").join(train_ids, id_col, "left_semi").persist()
    test = placed.where("is_test = 1")
    train_vec = None
    try:
        kept = kept_features(prevalence_filter(column_profile(train, features), s.min_prevalence, s.forced), features)
        medians = train_medians(train, kept)
        train_full = median_impute(train, medians, kept)
        if selected is None:
            chosen = shadow_select(
                train_full, kept, seed, s.selection_rounds, s.selection_trees, s.selection_percentile, s.forced,
                label=label, id_col=id_col,
            )
        else:
            chosen = [f for f in kept if f in set(selected)]
        folded = folds(train_full.select(id_col, "seed", label, *chosen), s.n_folds, id_col, label)
        grid = s.grid or DEFAULT_GRIDS[kind]
        trees = fit_trees(folded, chosen, kind, grid, seed, s.n_folds, label, id_col) if kind in ("RF", "GBT") else None
        train_vec = assemble_vector(folded, chosen).select(label, "fold", "features")
        test_vec = assemble_vector(median_impute(test, medians, kept), chosen)
        if kind == "LR":
            scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train_vec)
            train_vec, test_vec = (
                scaler.transform(v).drop("features").withColumnRenamed("scaled", "features") for v in (train_vec, test_vec)
            )
        train_vec = train_vec.persist()
        linear = fit_linear(train_vec, len(chosen), grid, s.n_folds, label) if kind == "LR" else None
        model, params = trees or linear or fit_tuned(make_estimator(kind, seed, label), grid, train_vec, s.n_folds, s.parallelism, label)
        scored = score_rows(model, test_vec).select(id_col, "seed", F.col(label).alias("y_true"), "p_raw", "features")
        # The predictions outlive the cached splits.
        scored = materialise(scored.withColumn("features", vector_to_array("features")), "predictions")
    finally:
        for cached in (placed, train, train_vec):
            if cached is not None:
                cached.unpersist()
    metric = ranking_metrics(scored, ["seed"]).first()
    return RepeatResult(
        iteration, seed, kind, metric.auroc, metric.auprc, len(features), len(kept), len(chosen), params, chosen,
        scored, model,
    )


RESULT_SCHEMA = (
    "config STRING, feature_window STRING, model STRING, iteration INT, seed BIGINT, auroc DOUBLE, auprc DOUBLE, "
    "n_features_before INT, n_features_filtered INT, n_features_selected INT, params STRING, features ARRAY<STRING>"
)


RUN_KEYS = ("config", "feature_window", "model", "iteration")


def read_ledger(spark, path: str) -> DataFrame | None:
    """The stored results of finished runs; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder) or not len(system.listStatus(folder)):
        return None
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def write_run(spark, path: str, row: Sequence) -> None:
    """One finished run as a partition of its own: a single file, renamed into place when its job commits."""
    key = dict(zip(RUN_KEYS, row))
    place = "/".join(f"{k}={quote(str(v), safe='')}" for k, v in key.items())
    fields = [f.strip() for f in RESULT_SCHEMA.split(",")]
    literal_table(spark, [tuple(row[4:])], ", ".join(fields[4:])).coalesce(1).write.mode("overwrite").parquet(f"{path}/{place}")


def run_repeats(
    matrices: Mapping[str, DataFrame], configs: Mapping[str, Sequence[str]], n_repeats: int, kinds: Iterable[str] = ("RF",),
    settings: RepeatSettings | None = None, done: Iterable[tuple] = (), on_result=None, label: str = "label", ledger: str | None = None, pool: int = 4,
) -> DataFrame:
    """Runs of all keys (config, window, kind, iteration), ``pool`` at a time, each in a scheduler pool of its own.

    A finished run is written to the ``ledger`` folder at once (a new shared one by default); keys stored there, or in ``done``, are not run
    again, so a killed call goes on where it stopped.  ``on_result`` receives each result, e.g. to write its predictions.  An
    error of one key is raised after the keys under way have ended.  The driver holds the keys and the selected features alone; the result is the ledger's rows of them.
    The kinds of one (config, window, iteration) have the same split, balance and seed, so the selection that one of them has made is the others' too.
    """
    spark = next(iter(matrices.values())).sparkSession
    path = ledger or f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    keys = [(c, w, k, i) for w in matrices for c in configs for k in kinds for i in range(n_repeats)]
    skipped = set(done)
    grid = literal_table(spark, [k for k in keys if k not in skipped], "config STRING, feature_window STRING, model STRING, iteration INT")
    past = read_ledger(spark, path)
    pending = [tuple(r) for r in pending_runs(grid, past, RUN_KEYS).orderBy(*RUN_KEYS).collect()]
    selected = {} if past is None else {(r.config, r.feature_window, r.iteration): r.features for r in past.select("config", "feature_window", "iteration", "features").collect()}

    def run(key: tuple) -> None:
        config, window, kind, i = key
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{config}-{window}-{kind}-{i}")
        made = selected.get((config, window, i))
        r = run_repeat(matrices[window], configs[config], i, kind, settings, **({} if made is None else {"selected": made}), label=label)
        selected[config, window, i] = r.features
        if on_result:
            on_result(window, config, r)
        write_run(spark, path, (
            config, window, kind, i, r.seed, r.auroc, r.auprc, r.n_features_before, r.n_features_filtered,
            r.n_features_selected, json.dumps(r.params, sort_keys=True), r.features,
        ))

    with ThreadPoolExecutor(max(1, pool)) as workers:
        running = [workers.submit(run, key) for key in pending]
        try:
            for one in running:
                one.result()
        except BaseException:
            for one in running:
                one.cancel()
            raise
    found = read_ledger(spark, path)
    return spark.createDataFrame([], RESULT_SCHEMA) if found is None else found.join(grid, list(RUN_KEYS), "left_semi")


# ------------------------------------------------------------------ importance


def permutation_importance(result: RepeatResult, max_rows: int | None = None, id_col: str = "person_id") -> DataFrame:
    """Loss of AUROC over the test rows when one feature is permuted.

    All features are scored in one pass, with the entry of one feature at a time taken from another row: trees walk
    again only those that use it, other models score a copy of the row per feature.  ``max_rows`` asks for a
    sample; by default every test row is scored.
    """
    hashed = with_hash(result.predictions.select(id_col, "seed", "y_true", "features"), id_col, "seed")
    if max_rows is not None:
        targets = hashed.groupBy("seed").agg(F.least(F.count(F.lit(1)), F.lit(max_rows)).alias("k"))
        hashed = flag_first_k(hashed, ["seed"], targets, "_take", id_col=id_col).where("_take = 1")
    sizes = hashed.groupBy("seed").agg(F.count(F.lit(1)).alias("m"))
    rows = with_rank(hashed, ["seed"], "_hash", "r", id_col).join(sizes, "seed").select("seed", "y_true", F.col("features").alias("x"), "r", "m")
    donors = rows.select("seed", (F.pmod(F.col("r") + F.lit(7), F.col("m")) + 1).alias("r"), F.col("x").alias("z"))
    both = rows.join(donors, ["seed", "r"])
    n = len(result.features)
    if isinstance(result.model, (T.TreeModel, T.GrownModel)):
        swapped = result.model.score_swapped(both, "x", "z")
        scored = swapped.select("seed", "y_true", F.posexplode("p_swapped").alias("j", "p_raw")).withColumn("j", F.col("j") - 1)
    else:
        each = both.select(
            "seed", "y_true", "x", "z", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("j")
        ).withColumn("v", F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("z", i)).otherwise(v)))
        scored = score_rows(result.model, each.withColumn("features", array_to_vector("v")))
    metric = ranking_metrics(scored.select("seed", "j", "y_true", "p_raw"), ["seed", "j"])
    names = literal_table(rows.sparkSession, list(enumerate(result.features)), "j INT, feature STRING")
    base = metric.where("j = -1").select("seed", F.col("auroc").alias("base"))
    return metric.join(names, "j").join(base, "seed").select("seed", "feature", (F.col("base") - F.col("auroc")).alias("importance"))


# ------------------------------------------------------------------ across sites


def cross_site(
    matrix: DataFrame, features: Sequence[str], site_col: str, kinds: Iterable[str] = ("LR", "RF"), min_rows: int = 50,
    seed: int = 42, label: str = "label", id_col: str = "person_id", trees: int = 100, depth: int = 5,
) -> DataFrame:
    """Train on one site, test on every other; small or one-class sites are skipped.

    The sites are listed on the driver; rows stay distributed.
    """
    data = _double(matrix.select(id_col, label, site_col, *features), features).withColumn("seed", F.lit(seed))
    counts = data.groupBy(site_col).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    usable = [r[site_col] for r in counts.where((F.col("n") >= min_rows) & (F.col("pos") > 0)).orderBy(site_col).collect()]
    out = None
    for site in usable:
        here = data.where(F.col(site_col) == site)
        rest = data.where((F.col(site_col) != site) & F.col(site_col).isin(*usable))
        ids = balance(here.select("seed", id_col, label), id_col, label).select(id_col)
        train = here.join(ids, id_col, "left_semi")
        medians = train_medians(train, features)
        train_vec = assemble_vector(median_impute(train, medians, features), features)
        test_vec = assemble_vector(median_impute(rest, medians, features), features)
        for kind in kinds:
            if kind == "LR":
                scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train_vec)
                tr, te = (scaler.transform(v).drop("features").withColumnRenamed("scaled", "features") for v in (train_vec, test_vec))
                model = make_estimator(kind, seed, label).fit(tr)
            else:
                tr, te = train_vec, test_vec
                model = make_estimator(kind, seed, label).setParams(numTrees=trees, maxDepth=depth).fit(tr)
            scored = score_rows(model, te).select(F.col(site_col).alias("test_site"), F.col(label).alias("y_true"), "p_raw")
            part = ranking_metrics(scored, ["test_site"]).select(
                F.lit(site).alias("train_site"), "test_site", F.lit(kind).alias("model"), "auroc", "auprc"
            )
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no site has enough rows and positives")
    return out


def subtype_labels_for(matrix: DataFrame, labels: DataFrame, subtype: str, min_positives: int = 10) -> DataFrame | None:
    """Swap the label of the matrix for a subtype; None if it has too few positives."""
    swapped = matrix.drop("label").join(labels.select("person_id", F.col(subtype).alias("label")), "person_id")
    enough = swapped.where("label = 1").limit(min_positives).count() >= min_positives
    return swapped if enough else None
