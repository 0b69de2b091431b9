"""Readers and sinks on the supplied tables: written to the shared folder, read back, and compared with what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assemble as A
from ..operators.indicators import build_signals
from ..schema import DOMAINS, MEASUREMENT
from ..session import checkpoint_dir
from ..sources import results as S
from ..sources import warehouse as R
from .q_windows import _HITS, _SPECS, hits
from .registry import DATES, query
from .roles import STREAM_WINDOWS

DATES["stored_events"] = ("event_date",)
DATES["stored_cohort"] = ("index_date", "acute_start", "acute_end")


def folder(r, name: str) -> str:
    return f"{checkpoint_dir(r.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stored_events", """
    SELECT person_id, event_id, domain, concept_id, event_date, value, value_concept_id, value_text, range_high, source_text, source_concept_id FROM ev""")
def stored_events(r):
    """A measurement table in the warehouse's own columns, read in the canonical ones."""
    spec, path = DOMAINS[MEASUREMENT], folder(r, "warehouse")
    own = {
        "event_id": spec.event_id, "concept_id": spec.concept, "event_date": spec.date, "source_text": spec.source_text, "value": spec.value,
        "value_concept_id": spec.value_concept, "value_text": spec.value_text, "range_high": spec.range_high, "source_concept_id": spec.source_concept,
    }
    table = r.stream.select("person_id", *[F.col(a).alias(b.upper()) for a, b in own.items()], F.lit(1).alias("unused"))
    table.write.parquet(f"{path}/{spec.table}")
    return R.read_all_events(r.spark, path, [MEASUREMENT]).drop("end_date", "provider_id", "site_id")


@query("stored_vocabulary", """
    SELECT 'concept' AS kind, concept_id AS id, concept_name AS name FROM concept UNION ALL SELECT 'pair', anc, CAST(des AS VARCHAR) FROM closure""")
def stored_vocabulary(r):
    """Vocabulary tables with capital column names, read in lower case."""
    path = folder(r, "vocabulary")
    for name, table in (("concept", r.vocabulary.concept), ("concept_ancestor", r.vocabulary.ancestor)):
        table.toDF(*[c.upper() for c in table.columns]).write.parquet(f"{path}/{name}")
    back = R.read_tables(r.spark, path, R.VOCABULARY_TABLES)
    pairs = back["concept_ancestor"].select(F.lit("pair"), F.col("ancestor_concept_id"), F.col("descendant_concept_id").cast("string"))
    return back["concept"].select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), F.col("concept_name").alias("name")).union(pairs)


@query("stored_cohort", "SELECT person_id, label, index_date, is_inpatient, acute_start, acute_end, age_at_index FROM cohort")
def stored_cohort(r):
    """The cohort by setting: written, checked and cast again when it is read."""
    path = folder(r, "cohort")
    S.write_cohort(r.cohort.withColumn("age_at_index", F.col("age_at_index").cast("string")), path)
    return R.load_cohort(r.spark, path).select("person_id", "label", "index_date", "is_inpatient", "acute_start", "acute_end", "age_at_index")


@query("stored_matrix", f"""
    WITH h AS ({_HITS}) SELECT win, count(DISTINCT person_id) AS n, count(DISTINCT CASE WHEN i = 'ERR' THEN person_id END) AS n_err, count(DISTINCT CASE WHEN i = 'CLK' THEN person_id END) AS n_clk
    FROM (SELECT person_id, win FROM s_win) LEFT JOIN h USING (person_id, win) GROUP BY 1""")
def stored_matrix(r):
    """Windows written one after another, a repeated one in place; only the columns of the configurations are read."""
    path, matrix = folder(r, "matrix"), build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS)
    S.write_matrix(matrix, path)
    S.write_matrix(matrix.where(F.col("window") == "w0_5"), path)
    names = {c.rsplit("_", 1)[1]: c for c in matrix.columns if c.startswith("f_ind")}
    back = R.read_matrix(r.spark, path, {"base": [names["err"]], "more": [names["err"], names["clk"]]}, ["window"])
    return back.groupBy(F.col("window").alias("win")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(names["err"]).cast("long").alias("n_err"), F.sum(names["clk"]).cast("long").alias("n_clk")
    )


@query("stored_results", "SELECT config, feature_window, iteration, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM results")
def stored_results(r):
    """Results of runs kept as partitions, replaced by a second run, exported as text files by window and combined again."""
    path, files = folder(r, "results"), folder(r, "result-files")
    columns = ["config", "feature_window", "iteration", "auroc", "auprc"]
    S.write_results(r.results.select(*columns).withColumn("auroc", F.lit(0.0)), path)
    S.write_results(r.results.select(*columns), path)
    r.spark.read.parquet(path).select(*columns).write.option("header", True).csv(files)
    return S.read_result_files(r.spark, [files], "config STRING, feature_window STRING, iteration INT, auroc DOUBLE, auprc DOUBLE")


@query("stored_predictions", "SELECT seed, y_true, count(*) AS n, round(sum(p_raw), 6) AS total FROM predictions GROUP BY 1, 2")
def stored_predictions(r):
    path = folder(r, "predictions")
    S.write_predictions(r.predictions, path)
    return r.spark.read.parquet(path).groupBy("seed", "y_true").agg(F.count(F.lit(1)).alias("n"), F.sum("p_raw").alias("total"))


@query("stored_mapping", "SELECT concept_id, t0 || ' | ' || t1 || ' | XX_1' AS ontology_id, l0 || ' | ' || l1 AS ontology_label, mapping_category FROM ontology_raw")
def stored_mapping(r):
    """The ontology map as a text file with a header, read with its schema."""
    path = folder(r, "mapping")
    r.ontology_raw.select("concept_id", "ontology_id", "ontology_label", "mapping_category").write.option("header", True).csv(path)
    return R.read_ontology_map(r.spark, path)


@query("withheld_columns", f"""
    WITH h AS ({_HITS}) SELECT 'f_ind_' || lower(i) AS feature, count(*) AS n FROM h WHERE i <> 'CLK' GROUP BY 1""")
def withheld_columns(r):
    """Selected columns of a matrix without those that a blocklist's pattern withholds, from frame, families and configurations alike."""
    matrix = build_signals(hits(r), r.stream_cohort, STREAM_WINDOWS, _SPECS)
    columns = A.select_columns(matrix.columns, prefix="f_ind")
    gone = A.resolve_blocklist(["re:_clk$"], columns)
    left, families, configs = A.withhold(matrix, {"signals": columns}, {"all": columns}, gone)
    kept = [c for c in families["signals"] if c in configs["all"] and c in left.columns]
    sums = left.agg(*[F.sum(c).cast("long").alias(c) for c in kept])
    return sums.unpivot([], kept, "feature", "n").where("n > 0")
