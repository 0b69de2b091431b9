"""The flagship query: one matrix row per person and window from a single scan of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.indicators import IndicatorSpec, build_signals, indicator_hits
from ..operators.labs import lab_matrix
from .q_features import LAB_SQL, lab_summary
from .q_indicators import ids
from .registry import finish, query
from .roles import STREAM_WINDOWS, Roles

SPECS = (
    IndicatorSpec("ANY_ERROR", "MEAS_ANY_RECORDED", ids(4), group="s"),
    IndicatorSpec("REPEATED_ERROR", "MEAS_REPEAT_AT_LEAST_N", ids(4), min_n=2, group="s"),
    IndicatorSpec("ERROR_EPISODES", "MEAS_ELEV_EPISODES_GAP", ids(4), gap=3, min_n=2, group="s"),
)


def _matrix(r: Roles) -> DataFrame:
    hits = indicator_hits(r.stream, r.stream_cohort, STREAM_WINDOWS, SPECS, r.stream_vocabulary, min_episode_window=0)
    signals = build_signals(hits, r.stream_cohort, STREAM_WINDOWS, SPECS)
    labs = lab_matrix(lab_summary(r), r.stream_cohort, STREAM_WINDOWS, ["purchase"])
    return signals.join(labs, ["person_id", "window"]).withColumnRenamed("window", "win")


def window_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(_matrix(Roles(spark, sf_dir)))


@query("window_matrix", f"""
    WITH e AS (SELECT person_id, win, event_date, lag(event_date) OVER (PARTITION BY person_id, win ORDER BY event_date) AS prev FROM s_evw
               WHERE concept_id = 4 AND value IS NOT NULL AND (value > range_high OR range_high IS NULL)),
    x AS (SELECT person_id, win, sum(CASE WHEN prev IS NULL OR event_date >= prev + 3 THEN 1 ELSE 0 END) AS n FROM e GROUP BY 1, 2),
    c AS (SELECT person_id, win, count(*) AS n FROM s_evw WHERE concept_id = 4 GROUP BY 1, 2)
    SELECT w.person_id, w.win, CASE WHEN c.n > 0 THEN 1 ELSE 0 END AS f_ind_s_any_error, CASE WHEN c.n >= 2 THEN 1 ELSE 0 END AS f_ind_s_repeated_error, CASE WHEN x.n >= 2 THEN 1 ELSE 0 END AS f_ind_s_error_episodes,
           CASE WHEN l.lab IS NULL THEN 0 ELSE 1 END AS f_lab_purchase_measured, round(peak, 6) AS f_lab_purchase_peak, round(median, 6) AS f_lab_purchase_median, round(last, 6) AS f_lab_purchase_last,
           CAST(coalesce(abnormal_count, 0) AS BIGINT) AS f_lab_purchase_abnormal_count, coalesce(abnormal_any, 0) AS f_lab_purchase_abnormal_any
    FROM s_win w LEFT JOIN c ON c.person_id = w.person_id AND c.win = w.win LEFT JOIN x ON x.person_id = w.person_id AND x.win = w.win
    LEFT JOIN ({LAB_SQL}) l ON l.person_id = w.person_id AND l.win = w.win AND l.lab = 'purchase'""")
def window_matrix_q(r):
    return _matrix(r)
