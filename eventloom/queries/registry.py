"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .roles import Roles
from .roles_sql import with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_COHORT_DATES = ("index_date", "first_outcome_date", "discharge_date", "acute_start", "acute_end")
_FOLLOW_DATES = (*_COHORT_DATES, "death_date", "obs_end", "last_obs_date")
# Date columns of the results; both sides show them as text.
DATES = {
    "scan_events": ("event_date",), "window_dates": ("window_start", "window_end"), "index_events": ("index_date",),
    "first_outcome": ("first_outcome_date",), "exclude_members": ("index_date",), "death_dates": ("death_date",),
    "observation_extent": ("obs_start", "obs_end"), "robust_cutoff": ("data_cutoff",),
    "label_outcome": ("index_date", "first_outcome_date"), "classify_setting": _COHORT_DATES[:3], "acute_window": _COHORT_DATES,
    "death_followup": _FOLLOW_DATES, "demographics": _FOLLOW_DATES, "synthetic_index": _COHORT_DATES, "eligible_dates": ("index_date",),
    "modelling_gates": ("index_date", "first_outcome_date", "acute_start", "acute_end", "last_obs_date"),
    "window_case_filter": ("first_outcome_date",), "attrition": ("index_min", "index_max"), "build_cohort_strict": _FOLLOW_DATES,
    "build_cohort_relaxed": ("index_date", "acute_end"),
}


def dates_as_text(name: str, sql: str) -> str:
    columns = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(name, ()))
    return f"SELECT * REPLACE ({columns}) FROM ({sql})" if columns else sql


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (the SQL side rounds alike), widen integers and show dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under a name, with its SQL if there is one."""

    def register(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Roles(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = dates_as_text(name, with_roles(sql))
        return fn

    return register
