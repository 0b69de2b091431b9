"""Date windows around the index date."""

from __future__ import annotations

import re
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import overlaps

Window = tuple[int, int]

_LABEL = re.compile(r"w(\d+)_(\d+)")


def window_label(window: Window) -> str:
    return f"w{window[0]}_{window[1]}"


def parse_label(label: str) -> Window | None:
    found = _LABEL.fullmatch(label)
    return (int(found[1]), int(found[2])) if found else None


def ordered_labels(labels: Sequence[str]) -> list[str]:
    """Labels by their day bounds (w0_90 before w30_60), not by their spelling."""
    return sorted(labels, key=lambda w: parse_label(w) or (10**6, 10**6))


def sequential_windows(start: int = 0, end: int = 90, step: int = 10) -> list[Window]:
    """Adjacent windows with shared end points; the last one is clipped."""
    return [(s, min(s + step, end)) for s in range(start, end, step)]


def windows_column(windows: Sequence[Window], extend_to: Column | None = None) -> Column:
    """The windows as an array of (window, w_start, w_end) day offsets.

    ``extend_to`` is a person's own day offset (a discharge) that may push every
    end further out.
    """

    def entry(window: Window) -> Column:
        end = F.lit(int(window[1]))
        if extend_to is not None:
            end = F.greatest(end, F.coalesce(extend_to, end))
        return F.struct(
            F.lit(window_label(window)).alias("window"),
            F.lit(int(window[0])).alias("w_start"),
            end.alias("w_end"),
        )

    return F.array(*[entry(w) for w in windows])


def with_windows(cohort: DataFrame, windows: Sequence[Window], extend_inpatients: bool = False) -> DataFrame:
    """``(person_id, index_date, windows)``: one row per person, all windows in one array."""
    extend = None
    if extend_inpatients:
        extend = F.when(F.col("is_inpatient") == 1, F.datediff("discharge_date", "index_date"))
    return cohort.select("person_id", "index_date", windows_column(windows, extend).alias("windows"))


def cohort_windows(cohort: DataFrame, windows: Sequence[Window], extend_inpatients: bool = False) -> DataFrame:
    """One row per person and window with its dates."""
    rows = with_windows(cohort, windows, extend_inpatients).select("person_id", "index_date", F.explode("windows").alias("w"))
    return rows.select(
        "person_id",
        "index_date",
        "w.window",
        "w.w_start",
        "w.w_end",
        F.expr("date_add(index_date, w.w_start)").alias("window_start"),
        F.expr("date_add(index_date, w.w_end)").alias("window_end"),
    )


def explode_matching(joined: DataFrame, date: str = "event_date") -> DataFrame:
    """Repeat a row for the windows that contain its date only.

    ``joined`` carries ``index_date`` and ``windows``; adds ``day`` and ``day_in``
    (days from the index date and from the window start).
    """
    day = F.datediff(date, "index_date")
    rows = joined.withColumn("day", day).withColumn(
        "_w",
        F.explode(F.filter("windows", lambda w: (F.col("day") >= w["w_start"]) & (F.col("day") <= w["w_end"]))),
    )
    return rows.select(
        "*",
        F.col("_w.window").alias("window"),
        F.col("_w.w_start").alias("w_start"),
        F.col("_w.w_end").alias("w_end"),
        (F.col("day") - F.col("_w.w_start")).alias("day_in"),
    ).drop("_w", "windows")


def within_cohort_dates(events: DataFrame, cohort: DataFrame, windows: Sequence[Window], date: str = "event_date") -> DataFrame:
    """Events between the earliest and the latest day that any member's windows reach.

    Two dates are read from the cohort while the plan is built, so the bounds reach the files' statistics and nothing
    outside them is aggregated or shuffled.  An empty cohort leaves no events.
    """
    first, last = cohort.agg(F.min("index_date"), F.max("index_date")).first()
    if first is None or not windows:
        return events.where(F.lit(False))
    low, high = min(int(w[0]) for w in windows), max(int(w[1]) for w in windows)
    bounds = [F.lit(first + dt.timedelta(days=low)), F.lit(last + dt.timedelta(days=high))]
    return events.where((F.col(date) >= bounds[0]) & (F.col(date) <= bounds[1]))


def in_person_window(events: DataFrame, cohort: DataFrame, start: str, end: str, keep: Sequence[str] = ()) -> DataFrame:
    """Events between two dates of their person.  A person has one cohort row."""
    people = cohort.select("person_id", F.col(start).alias("_from"), F.col(end).alias("_to"), *keep)
    inside = F.col("event_date").between(F.col("_from"), F.col("_to"))
    return events.join(people, "person_id").where(inside).drop("_from", "_to")


def overlapping(intervals: DataFrame, cohort: DataFrame, start: Column, end: Column) -> DataFrame:
    """Visits whose [start, coalesce(end, start)] overlaps a person's own interval.

    ``start`` and ``end`` are expressions over the cohort columns.  Rows meet by time buckets, so one person's visits are spread.
    """
    people = cohort.withColumn("_from", start).withColumn("_to", end)
    visits = intervals.withColumn("visit_end", F.coalesce("end_date", "event_date"))
    met = overlaps(visits, people, ["person_id"], "event_date", "visit_end", "_from", "_to")
    return met.drop("_from", "_to")
