"""Row predicates over the canonical event schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; no condition means no row."""
    conditions = list(conditions)
    return reduce(or_, conditions) if conditions else F.lit(False)


def ilike_any(column: Column | str, patterns: Sequence[str]) -> Column:
    """Case-insensitive LIKE against any pattern (``%`` is the wildcard)."""
    column = F.col(column) if isinstance(column, str) else column
    lowered = F.lower(column)
    return any_of(lowered.like(p.lower()) for p in patterns)


def in_window(date: str = "event_date", start: str = "window_start", end: str = "window_end") -> Column:
    """Date inside the window, both ends included."""
    return F.col(date).between(F.col(start), F.col(end))


def has_any_value(with_text: bool = False) -> Column:
    present = F.col("value").isNotNull() | F.col("value_concept_id").isNotNull()
    return present | F.col("value_text").isNotNull() if with_text else present


def is_elevated(count_concept_values: bool = True) -> Column:
    """Above the reference range; a value without a range counts as elevated."""
    above = F.col("value") > F.col("range_high")
    unranged = F.col("value").isNotNull() & F.col("range_high").isNull()
    flag = F.coalesce(above, F.lit(False)) | unranged
    return flag | F.col("value_concept_id").isNotNull() if count_concept_values else flag


# Words that decode a free-text test result.
NEGATIVE_TEXT = (
    "%negative%", "neg", "%not detected%", "%not-detected%", "%nondetected%", "%non-detected%",
    "%not reactive%", "%non-reactive%",
)
POSITIVE_TEXT = ("%positive%", "pos", "%detected%", "%reactive%")
UNCONFIRMED_TEXT = ("%presumptive%",)


def decode_result(positive_ids: Sequence[int], negative_ids: Sequence[int]) -> Column:
    """1 positive, 0 negative, null neither.

    Coded results come first.  Text is read only where no code is recorded, and
    negative wording wins, so "not detected" is never taken for "detected".
    """
    code = F.col("value_concept_id")

    def said(patterns):
        return ilike_any("value_text", patterns) | ilike_any("source_text", patterns)

    uncoded = code.isNull()
    return (
        F.when(code.isin(*negative_ids), 0)
        .when(code.isin(*positive_ids), 1)
        .when(uncoded & said(NEGATIVE_TEXT), 0)
        .when(uncoded & said(POSITIVE_TEXT) & ~said(UNCONFIRMED_TEXT), 1)
    )
