"""Bounded, repeatable samples of ids for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def hashed_ids(ids: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of a table of distinct ids (its first column): those whose hash lies below rows over their number; all if fewer."""
    count = ids.count()
    name = ids.columns[0]
    if count <= rows:
        return ids
    return ids.where(F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit("sample")), F.lit(SCALE)) < int(SCALE * rows / count))
