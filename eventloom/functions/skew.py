"""Joins that stay balanced when a few keys hold most of the rows.

Nothing here assumes that a side is small.  A side is broadcast only after its
size has been proven: literal tables are built from Python rows whose number is
known, and vocabulary-sized tables are counted up to the bound first.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HEAVY_ROWS = 1_000_000
"""A key with more rows than this is split over several tasks."""

SALTS = 64
"""Number of slices a heavy key is split into."""

BROADCAST_ROWS = 500_000
"""Largest table (in rows of a few longs) that is sent to every executor."""

LITERAL_ROWS = 50_000
"""Largest table that may be built from Python literals."""

SAMPLE = 0.01
"""Share of the rows that is counted to find heavy keys."""


def literal_table(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """Turn specification rows into a broadcast table; their number is checked here."""
    rows = list(rows)
    if len(rows) > LITERAL_ROWS:
        raise ValueError(f"{len(rows)} literal rows; read a table instead")
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
    return F.broadcast(spark.createDataFrame(table))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``rows + 1`` rows of ``df`` and tell whether it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS, fraction: float = SAMPLE) -> DataFrame:
    """Keys with more than ``heavy_rows`` rows, judged on a sample of the key columns.

    Only the balance of a join depends on the answer, never its result.  There
    are at most ``count / heavy_rows`` such keys, and the count is combined on
    the map side, so a heavy key itself never moves.
    """
    slim = df.select(*keys)
    slim = slim.sample(fraction=fraction, seed=17) if fraction < 1 else slim
    counted = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > heavy_rows * fraction).select(*keys)


def salted_join(
    facts: DataFrame,
    other: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    heavy: DataFrame | None = None,
    heavy_rows: int = HEAVY_ROWS,
    fraction: float = SAMPLE,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join in which the rows of heavy keys of ``facts`` are spread by hash.

    Heavy keys are looked for in ``heavy`` (rows carrying the keys, ``facts`` if
    not given).  Without any the plain join is planned.  ``spread`` names fact
    columns whose hash picks the slice, so a recomputed task sends a row to the
    same slice again.  Only the rows of ``other`` that carry a heavy key are
    repeated.
    """
    keys = list(keys)
    candidates = heavy_keys(facts if heavy is None else heavy, keys, heavy_rows, fraction)
    found = candidates.limit(LITERAL_ROWS + 1).collect()
    if not found:
        return facts.join(other, keys, how)
    if len(found) <= LITERAL_ROWS:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema.fields)
        candidates = literal_table(facts.sparkSession, [tuple(r) for r in found], schema)
    marked = candidates.withColumn("_heavy", F.lit(True))
    slice_of = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = (
        facts.join(marked, keys, "left")
        .withColumn("_salt", F.when(F.col("_heavy"), slice_of).otherwise(F.lit(0)))
        .drop("_heavy")
    )
    right = (
        other.join(marked, keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.when(F.col("_heavy"), F.lit(salts - 1)).otherwise(F.lit(0)))),
        )
        .drop("_heavy")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    known_rows: int | None = None,
) -> DataFrame:
    """Join facts to a vocabulary-sized table: broadcast if it fits, else a salted shuffle join.

    ``known_rows`` is a proven bound of the table's size and saves the counting job.
    """
    if known_rows is None:
        # Counted and joined: the vocabulary-sized table is evaluated once.
        table = table.persist()
    small = known_rows <= rows if known_rows is not None else fits_broadcast(table, rows)
    if small:
        return facts.join(F.broadcast(table), list(keys), how)
    return salted_join(facts, table, keys, spread, how)
