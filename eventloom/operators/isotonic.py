"""Isotonic regression of an outcome on a score, for all keys at once.

Adjacent violators are pooled inside chunks of a bounded number of blocks, each in a task of its own.  What is left at
the edges of chunks is pooled in further rounds, in which the chunks are cut elsewhere; pooling in any order ends
in the same blocks, which are exact as sums are whole numbers.  No task and no driver holds a key: between rounds only the
number of edges that still fall is read.  The step function is a table, applied by meeting rows and steps in value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import in_range, range_splitters
from ..session import materialise, ship
from .metrics import collapse

CHUNK = 50_000
"""Most blocks that are pooled in one task, twice as many in the first round."""


def pool(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Adjacent violators pooled: first place of each block, its weight and its sum; equal means are pooled too."""
    first, weight, total = [], [], []
    for i, (a, b) in enumerate(zip(w.tolist(), s.tolist())):
        at = i
        while total and total[-1] * a >= b * weight[-1]:
            a, b, at = a + weight.pop(), b + total.pop(), first.pop()
        first.append(at)
        weight.append(a)
        total.append(b)
    return np.array(first, np.int64), weight, total


def _pooled(blocks: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    fields = [blocks.schema[k] for k in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL("chunk LONG, pos LONG, lo DOUBLE, hi DOUBLE, w LONG, s LONG").fields])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lo", kind="stable", ignore_index=True)
        first, w, s = pool(part["w"].to_numpy(), part["s"].to_numpy())
        last = np.append(first[1:], len(part)) - 1
        out = {k: part[k].iloc[first].to_numpy() for k in keys}
        out |= {"chunk": int(part["chunk"].iloc[0]), "pos": np.arange(len(first)), "lo": part["lo"].to_numpy()[first], "hi": part["hi"].to_numpy()[last], "w": w, "s": s}
        return pd.DataFrame(out)

    return blocks.withColumnRenamed(chunk, "chunk").groupBy(*keys, "chunk").applyInPandas(run, schema)


def _falling_edges(blocks: DataFrame, keys: list[str]) -> int:
    """Neighbouring chunks of which the first ends higher than the second begins: one row per chunk."""
    ends = blocks.groupBy(*keys, "chunk").agg(F.min_by(F.col("s") / F.col("w"), "pos").alias("begin"), F.max_by(F.col("s") / F.col("w"), "pos").alias("end"))
    before = F.lag("end").over(W.partitionBy(*keys).orderBy("chunk"))
    return ends.withColumn("before", before).where(F.col("before") > F.col("begin")).count()


def isotonic_fit(cal: DataFrame, keys: Sequence[str], score: str = "p_raw", label: str = "y_true", chunk: int = CHUNK) -> DataFrame:
    """The step function per key: ``lo``, ``hi`` (the block's first and last score) and ``g``, stored; rows without a score or label are left out."""
    keys = list(keys)
    ship(cal.sparkSession)
    usable = cal.where(F.col(score).isNotNull() & F.col(label).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    cells = collapse(usable, keys, score, label).select(*keys, F.col("p").cast("double").alias("lo"), F.col("n").alias("w"), F.col("y").alias("s"))
    cells = materialise(cells, "isotonic-cells")
    most = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // chunk))
    ranged = in_range(cells, range_splitters(cells, keys, "lo", parts), keys, "lo", "_range")
    blocks = materialise(_pooled(ranged.withColumn("hi", F.col("lo")), keys, "_range"), "isotonic")
    turn = 0
    while parts > 1 and _falling_edges(blocks, keys):
        turn += 1
        sizes = blocks.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
        lower = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
        offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
        shift = F.lit(chunk // 2 if turn % 2 else 0)
        placed = blocks.join(offsets, [*keys, "chunk"]).withColumn("_chunk", F.floor((F.col("_off") + F.col("pos") + shift) / F.lit(chunk)))
        blocks = materialise(_pooled(placed.drop("chunk", "pos", "_off"), keys, "_chunk"), "isotonic")
    return blocks.select(*keys, "lo", "hi", (F.col("s") / F.col("w")).alias("g"))


def apply_isotonic(rows: DataFrame, steps: DataFrame, keys: Sequence[str], score: str = "p_raw", parts: int = 64) -> DataFrame:
    """Add ``p_corrected``: the step's value, on a line between steps, that of the end steps outside; null for a null score.

    Rows and the ends of steps fall into value ranges of the key; within a range the nearest ends on either side are
    found in one ordered pass, and where a range has none those of its neighbours count.  Rows whose key has no steps go.
    """
    keys = list(keys)
    cuts = range_splitters(steps, keys, "lo", parts)
    ends = F.explode(F.array(F.struct(F.col("lo").alias("p"), "g"), F.struct(F.col("hi").alias("p"), "g")))
    points = in_range(steps.select(*keys, ends.alias("_point")).withColumn("_p", F.col("_point.p")), cuts, keys, "_p", "_range")
    values = in_range(rows.select(*keys, F.struct(*rows.columns).alias("_row"), F.col(score).cast("double").alias("_p")), cuts, keys, "_p", "_range")
    borders = points.groupBy(*keys, "_range").agg(F.max("_point").alias("_most"), F.min("_point").alias("_least"))
    ranges = steps.select(*keys).distinct().withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(borders, [*keys, "_range"], "left")
    over = W.partitionBy(*keys).orderBy("_range")  # one row per range
    carried = ranges.select(
        *keys, "_range", F.last("_most", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_from_left"),
        F.first("_least", True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("_from_right"),
    )
    both = values.unionByName(points, allowMissingColumns=True)
    # Both passes run forwards over their order: a frame up to the end of a range would be summed anew for each of its rows.
    group, is_row = W.partitionBy(*keys, "_range"), F.col("_row").isNotNull()
    left = F.last("_point", True).over(group.orderBy("_p", is_row).rowsBetween(W.unboundedPreceding, 0))
    right = F.last("_point", True).over(group.orderBy(F.desc("_p"), F.desc(is_row)).rowsBetween(W.unboundedPreceding, 0))
    met = both.select(*keys, "_range", "_row", "_p", left.alias("_left"), right.alias("_right")).where("_row IS NOT NULL").join(carried, [*keys, "_range"])
    a, b = F.coalesce("_left", "_from_left"), F.coalesce("_right", "_from_right")
    line = a["g"] + (b["g"] - a["g"]) * (F.col("_p") - a["p"]) / (b["p"] - a["p"])
    value = F.when(F.col("_p").isNull(), None).when(a.isNull(), b["g"]).when(b.isNull() | (a["p"] == F.col("_p")), a["g"]).otherwise(line)
    return met.select("_row.*", value.alias("p_corrected"))
