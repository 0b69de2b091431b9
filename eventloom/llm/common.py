"""Helpers that the text operators share: Arrow maps over texts and tables in the shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def unused(names: Iterable[str], stem: str) -> str:
    """A column name that is not among the given ones, in any case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Paths of the tables written since the innermost :func:`discarding` began; None outside of one.
_written: list[str] | None = None


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that :func:`stored` writes inside of it when it ends, and lets Spark drop the shuffle files behind them.

    Whatever is computed from them must be written before that.
    """
    global _written
    outer, _written = _written, []
    try:
        yield
    finally:
        mine, _written = _written, outer
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        gc.collect()
        spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    if _written is not None:
        _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a stored table of short columns (some 100 bytes) up to which it is broadcast.
BROADCAST_ROWS = 200_000


def checked_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of short columns, marked for broadcast only if its count is within the bound; else joins shuffle it."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


#: Bytes of texts in one Arrow batch: a worker holds one batch, its strings and its results at a time.
BATCH_BYTES = 2 << 20
#: Rows that Spark decodes at a time from a parquet file; texts of some kilobytes make them a few megabytes.
READ_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver has it from, and bound the batches that are read and that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    context = spark.sparkContext
    if getattr(context, "_eventloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "eventloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._eventloom_shipped = True


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on for other tasks."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map of batches, with its memory released when its task ends."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return freed


def map_texts(
    df: DataFrame, keys: Iterable[str], text: str, made: str, start: Callable[[], Callable[[str | None], tuple]]
) -> DataFrame:
    """One output row per input row: the key columns, then the columns of ``made`` (a DDL string).

    ``start`` runs once in each task and gives the function from a text to the made values; what it keeps beyond the
    task is let go by its ``forget``, if it has one.  Only the named
    columns reach Python, in Arrow batches that Spark bounds by bytes.
    """
    ship(df.sparkSession)
    keys = list(keys)
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*picked.schema.fields[: len(keys)], *T.StructType.fromDDL(made).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        one, arrow = start(), to_arrow_schema(schema)
        for batch in batches:
            rows = [one(x) for x in batch.column(len(keys)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * (len(arrow) - len(keys))
            made_arrays = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keys) :], strict=True)]
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, *made_arrays], schema=arrow)
            del rows, columns, made_arrays
        if hasattr(one, "forget"):
            one.forget()

    return picked.mapInArrow(freeing(run), schema)
