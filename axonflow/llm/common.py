"""Helpers shared by the training-data operators: tables, shared scratch tables, size-checked broadcast."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonflow.sources.scratch import scratch_path

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark gathers for a Python worker at a time while a table is written; whole texts make its default large.
ARROW_ROWS = 1000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def short_arrow_batches(spark: SparkSession):
    """Jobs started inside send ``ARROW_ROWS`` rows at most to a worker at a time, which bounds both sides' buffers."""
    before = spark.conf.get(_ARROW_SETTING)
    if 0 < int(before) <= ARROW_ROWS:
        yield
        return
    spark.conf.set(_ARROW_SETTING, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_ARROW_SETTING, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with short_arrow_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table may be broadcast if its rows take no more than this, by the widths below.
BROADCAST_BYTES = 2 << 20
_WIDE = 64  # of strings and binary values: digests and names


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` (a written table of numbers, digests or names, so counting is cheap) for broadcast if it is small."""
    width = sum(_WIDE if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema) + 16
    most = max_bytes // width
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def with_row_ids(docs: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` with a number in ``column`` that no two rows share: doc_id itself, unless ids repeat or are null.

    Where they do, rows are numbered in the order of doc_id (nulls last) and text, and written, so that the numbers hold.
    """
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(column, F.col("doc_id"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text", *rest)
    return materialize(ordered.select("*", F.monotonically_increasing_id().alias(column)), name)


def without(docs: DataFrame, dropped: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key``, which no two rows share, is not in ``dropped`` (key); broadcast only if these are few."""
    ids = broadcast_if_small(materialize(dropped.select(key).distinct(), name))
    return docs.join(ids, key, "left_anti").select(*docs.columns)


def slices(batches, rows: int = 256):
    """Short Arrow batches, so that a worker holds little at a time; what it has freed goes back when a task ends.

    Workers live on from stage to stage, and allocators keep freed memory for them otherwise.
    """
    import pyarrow as pa

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)
