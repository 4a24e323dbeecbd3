"""Windows over long recordings in buckets of the index, so that one recording is many window partitions.

A bucket holds the rows with floor(order / size) alike. What a row needs from other buckets comes either from a halo of
neighbouring rows, or from a window over one row a bucket. No frame runs to the end of its partition, since Spark computes
such a frame anew for each row: what follows a row is what precedes it in descending order.

Rows are joined with one row a bucket, or a recording, by a hash table of the latter: Spark does not foresee how many rows a
sequence is laid out into, and would broadcast the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a bucket.
SIZE = 1 << 16


def place(order: str | Column, size) -> Column:
    return F.floor((F.col(order) if isinstance(order, str) else order) / F.lit(size)).cast("long")


def haloed(samples: DataFrame, keys: list[str], left: int, right: int, idx: str = "idx", size: int = SIZE) -> tuple[DataFrame, Window]:
    """``samples`` with ``_part``, repeated in each bucket within ``left`` before or ``right`` past it, and the window there.

    Frames of up to ``left`` and ``right`` index steps are whole for the rows of the bucket itself (:func:`own`).
    """
    i = F.col(idx)
    rows = samples.withColumn("_part", F.explode(F.sequence(place(i - right, size), place(i + left, size))))
    return rows, Window.partitionBy(*keys, "_part").orderBy(idx)


def own(rows: DataFrame, idx: str = "idx", size: int = SIZE) -> DataFrame:
    """Rows of :func:`haloed` without the halos."""
    return rows.where(F.col("_part") == place(idx, size)).drop("_part")


def _across(keys: list[str]) -> tuple[Window, Window]:
    """Windows over one row a bucket: those before it, and those after it in descending order."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return before, after


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str, order: list[str], size=SIZE) -> DataFrame:
    """Adds the sum of ``value`` up to and including each row in ``order``, whose first column is a number."""
    rows = rows.withColumn("_part", place(order[0], size)).withColumn("_v", value)
    before, _ = _across(keys)
    sums = rows.groupBy(*keys, "_part").agg(F.sum("_v").alias("_v")).withColumn("_upto", F.sum("_v").over(before)).drop("_v")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_in", F.sum("_v").over(inside)).join(sums.hint("shuffle_hash"), [*keys, "_part"])
    return summed.withColumn(name, F.col("_in") + F.coalesce("_upto", F.lit(0))).drop("_part", "_v", "_in", "_upto")


def largest_before(rows: DataFrame, keys: list[str], value: Column, name: str, order: list[str], size=SIZE) -> DataFrame:
    """Adds the largest ``value`` of all rows before each row in ``order``, whose first column is a number; null for the first."""
    rows = rows.withColumn("_part", place(order[0], size)).withColumn("_v", value)
    before, _ = _across(keys)
    most = rows.groupBy(*keys, "_part").agg(F.max("_v").alias("_v")).withColumn("_upto", F.max("_v").over(before)).drop("_v")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("_in", F.max("_v").over(inside)).join(most.hint("shuffle_hash"), [*keys, "_part"])
    return scanned.withColumn(name, F.greatest("_in", "_upto")).drop("_part", "_v", "_in", "_upto")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, size=SIZE) -> DataFrame:
    """Adds the place of each row in ``order``, from 0."""
    return running_sum(rows, keys, F.lit(1).cast("long"), name, order, size).withColumn(name, F.col(name) - 1)


def known_beside(rows: DataFrame, keys: list[str], known: Column, idx: str = "idx", size=SIZE) -> DataFrame:
    """Adds ``_p``, the last non-null ``known`` at or before each row, and ``_n``, the first one at or after it.

    ``known`` is a struct that starts with the row's index.
    """
    rows = rows.withColumn("_part", place(idx, size)).withColumn("_k", known)
    before, after = _across(keys)
    ends = rows.groupBy(*keys, "_part").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    ends = ends.select(*keys, "_part", F.last("_last", True).over(before).alias("_before"), F.last("_first", True).over(after).alias("_after"))
    up = Window.partitionBy(*keys, "_part").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_part").orderBy(F.desc(idx)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.last("_k", True).over(up)).withColumn("_n", F.last("_k", True).over(down)).join(ends.hint("shuffle_hash"), [*keys, "_part"])
    return rows.withColumns({"_p": F.coalesce("_p", "_before"), "_n": F.coalesce("_n", "_after")}).drop("_part", "_k", "_before", "_after")


def beside(rows: DataFrame, keys: list[str], order: list[str], value: Column, size) -> DataFrame:
    """Adds ``_before`` and ``_after``: the non-null structs ``value`` (which start with the order's first column) of the
    row before and the row after each row in ``order``, however far away."""
    rows = rows.withColumn("_part", place(order[0], size)).withColumn("_k", value)
    before, after = _across(keys)
    ends = rows.groupBy(*keys, "_part").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    ends = ends.select(*keys, "_part", F.last("_last", True).over(before).alias("_left"), F.last("_first", True).over(after).alias("_right"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = rows.withColumn("_before", F.lag("_k").over(inside)).withColumn("_after", F.lead("_k").over(inside)).join(ends.hint("shuffle_hash"), [*keys, "_part"])
    return rows.withColumns({"_before": F.coalesce("_before", "_left"), "_after": F.coalesce("_after", "_right")}).drop("_part", "_k", "_left", "_right")
