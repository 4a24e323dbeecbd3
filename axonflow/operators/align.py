"""Alignment of clocks: nearest-time joins, frame labels, sync pulses, pairing of signals, project joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonflow.operators import buckets


#: Time of a bucket of pulses: an hour in microseconds. A bucket's pulses are one window partition.
BUCKET = 3_600_000_000


def neighbours(queries: DataFrame, samples: DataFrame, bucket, key: str = "recording_id", t: str = "t") -> DataFrame:
    """Each query (key, query_id, t) with ``before``, the last sample at or before t, and ``after``, the first one past
    it, as (t, idx) structs or null. ``samples``: key, idx, t.

    Time is cut into buckets, so that a long recording is many window partitions. What lies outside a query's bucket
    comes from the bucket's neighbours, found by windows over one row a bucket; empty buckets are skipped over.
    """
    place = F.floor(F.col(t) / F.lit(bucket)).alias("_bucket")
    sample = F.struct(F.col(t).alias("t"), F.col("idx").alias("idx")).alias("_s")
    left = samples.select(key, place, F.col(t).alias("_t"), F.lit(0).alias("_side"), sample, F.lit(None).cast("long").alias("query_id"))
    right = queries.select(key, place, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), "query_id")
    rows = left.unionByName(right)
    edges = rows.groupBy(key, "_bucket").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    # frames to the end would be computed anew for each row: what follows precedes in descending order
    past = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        key, "_bucket", F.last("_last", True).over(past("_bucket").partitionBy(key)).alias("_before"),
        F.last("_first", True).over(past(F.desc("_bucket")).partitionBy(key)).alias("_after"),
    )
    inside = Window.partitionBy(key, "_bucket").orderBy("_t", "_side", F.col("_s.idx"))
    rows = rows.withColumn("_b", F.last("_s", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_a", F.last("_s", True).over(past(F.desc("_t"), F.desc("_side"), F.desc("_s.idx")).partitionBy(key, "_bucket")))
    found = rows.where("_side = 1").join(edges, [key, "_bucket"], "left")
    return found.select(key, "query_id", F.col("_t").alias("t"), F.coalesce("_b", "_before").alias("before"), F.coalesce("_a", "_after").alias("after"))


def nearest(queries: DataFrame, samples: DataFrame, bucket, key: str = "recording_id", t: str = "t") -> DataFrame:
    """Nearest sample of each query: key, query_id, t, idx, sample_t; the lower one at an exact midpoint."""
    near = neighbours(queries, samples, bucket, key, t)
    left = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t")))
    best = F.when(left, F.col("before")).otherwise(F.col("after"))
    return near.select(key, "query_id", "t", best["idx"].alias("idx"), best["t"].alias("sample_t"))


def frame_labels(samples: DataFrame, frames: DataFrame, key: str = "recording_id", bucket: int = 1 << 16) -> DataFrame:
    """Label every sample with its frame: k + 1 for samples in (idx[k], idx[k + 1]], 0 for all others.

    ``samples``: key, idx; ``frames``: key, frame_idx (k from 0), idx (its sample).
    """
    spans = frames.select(key, "frame_idx", F.col("idx").alias("low"), F.lead("idx").over(Window.partitionBy(key).orderBy("frame_idx")).alias("high"))
    spans = spans.where("high > low")
    place = lambda c: F.floor(c / bucket)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(place(F.col("low") + 1), place(F.col("high")))))
    labelled = samples.withColumn("_bucket", place(F.col("idx"))).join(spans, [key, "_bucket"]).where((F.col("idx") > F.col("low")) & (F.col("idx") <= F.col("high")))
    labels = labelled.select(key, "idx", (F.col("frame_idx") + 1).alias("frame_label"))
    return samples.join(labels, [key, "idx"], "left").withColumn("frame_label", F.coalesce("frame_label", F.lit(0)).cast("long"))


def phase_at_events(events: DataFrame, phases: DataFrame, keys: tuple[str, ...] = ("recording_id", "idx")) -> DataFrame:
    """Events with the phase of their sample."""
    return events.join(phases, list(keys))


def outside_signal(events: DataFrame, phases: DataFrame, keys: tuple[str, ...] = ("recording_id", "idx")) -> DataFrame:
    """Events whose index lies outside the signal; the callers treat any row as an error."""
    return events.join(phases, list(keys), "left_anti")


def downsample(samples: DataFrame, matched: DataFrame, key: str = "recording_id") -> DataFrame:
    """Samples at the matched indices (key, query_id, idx, as of :func:`nearest`), numbered by query_id."""
    return matched.select(key, F.col("query_id").alias("frame_idx"), "idx").join(samples, [key, "idx"])


def clock_conflicts(first: DataFrame, second: DataFrame, key: str = "recording_id") -> DataFrame:
    """Samples at which two channels do not share a clock: on one side alone, or at another time."""
    a, b = first.select(key, "idx", F.col("t").alias("t_1")), second.select(key, "idx", F.col("t").alias("t_2"))
    return a.join(b, [key, "idx"], "full").where(~F.col("t_1").eqNullSafe(F.col("t_2")))


def pair_signals(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("recording_id", "frame_idx")) -> DataFrame:
    """(keys, x, y) of two signals with a value column each."""
    return first.select(*keys, F.col("value").alias("x")).join(second.select(*keys, F.col("value").alias("y")), list(keys))


def project_summary(experiments: DataFrame, parameters: DataFrame, key: str, imaging: str, ephys: str) -> DataFrame:
    """Per key of either sheet: whether it is an experiment, has parameters, imaging and ephys, and its search text."""
    e = experiments.withColumn("_e", F.lit(True)).withColumn("search_text", F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in experiments.columns))))
    p = parameters.select(key).distinct().withColumn("_p", F.lit(True))
    both = e.join(p, key, "full")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return both.select(
        key, flag(F.col("_e")).alias("is_experiment"), flag(F.col("_p")).alias("has_parameters"),
        flag(F.col(imaging).isNotNull()).alias("has_imaging"), flag(F.col(ephys).isNotNull()).alias("has_ephys"), "search_text",
    )


def with_condition(rows: DataFrame, conditions: DataFrame, known_only: bool = False) -> DataFrame:
    """Adds condition and is_drug by subject; unknown subjects are labelled 'unknown', or left out."""
    if known_only:
        return rows.join(conditions, "subject")
    return rows.join(conditions, "subject", "left").withColumns({"condition": F.coalesce("condition", F.lit("unknown")), "is_drug": F.coalesce("is_drug", F.lit(False))})


def pulse_alternation(pulses: DataFrame, key: str = "recording_id", bucket=BUCKET) -> DataFrame:
    """Whether the labels of each recording's pulses alternate: each equals the one two before, the last two differ."""
    rows, w = buckets.haloed(buckets.numbered(pulses, [key], ["t"], "_place", bucket), [key], 2, 0, "_place")
    rows = buckets.own(rows.withColumn("_two", F.lag("label", 2).over(w)).withColumn("_one", F.lag("label", 1).over(w)), "_place")
    same = F.coalesce(F.bool_and(F.when(F.col("_two").isNotNull(), F.col("_two") == F.col("label"))), F.lit(True))
    last = F.max_by(F.coalesce(F.col("_one") != F.col("label"), F.lit(False)), "t")
    return rows.groupBy(key).agg((same & last).alias("alternates"))


def _steps(clock: DataFrame, key: str, bucket) -> DataFrame:
    """key, t, position (from 0) and dt, the time to the next pulse."""
    rows = buckets.beside(clock.select(key, "t"), [key], ["t"], F.struct("t"), bucket)
    rows = rows.select(key, "t", (F.col("_after.t") - F.col("t")).alias("dt"))
    return buckets.numbered(rows, [key], ["t"], "position", bucket)


def sync_gaps(clock: DataFrame, threshold, key: str = "recording_id", bucket=BUCKET) -> DataFrame:
    """Gaps over ``threshold`` between pulses that follow each other: key, position, t, dt."""
    return _steps(clock, key, bucket).where(F.col("dt") > threshold).select(key, "position", "t", "dt")


def repair_gaps(clock: DataFrame, threshold, step, key: str = "recording_id", bucket=BUCKET) -> DataFrame:
    """Fill each gap with evenly spaced pulses: key, position (numbered anew), t, inserted.

    A gap of dt holds g = round(dt / step) intervals (halves to the even number) and gets g - 1 pulses. ``t`` is a double.
    """
    rows = _steps(clock, key, bucket)
    parts = F.when(F.col("dt") > threshold, F.greatest(F.rint(F.col("dt") / step).cast("int"), F.lit(1))).otherwise(F.lit(1))
    rows = rows.withColumn("_g", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    at = F.col("t") + F.coalesce(F.col("_k") * F.col("dt") / F.col("_g"), F.lit(0.0))
    rows = rows.select(key, at.cast("double").alias("t"), (F.col("_k") > 0).alias("inserted"))
    return buckets.numbered(rows, [key], ["t"], "position", bucket)


def low_confidence(clock: DataFrame, threshold, step, key: str = "recording_id") -> DataFrame:
    """Ranges [i, i + g] around repaired gaps, in original positions."""
    return sync_gaps(clock, threshold, key).select(key, F.col("position").alias("first"), (F.col("position") + F.rint(F.col("dt") / step).cast("int")).alias("last"))
