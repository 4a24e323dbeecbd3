"""Selections of events, samples, units and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonflow.operators import buckets


def restrict_window(events: DataFrame, t_start=None, t_end=None, t: str = "t") -> DataFrame:
    """Events with t_start <= t <= t_end; either side may be open."""
    if t_start is not None:
        events = events.where(F.col(t) >= F.lit(t_start))
    return events if t_end is None else events.where(F.col(t) <= F.lit(t_end))


def slice_periods(samples: DataFrame, windows: DataFrame, rate: float, key: str = "subject", idx: str = "idx") -> DataFrame:
    """Samples of each period: minutes become indices by truncation, the end is exclusive; adds ``period``."""
    edge = lambda minutes: (F.col(minutes) * F.lit(rate) * 60).cast("long")
    bounds = windows.select(key, "period", edge("start_min").alias("_low"), edge("end_min").alias("_high"))
    inside = (F.col(idx) >= F.col("_low")) & (F.col(idx) < F.col("_high"))
    return samples.join(bounds, key).where(inside).drop("_low", "_high")


def missing_windows(samples: DataFrame, windows: DataFrame, key: str = "subject") -> DataFrame:
    """Subjects that have samples and no windows; the callers treat any row as an error."""
    return samples.select(key).distinct().join(windows.select(key).distinct(), key, "left_anti")


def trim_edges(samples: DataFrame, keys: list[str], n: int, idx: str = "idx") -> DataFrame:
    """Drop ``n`` samples at both ends of each group of consecutive indices; groups of 2 * n or fewer stay whole."""
    ends = samples.groupBy(*keys).agg(F.min(idx).alias("_low"), F.max(idx).alias("_high"), F.count(F.lit(1)).alias("_n"))
    keep = (F.col("_n") <= 2 * n) | ((F.col(idx) >= F.col("_low") + n) & (F.col(idx) <= F.col("_high") - n))
    return samples.join(ends, keys).where(keep).drop("_low", "_high", "_n")


def keep_labels(events: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    return events.where(F.col(label).isin(labels))


def drop_label_prefix(events: DataFrame, prefix: str = "TTL Input", label: str = "label") -> DataFrame:
    """Experiment events alone: labels that start with the pulse input's name go."""
    return events.where(~F.coalesce(F.col(label).startswith(prefix), F.lit(False)))


def delete_positions(clock: DataFrame, positions: DataFrame, key: str = "recording_id", order: str = "t", bucket=3_600_000_000) -> DataFrame:
    """Delete annotated positions (key, position) from each recording's pulses and number the rest anew from 0.

    Pulses are numbered in buckets of ``order``, by default an hour of microseconds.
    """
    numbered = buckets.numbered(clock, [key], [order], "position", bucket)
    kept = numbered.join(positions.select(key, "position").distinct(), [key, "position"], "left_anti")
    return buckets.numbered(kept, [key], [order], "position", bucket)


def interval_after_event(events: DataFrame, start: str, minutes: float, key: str = "recording_id") -> DataFrame:
    """[t0, t1) of each recording: from its first event whose label starts with ``start``, for so many minutes."""
    first = events.where(F.col("label").startswith(start)).groupBy(key).agg(F.min("t").alias("t0"))
    return first.withColumn("t1", F.col("t0") + F.lit(minutes) * 60)


def select_units(trains: DataFrame, units=None) -> DataFrame:
    """All units, one, a list, or those of a table (unit_id)."""
    if units is None:
        return trains
    if isinstance(units, DataFrame):
        return trains.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    return trains.where(F.col("unit_id").isin(units if isinstance(units, (list, tuple)) else [units]))


def crop(pixels: Column, height: int, width: int, x0: int, y0: int, x1: int, y1: int) -> Column:
    """Half-open crop of row-major pixels; the corners are given with y upwards and in any order."""
    (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
    top, bottom = height - y1, height - y0
    if top >= bottom or x0 >= x1:
        return F.array().cast("array<float>")
    rows = F.sequence(F.lit(top), F.lit(bottom - 1))
    return F.flatten(F.transform(rows, lambda y: F.slice(pixels, y * width + x0 + 1, F.lit(x1 - x0))))


def every_kth(frames: DataFrame, max_frames: int, key: str = "recording_id", idx: str = "frame_idx") -> DataFrame:
    """Every k-th frame with k = max(n // max_frames, 1) of each recording."""
    steps = frames.groupBy(key).agg(F.greatest(F.floor(F.count(F.lit(1)) / max_frames), F.lit(1)).alias("_k"))
    return frames.join(steps, key).where(F.col(idx) % F.col("_k") == 0).drop("_k")


def frames_in_range(clock: DataFrame, t_start, t_end, frames_per_file: int = 1000, key: str = "recording_id") -> DataFrame:
    """First frame with t >= t_start, last with t <= t_end, and the numbers of the files that hold them."""
    out = clock.groupBy(key).agg(F.min(F.when(F.col("t") >= t_start, F.col("frame_idx"))).alias("first_frame"), F.max(F.when(F.col("t") <= t_end, F.col("frame_idx"))).alias("last_frame"))
    number = lambda c: F.floor(F.col(c) / frames_per_file)
    return out.where("first_frame <= last_frame").withColumn("files", F.sequence(number("first_frame"), number("last_frame")))


def curated_units(trains: DataFrame, decisions: DataFrame) -> DataFrame:
    """Units accepted in ``decisions`` (unit_id, accepted); an undecided unit is an error."""
    if not decisions.where("accepted IS NULL").isEmpty():
        raise ValueError("some units are undecided")
    return trains.join(decisions.where("accepted").select("unit_id").distinct(), "unit_id", "left_semi")


def complete_pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.dropna(subset=[x, y])
