"""Sequences of samples: missing runs, masks, intervals, peaks, crossings, artifacts, stitching.

Windows over samples work in buckets of the index (:mod:`axonflow.operators.buckets`); only windows over intervals, which
are far fewer than samples, take a whole recording.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonflow.operators import buckets
from axonflow.operators.chunked import Sparse, by_chunk, chunks, indexed, key_schema, with_moments
from axonflow.sources.scratch import written


def _beside(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a chunk of the last ``known`` sample at or before each one (-1: none) and of the first at or after it (length: none)."""
    i, n = np.arange(len(known)), len(known)
    return np.maximum.accumulate(np.where(known, i, -1)), np.minimum.accumulate(np.where(known, i, n)[::-1])[::-1]


def fill_missing(samples: DataFrame | Sparse, max_gap: int, keys: list[str], idx: str = "idx", core: int = buckets.SIZE) -> DataFrame:
    """Handle missing runs: keys, idx, value, is_valid.

    Runs of at most ``max_gap`` samples are interpolated, at the ends they take the nearest value; longer runs become 0
    and invalid. A channel without any value is 0 and invalid. A chunk's halo is longer than the runs that are filled.
    """
    same, halo = [], max_gap + 1
    core = max(core, halo)
    if not isinstance(samples, Sparse):
        ends = samples.groupBy(*keys).agg(F.min(idx).alias("_low"), F.max(idx).alias("_high"))
        samples, same = samples.join(ends.hint("shuffle_hash"), keys), ["_low", "_high"]

    def run(row) -> dict:
        x, at, known, n = row.value, row.at, row.known, len(row.value)
        p, q = _beside(known)
        # without a gap in the indexes, an end that the halo cuts off is as far away as the real one: too far
        low, high = (row._low, row._high) if same else (row.first, row.last)
        has_p, has_q = p >= 0, q < n
        q = np.minimum(q, n - 1)
        i, j = np.where(has_p, at[p], low - 1), np.where(has_q, at[q], high + 1)
        between = x[p] + (x[q] - x[p]) * ((at - i) / np.maximum(j - i, 1))
        filled = np.where(has_p, np.where(has_q, between, x[p]), x[q])
        short = ~known & (j - i - 1 <= max_gap) & (has_p | has_q)
        own = (at >= row.chunk * core) & (at < (row.chunk + 1) * core)
        return {idx: at[own], "value": np.where(known, x, np.where(short, filled, 0.0))[own], "is_valid": (known | short)[own]}

    rows, columns = indexed(samples, idx)
    packed = chunks(rows, keys, core, halo, halo, columns, idx, same)
    return by_chunk(packed, keys, f"{_kind(samples, idx)}, value double, is_valid boolean", run)


def _kind(samples: DataFrame | Sparse, idx: str) -> str:
    return key_schema(samples.rows if isinstance(samples, Sparse) else samples, [idx])


def runs(flags: DataFrame, keys: list[str], flag: Column, idx: str = "idx") -> DataFrame:
    """Runs of consecutive samples with ``flag``: keys, first, last."""
    kept = buckets.numbered(flags.where(flag).select(*keys, idx), keys, [idx], "_place")
    return kept.withColumn("_island", F.col(idx) - F.col("_place")).drop("_place").groupBy(*keys, "_island").agg(F.min(idx).alias("first"), F.max(idx).alias("last")).drop("_island")


def dilate_invalid(samples: DataFrame, margin: int, keys: list[str], idx: str = "idx", valid: str = "is_valid") -> DataFrame:
    """Invalid samples spread by ``margin`` samples to both sides: ``valid`` is replaced."""
    rows, w = buckets.haloed(samples, keys, margin, margin, idx)
    return buckets.own(rows.withColumn(valid, F.min(valid).over(w.rangeBetween(-margin, margin))), idx)


def valid_everywhere(masks: DataFrame, idx: str = "idx", valid: str = "is_valid") -> DataFrame:
    """Intersection of the masks of all signals: idx, and whether every signal that has the sample is valid there."""
    return masks.groupBy(idx).agg(F.bool_and(valid).alias(valid))


def mask_intervals(samples: DataFrame, keys: list[str], flag: Column, rate: float, t_start: float = 0.0, idx: str = "idx") -> DataFrame:
    """Runs of ``flag`` as intervals of time: keys, start, end."""
    at = lambda c: F.col(c) / F.lit(rate) + F.lit(t_start)
    return runs(samples, keys, flag, idx).select(*keys, at("first").alias("start"), at("last").alias("end"))


def keep_durations(intervals: DataFrame, shortest=None, longest=None) -> DataFrame:
    """Intervals with shortest <= end - start <= longest."""
    length = F.col("end") - F.col("start")
    if shortest is not None:
        intervals = intervals.where(length >= shortest)
    return intervals if longest is None else intervals.where(length <= longest)


def merge_close(intervals: DataFrame, min_gap, keys: list[str], bucket=buckets.SIZE) -> DataFrame:
    """Merge intervals whose gap to what lies before is under ``min_gap``; the end is the largest of the merged ones.

    The running maximum of ends and the number of the merged interval are scans over buckets of ``bucket`` units of time.
    """
    rows = buckets.largest_before(intervals, keys, F.col("end"), "_reach", ["start", "end"], bucket)
    new = F.when(F.col("start") - F.col("_reach") < min_gap, 0).otherwise(1)
    rows = buckets.running_sum(rows, keys, new, "_group", ["start", "end"], bucket)
    return rows.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def differences(traces: DataFrame, order: int, keys: list[str], idx: str = "idx") -> DataFrame:
    """0th, 1st or 2nd difference of each trace; the index counts in the differenced series, from 0."""
    rows, w = buckets.haloed(traces, keys, 0, order, idx)
    for _ in range(order):
        rows = rows.withColumn("value", F.lead("value").over(w) - F.col("value")).where("value IS NOT NULL")
    return buckets.own(rows, idx)


def _runs(order: int, core: int):
    """Of a chunk: runs of equal values of its differences. Those inside that are peaks, and the two at its ends."""

    def runs_of(row) -> dict:
        x = np.asarray(row.value, float)
        at = np.asarray(row.at)
        for _ in range(order):
            x, at = x[1:] - x[:-1], at[:-1]
            x, at = x[~np.isnan(x)], at[~np.isnan(x)]
        own = at < (row.chunk + 1) * core
        x, at = x[own], at[own]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
        last = np.append(first[1:], len(x)) - 1 if len(x) else first
        v, n = x[first], len(first)
        left, right = np.append(np.nan, v[:-1]), np.append(v[1:], np.nan)
        begins, ends = np.arange(n) == 0, np.arange(n) == n - 1
        kept = begins | ends | ((v > left) & (v > right))
        out = {"a": at[first], "b": at[last], "value": v, "left": left[:n], "right": right[:n], "begins": begins, "ends": ends}
        return {name: values[kept] for name, values in out.items()}

    return runs_of


def peaks(traces: DataFrame, height: float, keys: list[str], idx: str = "idx", order: int = 0, core: int = buckets.SIZE, flat: bool = True) -> DataFrame:
    """Local maxima of at least ``height``: keys, idx, value. A flat top counts once, at its middle (lower) sample, or
    without ``flat`` not at all; ends never.

    With ``order`` the trace is differenced first, as by :func:`differences`. One shuffle packs the trace in chunks; a chunk
    finds the peaks inside it, and only its first and last run of equal values meet those of other chunks.
    """
    packed = chunks(traces.select(*keys, idx, F.col(idx).alias("at"), F.col("value").cast("double").alias("value")), keys, core, 0, order, ("value", "at"), idx)
    schema = "a long, b long, value double, left double, right double, begins boolean, ends boolean"
    runs_ = written(by_chunk(packed, keys, schema, _runs(order, core)), "peaks")  # read twice, inside and at the ends of chunks
    middle = F.floor((F.col("a") + F.col("b")) / 2).alias(idx)
    inside = runs_.where("NOT begins AND NOT ends")
    w = Window.partitionBy(*keys).orderBy("a")
    edges = runs_.where("begins OR ends").withColumns({"left": F.when(F.col("begins"), F.lag("value").over(w)).otherwise(F.col("left")), "right": F.when(F.col("ends"), F.lead("value").over(w)).otherwise(F.col("right")), "_on": F.lag("ends").over(w) & F.col("begins") & (F.lag("value").over(w) == F.col("value"))})
    edges = edges.withColumn("_run", F.count_if(~F.coalesce("_on", F.lit(False))).over(w))
    whole = edges.groupBy(*keys, "_run").agg(F.min_by("left", "a").alias("left"), F.max_by("right", "a").alias("right"), F.first("value").alias("value"), F.min("a").alias("a"), F.max("b").alias("b"))
    whole = whole.where((F.col("value") > F.col("left")) & (F.col("value") > F.col("right")))
    both = inside.select(*keys, "a", "b", "value").unionByName(whole.select(*keys, "a", "b", "value"))
    both = both if flat else both.where("a = b")
    return both.where(F.col("value") >= height).select(*keys, middle, "value")


def unit_events(traces: DataFrame, derivative: int, height: float, keys: list[str], idx: str = "idx", flat: bool = True) -> DataFrame:
    """Unit events: peaks of the trace or of its first or second difference, indexed in the differenced series."""
    return peaks(traces, height, keys, idx, derivative, flat=flat)


def spike_events(spikes: DataFrame) -> DataFrame:
    return spikes.where("value > 0")


def upward_crossings(samples: DataFrame, threshold: float, keys: list[str], idx: str = "idx") -> DataFrame:
    """Samples at or over the threshold whose predecessor is under it."""
    rows, w = buckets.haloed(samples, keys, 1, 0, idx)
    rows = buckets.own(rows.withColumn("_before", F.lag("value").over(w)), idx)
    return rows.where((F.col("value") >= threshold) & (F.col("_before") < threshold)).drop("_before")


def step_changes(samples: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Indices after which the slope (rounded to three decimals) changes by more than 1."""
    rows, w = buckets.haloed(samples, keys, 0, 2, idx)
    rows = rows.withColumn("_d", F.bround(F.lead("value").over(w) - F.col("value"), 3))
    rows = buckets.own(rows.withColumn("_dd", F.lead("_d").over(w) - F.col("_d")), idx)
    return rows.where(F.abs("_dd") > 1).select(*keys, (F.col(idx) + 1).alias(idx), F.col("_dd").alias("change"))


def suppress_artifacts(samples: DataFrame | Sparse, rate: float, keys: list[str], limit: float = 1500.0, max_gap_seconds: float = 60.0, width: int = 75, idx: str = "idx", core: int = buckets.SIZE) -> DataFrame:
    """Subtract the mean; fade to 0 around samples over ``limit`` by an inverted Hann window; keys, idx, value, flagged.

    Gaps between flags that last less than ``max_gap_seconds`` are flagged as well. A chunk's halo is longer than the gaps and
    than half the window, so what lies beyond it does not matter.
    """
    half = width // 2
    halo = max(half, math.ceil(max_gap_seconds * rate)) + 1
    core = max(core, halo)

    def run(row) -> dict:
        v, at, n = row.value - row._mean_value, row.at, len(row.value)
        p, q = _beside(row.known & ((np.abs(v) > limit) | np.isnan(v)))
        has_p, has_q = p >= 0, q < n
        i, j = at[p], at[np.minimum(q, n - 1)]
        inside = (has_p & (i == at)) | (has_p & has_q & ((j - i - 1) / rate < max_gap_seconds))
        far = half + 1
        distance = np.where(inside, 0, np.minimum(np.where(has_p, at - i, far), np.where(has_q, j - at, far)))
        fade = np.where(distance <= half, 1 - 0.5 * (1 - np.cos(2 * np.pi * (half + distance) / (width - 1))), 1.0)
        own = (at >= row.chunk * core) & (at < (row.chunk + 1) * core)
        return {idx: at[own], "value": (v * fade)[own], "flagged": inside[own], "_known": row.known[own]}

    rows, columns = indexed(samples, idx)
    rows, moments = with_moments(rows, keys, ["value"])
    packed = chunks(rows, keys, core, halo, halo, columns, idx, moments)
    out = by_chunk(packed, keys, f"{_kind(samples, idx)}, value double, flagged boolean, _known boolean", run)
    return out.select(*keys, idx, F.when(F.col("_known"), F.col("value")).alias("value"), "flagged")


def stitch_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, t_start, fs, values) on one clock: keys, idx, t, value, filled.

    The grid runs from the first start to the last stop; each segment stands at its nearest grid index, what overflows
    is cut, holes are filled on a straight line between their ends.
    """
    stop = F.col("t_start") + (F.size("values") - 1) / F.col("fs")
    ends = segments.groupBy(*keys).agg(F.min("t_start").alias("_t0"), F.max(stop).alias("_t1"), F.max("fs").alias("_fs"))
    ends = ends.withColumn("_last", F.rint((F.col("_t1") - F.col("_t0")) * F.col("_fs")).cast("long"))
    rows = segments.join(ends.hint("shuffle_hash"), keys).select(*keys, "_last", F.rint((F.col("t_start") - F.col("_t0")) * F.col("_fs")).cast("long").alias("_at"), F.posexplode("values").alias("_k", "value"))
    rows = rows.withColumn("idx", F.col("_at") + F.col("_k")).where("idx <= _last").groupBy(*keys, "idx").agg(F.max_by("value", "_at").alias("value"))
    grid = ends.select(*keys, "_t0", "_fs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("idx"))
    rows = grid.join(rows.hint("merge"), [*keys, "idx"], "left")
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("idx").alias("i"), F.col("value").alias("v")))
    rows = buckets.known_beside(rows, keys, known)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("idx") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))
    return rows.select(*keys, "idx", (F.col("_t0") + F.col("idx") / F.col("_fs")).alias("t"), F.coalesce("value", line).alias("value"), F.col("value").isNull().alias("filled"))


def moving_mean(samples: DataFrame, k: int, keys: list[str], idx: str = "idx") -> DataFrame:
    """Boxcar mean of ``k`` samples, of the same length, with zeros beyond the ends."""
    rows, w = buckets.haloed(samples, keys, k // 2, (k - 1) // 2, idx)
    return buckets.own(rows.withColumn("value", F.sum("value").over(w.rowsBetween(-(k // 2), (k - 1) // 2)) / k), idx)
