"""Slices of a signal around events and their averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_samples(window, rate: float) -> tuple[int, int]:
    """Samples before and after an event; one number stands for both sides, signs do not matter."""
    before, after = window if isinstance(window, (tuple, list)) else (window, window)
    return round(abs(before) * rate), round(abs(after) * rate)


def peri_event(samples: DataFrame, events: DataFrame, rate: float, window, t_start: float = 0.0, drop_boundary: bool = True, key: str = "recording_id") -> DataFrame:
    """Signal around events: key, event_id, t, offset, value.

    ``samples`` (key, idx from 0, value), ``events`` (key, event_id, t). An event lies on the sample nearest to it (halves
    to the even one). Events whose window leaves the signal are dropped, or kept with null values.
    """
    before, after = window_samples(window, rate)
    n = samples.groupBy(key).agg((F.max("idx") + 1).alias("_n"))
    placed = events.join(n, key).withColumn("_at", F.rint((F.col("t") - F.lit(t_start)) * F.lit(rate)).cast("long"))
    inside = (F.col("_at") - before >= 0) & (F.col("_at") + after < F.col("_n"))
    if drop_boundary:
        placed = placed.where(inside)
    wanted = placed.select(key, "event_id", "t", "_at", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    wanted = wanted.withColumn("idx", F.col("_at") + F.col("offset"))
    # merged, since Spark estimates rows before they are laid out over the offsets, and would broadcast them
    joined = wanted.join(samples.select(key, "idx", "value").hint("merge"), [key, "idx"], "inner" if drop_boundary else "left")
    return joined.select(key, "event_id", "t", "offset", "value")


def event_triggered_average(samples: DataFrame, events: DataFrame, rate: float, window, t_start: float = 0.0, drop_boundary: bool = True, key: str = "recording_id", denominator: str = "kept") -> DataFrame:
    """Mean, standard deviation and standard error at each offset: key, offset, n, mean, std, sem.

    With one event the deviation is 0. With kept boundary events each offset counts the events that reach it, and has
    nulls where none does. Recordings without a kept event have zeros. ``denominator='all_events'`` divides the sum by
    the number of all events, dropped ones too (the deprecated frame-window average).
    """
    before, after = window_samples(window, rate)
    # events on one sample have one slice: what is laid out over the offsets are samples with events, not events
    counts = samples.groupBy(key).agg((F.max("idx") + 1).alias("_n"))
    at = F.rint((F.col("t") - F.lit(t_start)) * F.lit(rate)).cast("long")
    placed = events.groupBy(key, at.alias("_at")).agg(F.count(F.lit(1)).alias("_w")).join(counts, key)
    if drop_boundary:
        placed = placed.where((F.col("_at") - before >= 0) & (F.col("_at") + after < F.col("_n")))
    wanted = placed.select(key, "_w", "_at", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("idx", F.col("_at") + F.col("offset"))
    slices = wanted.join(samples.select(key, "idx", "value").hint("merge"), [key, "idx"], "inner" if drop_boundary else "left")
    w = F.col("_w")
    n = F.sum(F.when(F.col("value").isNotNull(), w).otherwise(F.lit(0).cast("long")))
    sums = slices.groupBy(key, "offset").agg(n.alias("n"), F.sum(w * F.col("value")).alias("_sum"), F.sum("_w").alias("_rows"))
    sums = sums.withColumn("mean", F.try_divide("_sum", F.col("n").cast("double")))
    # from the means, so that the deviation keeps its digits
    spread = slices.join(sums.select(key, "offset", "mean").hint("shuffle_hash"), [key, "offset"]).groupBy(key, "offset").agg(F.sum(w * (F.col("value") - F.col("mean")) ** 2).alias("_s2"))
    stats = sums.join(spread, [key, "offset"]).withColumn("std", F.sqrt(F.try_divide(F.col("_s2"), F.col("n").cast("double") - 1)))
    stats = stats.withColumn("std", F.when(F.col("n") == 0, F.lit(None)).when(F.col("_rows") == 1, F.lit(0.0)).otherwise(F.col("std")))
    grid = samples.select(key).distinct().withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    out = grid.join(stats, [key, "offset"], "left")
    none = F.col("_rows").isNull()
    if denominator == "all_events":
        total = events.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
        out = out.join(total, key, "left").withColumn("mean", F.col("_sum") / F.col("_all"))
    sem = F.when(F.col("n") > 0, F.col("std") / F.sqrt("n"))
    zero = lambda c, name: F.when(none, F.lit(0.0)).otherwise(c).alias(name)
    return out.select(key, "offset", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero(F.col("mean"), "mean"), zero(F.col("std"), "std"), zero(sem, "sem"))


def spike_triggered_average(samples: DataFrame, trains: DataFrame, rate: float, window, t_start: float = 0.0, key: str = "recording_id") -> DataFrame:
    """:func:`event_triggered_average` over the events of a unit train (key, event_id, t)."""
    return event_triggered_average(samples, trains, rate, window, t_start, True, key)
