"""Phase histograms of unit events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def phase_histogram(phases: DataFrame, keys: list[str], bins: int = 18, phase: str = "phase") -> DataFrame:
    """Counts and density of phases over (-pi, pi): keys, bin, n, density. The last bin is closed on both sides.

    Every group has a row for each bin. Phases that are not finite are an error for the callers: see :func:`bad_phases`.
    """
    width = TWO_PI / bins
    inside = phases.where(F.col(phase).between(-math.pi, math.pi))
    place = F.least(F.floor((F.col(phase) + math.pi) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(*keys, "bin", "n", (F.col("n") / (F.col("_total") * F.lit(width))).alias("density"))


def bad_phases(phases: DataFrame, keys: list[str], phase: str = "phase") -> DataFrame:
    """Smallest and largest phase of each group, and how many are missing or infinite."""
    p = F.col(phase)
    missing, infinite = p.isNull() | F.isnan(p), F.abs(p) == float("inf")
    fine = F.when(~missing & ~infinite, p)
    return phases.groupBy(*keys).agg(F.min(fine).alias("low"), F.max(fine).alias("high"), F.count_if(missing).alias("missing"), F.count_if(F.coalesce(infinite, F.lit(False)) & ~missing).alias("infinite"))


def mean_density(phases: DataFrame, key: str = "recording_id", unit: str = "unit_id", bins: int = 18) -> DataFrame:
    """Mean of the units' densities with equal weights: key, bin, mean_density, sem (population deviation / sqrt(n))."""
    each = phase_histogram(phases, [key, unit], bins)
    n = F.count(F.lit(1))
    return each.groupBy(key, "bin").agg(F.avg("density").alias("mean_density"), (F.stddev_pop("density") / F.sqrt(n)).alias("sem"))


def mean_vector(phases: DataFrame, key: str = "recording_id", unit: str = "unit_id", phase: str = "phase") -> DataFrame:
    """Mean of the units' mean phase vectors: key, theta, radius."""
    each = phases.groupBy(key, unit).agg(F.avg(F.cos(phase)).alias("_c"), F.avg(F.sin(phase)).alias("_s"))
    out = each.groupBy(key).agg(F.avg("_c").alias("_c"), F.avg("_s").alias("_s"))
    return out.select(key, F.atan2("_s", "_c").alias("theta"), F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2).alias("radius"))
