"""Column functions: power in dB, rotation angles, labels, confidence intervals, unit conversions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_to_db(power: Column) -> Column:
    """10 log10(power) of positive finite power, else null."""
    return F.when((power > 0) & (power < float("inf")) & ~F.isnan(power), 10 * F.log10(power))


def euler_angles(w: Column, x: Column, y: Column, z: Column, degrees: bool = False) -> dict[str, Column]:
    """Roll, pitch and yaw of a unit quaternion."""
    sine = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    out = {
        "roll": F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)),
        "pitch": 2 * F.atan2(F.sqrt(1 + sine), F.sqrt(1 - sine)) - math.pi / 2,
        "yaw": F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
    }
    return {k: F.degrees(c) if degrees else c for k, c in out.items()}


def p_text(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "N/A").when(p < 0.001, "p < 0.001").otherwise(F.format_string("p = %.3f", p))


def p_stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "N/A").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def short_drug_label(name: Column) -> Column:
    """'Dex <dose>', 'Sleep', or the name with a capital."""
    low = F.lower(name)
    dose = F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)", 1)
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))))
    return F.when(low.contains("dex"), F.rtrim(F.concat(F.lit("Dex "), dose))).when(low.contains("sleep"), "Sleep").otherwise(capital)


def fisher_interval(r: Column, n_eff: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Confidence interval of a correlation; null when n_eff <= 3 or \\|r\\| >= 1."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    fine = (n_eff > 3) & (F.abs(r) < 1)
    side = lambda s: F.when(fine, F.tanh(F.atanh(r) + s * z / F.sqrt(n_eff - 3)))
    return side(-1), side(1)


def file_name_part(name: Column) -> Column:
    """A name fit for paths: colon, slash, backslash, dot and space become underscores."""
    return F.regexp_replace(name, r"[: /\\.]", "_")


def ticks_to_seconds(ticks: Column, clock_hz: float) -> Column:
    return ticks / F.lit(float(clock_hz))


def seconds_to_index(t: Column, rate: float, t_start: float = 0.0) -> Column:
    return F.rint((t - F.lit(t_start)) * F.lit(rate)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many decimals, halves away from zero and never -0, by arithmetic on doubles; by Spark's decimals only where the
    product has no room for a half."""
    scale = 10.0**digits
    whole = F.floor(F.abs(x) * scale + 0.5).cast("double") / scale
    near = F.when(x < 0, F.lit(0.0) - whole).otherwise(whole) + F.lit(0.0)
    return F.when(F.abs(x) * scale < 2.0**52, near).otherwise(F.round(x, digits))
