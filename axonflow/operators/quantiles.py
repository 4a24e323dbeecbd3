"""Exact quantiles of groups of any length.

A value's 64 bits, turned so that whole numbers sort as the values do, are looked at 16 at a time. Each round counts, per group
and prefix that still holds a wanted rank, the next 16 bits (at most 65,536 counts, combined before they are shuffled) and keeps
the one prefix in which the rank lies. Once such prefixes hold few rows, these are sorted; at the latest the fourth
round knows the value itself. No task ever holds a group, and only counts and the last few rows are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonflow.sources.scratch import written

#: Groups and prefixes with so many rows at most are sorted in one task.
REST = 1 << 16
_DIGIT = 16


def _turned(bits: np.ndarray) -> np.ndarray:
    """Swaps the order of negative doubles' bits; its own inverse."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def ordered_bits(x: Column) -> Column:
    """A whole number for each double, in the order of the doubles (NaN last, both zeros equal)."""
    turn = F.arrow_udf(lambda v: pa.array(_turned((v.to_numpy(zero_copy_only=False).astype(float) + 0.0).view(np.int64))), "long")
    return turn(x)


def _doubles(k: Column) -> Column:
    return F.arrow_udf(lambda v: pa.array(_turned(v.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.float64)), "double")(k)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], rest: int = REST) -> DataFrame:
    """keys, and for each name in ``probs`` the quantile of the non-null values, linear between ranks; null without values."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    coded = rows.select(group.alias("_g"), F.col(value).cast("double").alias("_x"))
    sizes = written(coded.groupBy("_g").agg(F.count("_x").alias("_n")), "quantile-sizes")
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    columns = [F.col(f"_g.{k}").alias(k) for k in keys]
    if largest <= rest:
        return coded.groupBy("_g").agg(*(F.percentile("_x", p).alias(name) for name, p in probs.items())).select(*columns, *probs)
    bits = coded.where("_x IS NOT NULL").select("_g", ordered_bits(F.col("_x")).alias("_k"))

    # wanted ranks: two a quantile, which may be the same
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("share")) for name, p in probs.items() for side, f in ((0, F.floor), (1, F.ceil))))
    wanted = sizes.where("_n > 0").select("_g", F.lit(0).cast("long").alias("_prefix"), F.explode(ranks).alias("_r")).select("_g", "_prefix", "_r.*")
    shift = 64
    while shift > 0:
        shift -= _DIGIT
        inside = bits.withColumn("_prefix", F.shiftright("_k", shift + _DIGIT) if shift + _DIGIT < 64 else F.lit(0).cast("long"))
        if shift + _DIGIT < 64:
            inside = inside.join(wanted.select("_g", "_prefix").distinct(), ["_g", "_prefix"])
        counts = inside.groupBy("_g", "_prefix", F.shiftright("_k", shift).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_g", "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)))
        met = wanted.join(counts, ["_g", "_prefix"]).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
        wanted = met.select("_g", F.col("_next").alias("_prefix"), "name", "side", (F.col("rank") - (F.col("_upto") - F.col("_n"))).alias("rank"), "share", "_n")
        wanted = written(wanted, "quantile-ranks")
        if wanted.agg(F.max("_n")).first()[0] <= rest:
            break
        wanted = wanted.drop("_n")
    if shift > 0:
        last = bits.withColumn("_prefix", F.shiftright("_k", shift)).join(wanted.select("_g", "_prefix").distinct(), ["_g", "_prefix"])
        last = last.withColumn("rank", (F.row_number().over(Window.partitionBy("_g", "_prefix").orderBy("_k")) - 1).cast("long"))
        found = wanted.join(last, ["_g", "_prefix", "rank"])
    else:
        found = wanted.withColumn("_k", F.col("_prefix"))
    found = found.select("_g", "name", "side", "share", _doubles(F.col("_k")).alias("_v"))
    side = lambda name, s: F.max(F.when((F.col("name") == name) & (F.col("side") == s), F.col("_v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    # equal ends give themselves, infinite ones too
    between = lambda name: F.when(side(name, 0) == side(name, 1), side(name, 0)).otherwise(side(name, 0) * (1 - share(name)) + side(name, 1) * share(name))
    out = sizes.select("_g").join(found.groupBy("_g").agg(*(between(name).alias(name) for name in probs)), "_g", "left")
    return out.select(*columns, *probs)
