"""Views of the given tables in the library's schemas, and the same views as common table expressions in SQL.

Times are whole microseconds since 2024-01-01 (trains), hours (hourly) or days since 1992-01-01 (daily), so that both
engines compare and bin them exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonflow.operators.chunked import Sparse

HOUR, DAY = 3_600_000_000, 86_400_000_000
HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str, origin: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{origin} 00:00:00', cast({c} as timestamp_ntz))")


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, recording_id (event type), unit_id (user modulo 8), t, value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("recording_id"), (F.col("user_id") % 8).alias("unit_id"), _micros("ts", "2024-01-01").alias("t"), "value")


def _known(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """recording_id, idx, value of the hours that have events."""
    rows = table(spark, sf_dir, "events").select(F.col(by).cast("string").alias("recording_id"), _micros("ts", "2024-01-01").alias("t"), "value")
    return rows.groupBy("recording_id", F.floor(F.col("t") / HOUR).alias("idx")).agg((F.sum(F.round(F.col("value") * 1000).cast("long")) / F.count(F.lit(1)) / 1000).alias("value"))


def _sparse(known: DataFrame, low: Column, high: Column, values: list[str]) -> Sparse:
    """All hours from ``low`` to ``high`` (of windows over a recording), null where not known; recordings without ``low`` have none.

    A known hour brings the empty ones up to the next, so only known hours are shuffled. The hours stay dealt by recording
    into as many parts as the session shuffles into, and what is grouped or joined by recording and hour moves none of
    them; no side of a join is estimated by the rows before they are laid out, and broadcast.
    """
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("recording_id").orderBy("idx")
    rows = known.repartition(parts, "recording_id").select(
        "recording_id", "idx", *values, low.alias("_low"), high.alias("_high"), (F.row_number().over(order) == 1).alias("_first"), F.lead("idx").over(order).alias("_next")
    )
    start = F.when(F.col("_first"), F.col("_low")).otherwise(F.greatest("idx", "_low"))
    end = F.least(F.coalesce(F.col("_next") - 1, F.col("_high")), "_high")
    rows = rows.withColumns({"_start": start, "_end": end}).where("_low IS NOT NULL AND _start <= _end")
    own = F.col("recording_id").isNotNull() & F.col("idx").between(F.col("_start"), F.col("_end"))
    return Sparse(rows.select("recording_id", "_start", "_end", *(F.when(own, F.col(c)).alias(c) for c in ("idx", *values))), tuple(values))


def sparse(spark: SparkSession, sf_dir: str, by: str) -> Sparse:
    """:func:`hourly` with a row for each hour that has events."""
    whole = Window.partitionBy("recording_id")
    low, high = F.least(F.min("idx").over(whole), F.lit(0)), F.greatest(F.max("idx").over(whole), F.lit(HOURS - 1))
    return _sparse(_known(spark, sf_dir, by), low, high, ["value"])


def hourly(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """recording_id (type of event or, with ``by="user_id"``, the user), idx (hour), value (mean, null without events).

    The hours are those of the 30 days from 2024-01-01 and, where a recording has events before or after them, all up
    to its first or last one.
    """
    return sparse(spark, sf_dir, by).samples(["recording_id"])


def filled(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    return hourly(spark, sf_dir, by).withColumn("value", F.coalesce("value", F.lit(0.0)))


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`hourly` with a recording for each user, so that the number of recordings grows with the events."""
    return hourly(spark, sf_dir, "user_id")


def user_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir, "user_id")


def user_sparse(spark: SparkSession, sf_dir: str) -> Sparse:
    """:func:`user_hourly`, sparse."""
    return sparse(spark, sf_dir, "user_id")


def sparse_neighbours(spark: SparkSession, sf_dir: str) -> Sparse:
    """recording_id, idx, x, y: each user's signal (:func:`user_hourly`) beside that of the user with the next id, over the
    hours that both have. The signals meet before their empty hours are laid out."""
    known = _known(spark, sf_dir, "user_id").where("recording_id IS NOT NULL")
    x = known.select("recording_id", "idx", F.lit(True).alias("_x"), F.col("value").alias("x"), F.lit(None).cast("double").alias("y"))
    y = known.select((F.col("recording_id").cast("long") - 1).cast("string").alias("recording_id"), "idx", F.lit(False).alias("_x"), F.lit(None).cast("double").alias("x"), F.col("value").alias("y"))
    both = x.unionByName(y).groupBy("recording_id", "idx").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.bool_or("_x").alias("_x"), F.bool_or(~F.col("_x")).alias("_y"))
    whole = Window.partitionBy("recording_id")
    ends = lambda c: (F.least(F.min(F.when(F.col(c), F.col("idx"))).over(whole), F.lit(0)), F.greatest(F.max(F.when(F.col(c), F.col("idx"))).over(whole), F.lit(HOURS - 1)))
    (x0, x1), (y0, y1) = ends("_x"), ends("_y")
    met = F.bool_or("_x").over(whole) & F.bool_or("_y").over(whole)
    return _sparse(both, F.when(met, F.greatest(x0, y0)), F.least(x1, y1), ["x", "y"])


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`sparse_neighbours` with a row for each hour."""
    return sparse_neighbours(spark, sf_dir).samples(["recording_id"])


def user_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`neighbours` with 0 where there is no event."""
    return neighbours(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("x", "y")})


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id (user), event_id, frame_idx, t: the events of each user as pulses, in order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), "event_id", _micros("ts", "2024-01-01").alias("t"))
    return rows.select("recording_id", "event_id", "t", (F.row_number().over(Window.partitionBy("recording_id").orderBy("t", "event_id")) - 1).cast("long").alias("frame_idx"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trains with the phase of the day in (-pi, pi)."""
    return trains(spark, sf_dir).withColumn("phase", (F.col("t") % DAY) * F.lit(2 * math.pi / DAY) - F.lit(math.pi))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject (order priority and hundred of customers, so that subjects grow with the orders), idx (day), x (orders), y (mean
    price in hundreds)."""
    orders = table(spark, sf_dir, "orders")
    day = F.floor(_micros("o_orderdate", "1992-01-01") / DAY)
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return orders.groupBy(F.concat("o_orderpriority", F.lit(" "), F.floor(F.col("o_custkey") / 100).cast("string")).alias("subject"), day.alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("x"), (cents / F.count(F.lit(1)) / 10000).alias("y"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id (label), frame_idx, 8 by 8 pixels."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("recording_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("pixels"))


def windows(spark: SparkSession) -> DataFrame:
    """Control in hours 0 to 240, treatment in hours 360 to 600, for each type of event; minutes at one sample a minute
    are hours at one sample an hour of rate 1/60."""
    return spark.range(1).select(F.explode(F.array(F.struct(F.lit("control").alias("period"), F.lit(0.0).alias("start_min"), F.lit(240.0).alias("end_min")), F.struct(F.lit("treatment").alias("period"), F.lit(360.0).alias("start_min"), F.lit(600.0).alias("end_min")))).alias("w")).select("w.*")


TRAINS = "trains AS (SELECT event_id, event_type AS recording_id, user_id % 8 AS unit_id, epoch_us(ts) - 1704067200000000 AS t, value FROM events)"


def _hourly_sql(by: str) -> str:
    return f"""{TRAINS}, hours AS (SELECT CAST({by} AS VARCHAR) AS recording_id, (epoch_us(ts) - 1704067200000000) // {HOUR} AS idx, sum(CAST(round(value * 1000) AS BIGINT)) / count(*) / 1000 AS value FROM events GROUP BY ALL),
grid AS (SELECT recording_id, unnest(range(least(min(idx), 0), greatest(max(idx), {HOURS - 1}) + 1)) AS idx FROM hours GROUP BY recording_id),
hourly AS (SELECT grid.recording_id, grid.idx, hours.value FROM grid LEFT JOIN hours ON grid.recording_id = hours.recording_id AND grid.idx = hours.idx)"""


_FILL = "filled AS (SELECT recording_id, idx, coalesce(value, 0.0) AS value FROM hourly)"
HOURLY, USER_HOURLY = _hourly_sql("event_type"), _hourly_sql("user_id")
FILLED, USER_FILLED = f"{HOURLY}, {_FILL}", f"{USER_HOURLY}, {_FILL}"
CLOCK = f"{TRAINS}, clock AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id, epoch_us(ts) - 1704067200000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events)"
PHASES = f"{TRAINS}, phases AS (SELECT *, (t % {DAY}) * {2 * math.pi / DAY!r} - {math.pi!r} AS phase FROM trains)"
DAILY = f"""daily AS (SELECT o_orderpriority || ' ' || (o_custkey // 100) AS subject, CAST((epoch_us(o_orderdate) - 694224000000000) // {DAY} AS BIGINT) AS idx, CAST(count(*) AS DOUBLE) AS x,
sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 10000 AS y FROM orders GROUP BY ALL)"""
FRAMES = "frames AS (SELECT CAST(label AS VARCHAR) AS recording_id, vec_id AS frame_idx, embedding AS pixels FROM embeddings)"
PIXELS = f"{FRAMES}, pixels AS (SELECT recording_id, frame_idx, CAST(i - 1 AS INTEGER) AS pixel, CAST(pixels[i] AS DOUBLE) AS value FROM frames, (SELECT unnest(range(1, 65)) AS i))"
