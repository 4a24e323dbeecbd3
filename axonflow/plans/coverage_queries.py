"""Queries of peri-event slices, spike-triggered averages, filter responses, joint masks, unit products and raw files."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonflow.operators import correlogram, perievent, sequence, spectral
from axonflow.plans import views
from axonflow.plans.views import FILLED, HOUR, HOURLY, TRAINS
from axonflow.sources import raw, sheets
from axonflow.sources.scratch import scratch_path

R = "recording_id"


def _hours(spark, d):
    """All events, with their time in hours."""
    return views.trains(spark, d).select(R, "event_id", (F.col("t") / F.lit(float(HOUR))).alias("t"))


def a3(spark, d):
    out = perievent.spike_triggered_average(views.filled(spark, d), _hours(spark, d), 1.0, (2, 3))
    return out.select(R, "offset", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "sem")))


def j10(spark, d):
    return perievent.peri_event(views.filled(spark, d), _hours(spark, d), 1.0, 1).select(R, "event_id", "offset", F.round("value", 6).alias("value"))


def m4(spark, d):
    masks = views.hourly(spark, d).select(R, "idx", F.col("value").isNotNull().alias("is_valid"))
    return sequence.valid_everywhere(masks)


def p2(spark, d):
    """Responses of low-pass filters whose cut-offs follow from the number of events of each recording and unit."""
    counts = views.trains(spark, d).groupBy(R, "unit_id").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.select(R, "unit_id", ((F.col("n") % 89 + 5) / F.lit(200.0)).alias("cut"))
    out = spectral.filter_responses(cuts, [R, "unit_id"], "low", 1.0, 2, 64)
    return out.select(R, "unit_id", F.round("freq", 9).alias("freq"), F.round("gain", 6).alias("gain"))


def s6(spark, d):
    """Times of all events, written as files of ticks by ranges of time and read back."""
    path = scratch_path(spark, "clocks")
    raw.write_raw(views.trains(spark, d).where("t IS NOT NULL"), F.array("t"), "uint64", path, ["t", "event_id"])
    return raw.read_clock(spark, path, 1e6).select("t")


#: Channels picked from the recording, by name and by number.
PICKED = ["RHS2116_AC_3", 0, 31]


def _recording(spark, d):
    """Folders of a raw recording of 32 channels and of its clock: a record for each event, in order of time."""
    signal, clock = scratch_path(spark, "ephys"), scratch_path(spark, "ephys-clock")
    rows = views.trains(spark, d).select("event_id", "t", "unit_id").where("t IS NOT NULL")
    level = lambda c: (F.col("event_id") * 31 + F.col("unit_id") * 7 + c * 257) % (256 if c == 31 else 65536)
    raw.write_raw(rows, F.array(*(level(c) for c in range(raw.DEVICE_CHANNELS))), "uint16", signal, ["t", "event_id"])
    raw.write_raw(rows, F.array("t"), "uint64", clock, ["t", "event_id"])
    return signal, clock


def s7(spark, d):
    out = raw.read_ephys(spark, *_recording(spark, d), 1e6, PICKED)
    return out.select("channel", "idx", F.round("t", 6).alias("t"), F.round("value", 4).alias("value"))


def s7_rate(spark, d):
    return raw.sampling_rate(raw.read_clock(spark, _recording(spark, d)[1], 1e6)).select(F.round("fs", 6).alias("fs"))


def s9_gas(spark, d):
    """O2 and CO2 in volts from 2 to 8, whose 32-bit form ends with one byte, on the clock of the events."""
    rows = views.trains(spark, d).where("t IS NOT NULL")
    paths = {name: scratch_path(spark, f"gas-{name}") for name in ("O2", "CO2", "clock")}
    volts = {"O2": 2 + F.col("event_id") % 600 / 100, "CO2": 2 + F.col("event_id") * 7 % 500 / 100}
    for name, v in volts.items():
        raw.write_raw(rows, F.array(v), "float32", paths[name], ["t", "event_id"], last_byte=0x40)
    raw.write_raw(rows, F.array("t"), "uint64", paths["clock"], ["t", "event_id"])
    out = raw.read_gas(spark, {n: paths[n] for n in volts}, paths["clock"], 1e6)
    return out.select("channel", "idx", F.round("t", 6).alias("t"), F.round("value", 5).alias("value"))


def s11(spark, d):
    """A file of ticks for each day, named by its number; the files found by name, with their records."""
    path = scratch_path(spark, "movies")
    rows = views.trains(spark, d).where("t IS NOT NULL").withColumn("day", F.floor(F.col("t") / views.DAY))
    raw.write_raw(rows, F.array("t"), "uint64", path, ["t", "event_id"], by=["day"])
    days = sheets.name_movies(spark, path, "day")
    found = sheets.numbered_movies(spark, path, days).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    records = raw.read_raw(spark, f"{path}/*/*.avi", "uint64").groupBy(F.regexp_replace("path", "^file:/+", "/").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("values")[0]).alias("first"))
    return found.join(records, "path").select("name", "n", "first")


def j8_product(spark, d):
    trains = views.trains(spark, d)
    return correlogram.unit_products(trains.where("unit_id < 4"), trains.where("unit_id >= 4"))


EVENTS = f"e AS (SELECT recording_id, event_id, CAST(round_even(t / {float(HOUR)}, 0) AS BIGINT) AS at FROM trains), n AS (SELECT recording_id, max(idx) + 1 AS n FROM filled GROUP BY ALL)"


def _slices(before: int, after: int) -> str:
    return f"""WITH {FILLED}, {EVENTS}, o AS (SELECT unnest(range({-before}, {after + 1})) AS o),
s AS (SELECT e.recording_id, e.event_id, CAST(o.o AS INTEGER) AS o, f.value FROM e JOIN n ON n.recording_id = e.recording_id AND e.at - {before} >= 0 AND e.at + {after} < n.n
      CROSS JOIN o JOIN filled f ON f.recording_id = e.recording_id AND f.idx = e.at + o.o)"""


QUERIES = {
    "a3_spike_triggered_average": (
        a3, _slices(2, 3) + """ SELECT recording_id, o AS "offset", count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM s GROUP BY recording_id, o""",
    ),
    "j10_peri_event_slices": (j10, _slices(1, 1) + ' SELECT recording_id, event_id, o AS "offset", round(value, 6) AS value FROM s'),
    "m4_valid_everywhere": (m4, f"WITH {HOURLY} SELECT idx, bool_and(value IS NOT NULL) AS is_valid FROM hourly GROUP BY idx"),
    "p2_filter_response": (
        p2, f"""WITH {TRAINS}, c AS (SELECT recording_id, unit_id, (count(*) % 89 + 5) / 200.0 AS cut FROM trains GROUP BY ALL),
f AS (SELECT c.*, k.k / 128.0 AS freq FROM c CROSS JOIN (SELECT unnest(range(0, 64)) AS k) k)
SELECT recording_id, unit_id, round(freq, 9) AS freq, round(1 / sqrt(1 + pow(tan(pi() * freq) / tan(pi() * cut), 4)), 6) AS gain FROM f""",
    ),
    "s6_read_clock": (s6, f"WITH {TRAINS} SELECT t / 1000000.0 AS t FROM trains"),
    "s7_read_ephys": (
        s7, f"""WITH {TRAINS}, r AS (SELECT event_id, unit_id, t, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM trains)
SELECT 'RHS2116_AC_' || c AS channel, idx, round(t / 1000000.0, 6) AS t, round(((event_id * 31 + unit_id * 7 + c * 257) % CASE WHEN c = 31 THEN 256 ELSE 65536 END - 32768) * 0.195::DOUBLE, 4) AS value
FROM r, (VALUES (3), (0), (31)) k(c)""",
    ),
    "s7_sampling_rate": (
        s7_rate, f"""WITH {TRAINS}, r AS (SELECT t, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM trains),
g AS (SELECT lead(t) OVER (ORDER BY idx) / 1000000.0 - t / 1000000.0 AS gap FROM r WHERE idx < 10000) SELECT round(1 / median(gap), 6) AS fs FROM g""",
    ),
    "s9_read_gas": (
        s9_gas, f"""WITH {TRAINS}, r AS (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) - 1 AS idx FROM trains)
SELECT channel, idx, round(t / 1000000.0, 6) AS t, round(CASE channel WHEN 'O2' THEN 10 * CAST(CAST(2 + event_id % 600 / 100 AS FLOAT) AS DOUBLE) ELSE CAST(CAST(2 + event_id * 7 % 500 / 100 AS FLOAT) AS DOUBLE) END, 5) AS value
FROM r, (VALUES ('O2'), ('CO2')) k(channel)""",
    ),
    "s11_numbered_movies": (s11, f"WITH {TRAINS} SELECT (t // {views.DAY}) || '.avi' AS name, count(*) AS n, min(t) AS first FROM trains GROUP BY 1"),
    "j8_unit_products": (
        j8_product, f"""WITH {TRAINS}, u AS (SELECT DISTINCT recording_id, unit_id FROM trains)
SELECT a.recording_id, a.unit_id AS ref, b.unit_id AS target FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.unit_id < 4 AND b.unit_id >= 4""",
    ),
}
