"""Queries of event trains: selections, correlograms, intervals, peri-event averages, phases, surrogates."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonflow.operators import align, correlogram, perievent, phase, select, surrogate
from axonflow.plans import views
from axonflow.plans.views import DAY, FILLED, HOUR, PHASES, TRAINS

#: Half an hour a bin, twelve hours to either side: 49 bins.
BIN, WINDOW = HOUR // 2, 12 * HOUR
HALF, BINS = 49 * BIN // 2, 49
#: Surrogates of each train, as the permutation test takes them by default; fixtures give a smaller number.
DRAWS = 1000


def f1(spark, d):
    return select.restrict_window(views.trains(spark, d), 5 * DAY, 10 * DAY).select("event_id", "recording_id", "t")


def f4(spark, d):
    return select.keep_labels(views.trains(spark, d), ["click", "view"], "recording_id").select("event_id", "recording_id")


def f5(spark, d):
    return select.drop_label_prefix(views.trains(spark, d), "c", "recording_id").select("event_id", "recording_id")


def f6(spark, d):
    clock = views.clock(spark, d)
    bad = clock.where("frame_idx % 7 = 3").select("recording_id", F.col("frame_idx").cast("int").alias("position"))
    return select.delete_positions(clock.select("recording_id", "t"), bad)


def f7(spark, d):
    rows = views.trains(spark, d).select(F.col("unit_id").alias("recording_id"), F.col("recording_id").alias("label"), (F.col("t") / 1_000_000).alias("t"))
    return select.interval_after_event(rows, "pur", 30.0)


def f8(spark, d):
    return select.select_units(views.trains(spark, d), [1, 5]).select("event_id", "unit_id")


def f12(spark, d):
    trains = views.trains(spark, d)
    decisions = trains.groupBy("unit_id").agg((F.count(F.lit(1)) % 2 == 0).alias("accepted"))
    return select.curated_units(trains, decisions).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"))


def j8(spark, d):
    return correlogram.unit_pairs(views.trains(spark, d))


def j9(spark, d):
    rows = views.trains(spark, d).select("recording_id", "event_id", "t")
    near = correlogram.pairs_within(rows.withColumnRenamed("event_id", "ref"), rows.withColumnRenamed("event_id", "target"), -HOUR // 2, HOUR // 2, ["recording_id"])
    return near.where("ref != target").select("recording_id", "ref", "target", "delta")


def a6(spark, d):
    return correlogram.auto_correlograms(views.trains(spark, d), BIN, WINDOW).withColumn("value", F.round("value", 6))


def a7(spark, d):
    return correlogram.cross_correlograms(views.trains(spark, d), BIN, WINDOW).withColumn("value", F.round("value", 6))


def a8(spark, d):
    trains = views.trains(spark, d)
    events = trains.where("unit_id = 0").select("recording_id", "t")
    return correlogram.event_correlograms(trains.where("unit_id > 0"), events, BIN, WINDOW).withColumn("value", F.round("value", 6))


def a5(spark, d):
    trains = views.trains(spark, d).select("recording_id", "unit_id", "t")
    counts = correlogram.correlogram(trains.withColumnRenamed("unit_id", "ref"), trains.withColumnRenamed("unit_id", "target"), BIN, WINDOW, ["recording_id"])
    return counts


def a9(spark, d):
    out = correlogram.event_rates(views.trains(spark, d), ["recording_id", "unit_id"])
    return out.withColumn("rate", F.round(F.col("rate") * 1e9, 6))


def a10(spark, d):
    return correlogram.interval_histogram(views.trains(spark, d), ["recording_id", "unit_id"], 20).withColumn("centre", F.round("centre", 3))


def a10_log(spark, d):
    out = correlogram.interval_histogram(views.trains(spark, d), ["recording_id", "unit_id"], [10.0, 15.0, 18.0, 20.0, 22.0, 24.0, 26.0, 30.0], log_scale=True)
    return out


def _hour_events(spark, d):
    """All events, in seconds, and the hourly signal of their recording."""
    events = views.trains(spark, d).select("recording_id", "event_id", (F.col("t") / 1_000_000).alias("t"))
    return views.filled(spark, d), events


def a1(spark, d):
    samples, events = _hour_events(spark, d)
    out = perievent.peri_event(samples, events, 1 / 3600, (2 * 3600, 3 * 3600))
    return out.select("recording_id", "event_id", "offset", F.round("value", 6).alias("value"))


def a1_padded(spark, d):
    samples, events = _hour_events(spark, d)
    out = perievent.peri_event(samples, events, 1 / 3600, (2 * 3600, 3 * 3600), drop_boundary=False)
    return out.select("recording_id", "event_id", "offset", F.round("value", 6).alias("value"))


def a2(spark, d):
    samples, events = _hour_events(spark, d)
    out = perievent.event_triggered_average(samples, events, 1 / 3600, 6 * 3600)
    return out.select("recording_id", "offset", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "sem")))


def a4(spark, d):
    samples, events = _hour_events(spark, d)
    out = perievent.event_triggered_average(samples, events, 1 / 3600, 48 * 3600, denominator="all_events")
    return out.select("recording_id", "offset", F.round("mean", 4).alias("mean"))


def a11(spark, d):
    return phase.phase_histogram(views.phases(spark, d), ["recording_id", "unit_id"]).withColumn("density", F.round("density", 8))


def a11_checks(spark, d):
    out = phase.bad_phases(views.phases(spark, d), ["recording_id"])
    return out.select("recording_id", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "missing", "infinite")


def a12(spark, d):
    return phase.mean_density(views.phases(spark, d)).select("recording_id", "bin", F.round("mean_density", 8).alias("mean_density"), F.round("sem", 8).alias("sem"))


def a12_vector(spark, d):
    return phase.mean_vector(views.phases(spark, d)).select("recording_id", F.round("theta", 6).alias("theta"), F.round("radius", 8).alias("radius"))


#: Span of the surrogates' support, and their largest jitter, in microseconds.
SUPPORT, JITTER = 30.0 * DAY, HOUR / 6
#: Two steps within an hour are close.
CLOSE, STEPS, SEED = HOUR, 2, 3
KINDS = {
    "jitter": surrogate.Jitter(JITTER),
    "shift": surrogate.Shift(0.0, SUPPORT, mode="wrap"),
    "shuffle": surrogate.ShuffleIntervals(),
    "poisson": surrogate.Poisson(0.0, SUPPORT),
}


def _checksum(times):
    """Of a draw's sorted times in whole microseconds: their number, sum, ends, weighted sum by rank, and close intervals."""
    import numpy as np

    t = np.floor(times).astype(np.int64)
    ranked = int((np.arange(1, len(t) + 1) % 1000 * (t // 1_000_000)).sum())
    return len(t), int(t.sum()), int(t[0]), int(t[-1]), ranked, int((np.diff(t) < HOUR // 2).sum())


def _draws(kind):
    """A row for each draw of each train, from the draw's own times."""

    def query(spark, d, draws=DRAWS):
        fields = "n long, total long, first long, last long, ranked long, close long"
        return surrogate.surrogate_statistics(views.trains(spark, d), KINDS[kind], _checksum, fields, draws, SEED)

    return query


def _test(kind):
    """Permutation test of each train: are more events close to the next but one than in its surrogates?"""

    def query(spark, d, draws=DRAWS):
        return surrogate.surrogate_test(views.trains(spark, d), KINDS[kind], surrogate.share_close(CLOSE, STEPS), draws, SEED, "greater").where("p_value IS NOT NULL")

    return query


def u1(spark, d):
    import pandas as pd

    def fano(g):
        counts = (g["t"] // DAY).value_counts()
        return pd.DataFrame([(g["recording_id"].iloc[0], int(g["unit_id"].iloc[0]), len(g), int(counts.max()))], columns=["recording_id", "unit_id", "n", "busiest"])

    return surrogate.apply_to_units(views.trains(spark, d).select("recording_id", "unit_id", "t"), fano, "recording_id string, unit_id long, n long, busiest long")


def j3(spark, d):
    events = views.trains(spark, d).select("recording_id", "event_id", F.floor(F.col("t") / HOUR).alias("idx"))
    signal = views.filled(spark, d).select("recording_id", "idx", "value")
    return align.phase_at_events(events, signal).select("recording_id", "event_id", "idx", F.round("value", 6).alias("value"))


_MASK = "CAST(18446744073709551615 AS UHUGEINT)"
_U = "(u / 9007199254740992.0)"
#: Time of an event in a draw, by its own time, the draw's number of it (u) or of the train (u1), as the kinds of surrogates compute it.
_MOVED = {
    "jitter": f"t + (2 * {_U} - 1) * {JITTER!r}",
    "shift": f"(t + (0.0 + (u1 / 9007199254740992.0) * {SUPPORT!r})) % {SUPPORT!r}",
    "shuffle": "t0 + coalesce(sum(gap) OVER (PARTITION BY recording_id, unit_id, replicate ORDER BY i = 1 DESC, u, i ROWS UNBOUNDED PRECEDING), 0)",
    "poisson": f"0.0 + {_U} * {SUPPORT!r}",
}


def _moved_sql(kind: str) -> str:
    """Draws replayed: SplitMix64 from the same keys. A shuffle draws for the intervals, so an interval has the number of the event before."""
    at = "greatest(i - 1, 1)" if kind == "shuffle" else "i"
    z = lambda a, b, by: f"CAST(({a} * CAST({by} AS UHUGEINT)) & {_MASK} AS UHUGEINT) AS {b}"
    return f"""WITH {TRAINS},
ev AS (SELECT recording_id, unit_id, t, row_number() OVER w AS i, t - lag(t) OVER w AS gap, min(t) OVER (PARTITION BY recording_id, unit_id) AS t0 FROM trains WHERE t IS NOT NULL WINDOW w AS (PARTITION BY recording_id, unit_id ORDER BY t)),
draws AS (SELECT recording_id, unit_id, CAST(r AS INTEGER) AS replicate, CAST(CAST('0x' || substr(sha256('{SEED}:' || recording_id || ':' || unit_id || ':' || r), 1, 16) AS UBIGINT) AS UHUGEINT) AS k
  FROM (SELECT DISTINCT recording_id, unit_id FROM ev), (SELECT unnest(range(0, {DRAWS})) AS r)),
z0 AS (SELECT ev.*, replicate, (k + CAST({at} AS UHUGEINT) * CAST(11400714819323198485 AS UHUGEINT)) & {_MASK} AS z FROM ev JOIN draws USING (recording_id, unit_id)),
z1 AS (SELECT * EXCLUDE (z), {z("xor(z, z >> CAST(30 AS UHUGEINT))", "z", 13787848793156543929)} FROM z0),
z2 AS (SELECT * EXCLUDE (z), {z("xor(z, z >> CAST(27 AS UHUGEINT))", "z", 10723151780598845931)} FROM z1),
z3 AS (SELECT * EXCLUDE (z), CAST(xor(z, z >> CAST(31 AS UHUGEINT)) >> CAST(11 AS UHUGEINT) AS BIGINT) AS u FROM z2),
first AS (SELECT recording_id AS r1, unit_id AS n1, replicate AS d1, u AS u1 FROM z3 WHERE i = 1),
moved AS (SELECT recording_id, unit_id, replicate, CAST({_MOVED[kind]} AS {"BIGINT" if kind == "shuffle" else "DOUBLE"}) AS x
  FROM z3{" JOIN first ON r1 = recording_id AND n1 = unit_id AND d1 = replicate" if kind == "shift" else ""})"""


def _draws_sql(kind: str) -> str:
    train = "PARTITION BY recording_id, unit_id, replicate ORDER BY x"
    return f"""{_moved_sql(kind)},
placed AS (SELECT recording_id, unit_id, replicate, CAST(floor(x) AS BIGINT) AS x FROM moved),
ranked AS (SELECT *, row_number() OVER w AS place, x - lag(x) OVER w AS gap FROM placed WINDOW w AS ({train}))
SELECT recording_id, unit_id, replicate, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, min(x) AS first, max(x) AS last, CAST(sum(place % 1000 * CAST(floor(x / 1000000.0) AS BIGINT)) AS BIGINT) AS ranked, count(*) FILTER (WHERE gap < {HOUR // 2}) AS close
FROM ranked GROUP BY ALL"""


def _test_sql(kind: str) -> str:
    return f"""{_moved_sql(kind)},
own AS (SELECT recording_id, unit_id, count(*) AS k, count(*) FILTER (WHERE gap < {CLOSE}) AS c FROM (SELECT recording_id, unit_id, t - lag(t, {STEPS}) OVER (PARTITION BY recording_id, unit_id ORDER BY t) AS gap FROM ev) WHERE gap IS NOT NULL GROUP BY ALL),
near AS (SELECT recording_id, unit_id, replicate, count(*) FILTER (WHERE gap < {CLOSE}) AS c FROM (SELECT recording_id, unit_id, replicate, x - lag(x, {STEPS}) OVER (PARTITION BY recording_id, unit_id, replicate ORDER BY x) AS gap FROM moved) GROUP BY ALL)
SELECT o.recording_id, o.unit_id, o.c / o.k AS observed, count(*) AS n_surrogates, (1 + count(*) FILTER (WHERE n.c >= o.c)) / (1 + count(*)) AS p_value
FROM own o JOIN near n ON o.recording_id = n.recording_id AND o.unit_id = n.unit_id GROUP BY o.recording_id, o.unit_id, o.c, o.k"""


_RATES = "rates AS (SELECT recording_id, unit_id, count(*) AS n_events, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN count(*) / (max(t) - min(t)) ELSE 0.0 END AS rate FROM trains GROUP BY ALL)"
_BINNED = f"CAST((b.t - a.t + {HALF}) // {BIN} AS INTEGER) AS bin"
_NEAR = f"b.t - a.t >= -{HALF} AND b.t - a.t < {HALF}"
_HOURS = f"""{FILLED}, ends AS (SELECT recording_id, max(idx) + 1 AS n FROM filled GROUP BY ALL), ev AS (SELECT t.recording_id, event_id, t / 1000000 AS t, CAST(round_even((t / 1000000) * {1 / 3600!r}, 0) AS BIGINT) AS at, n FROM trains t JOIN ends ON ends.recording_id = t.recording_id)"""

QUERIES = {
    "f1_restrict_window": (f1, f"WITH {TRAINS} SELECT event_id, recording_id, t FROM trains WHERE t BETWEEN {5 * DAY} AND {10 * DAY}"),
    "f4_keep_labels": (f4, f"WITH {TRAINS} SELECT event_id, recording_id FROM trains WHERE recording_id IN ('click', 'view')"),
    "f5_drop_label_prefix": (f5, f"WITH {TRAINS} SELECT event_id, recording_id FROM trains WHERE NOT starts_with(recording_id, 'c')"),
    "f6_delete_positions": (f6, f"WITH {views.CLOCK} SELECT recording_id, t, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS INTEGER) AS position FROM clock WHERE frame_idx % 7 != 3"),
    "f7_interval_after_event": (f7, f"WITH {TRAINS} SELECT unit_id AS recording_id, min(t / 1000000) AS t0, min(t / 1000000) + 1800 AS t1 FROM trains WHERE starts_with(recording_id, 'pur') GROUP BY unit_id"),
    "f8_select_units": (f8, f"WITH {TRAINS} SELECT event_id, unit_id FROM trains WHERE unit_id IN (1, 5)"),
    "f12_curated_units": (f12, f"WITH {TRAINS} SELECT unit_id, count(*) AS n FROM trains GROUP BY unit_id HAVING count(*) % 2 = 0"),
    "j3_phase_at_events": (j3, f"WITH {FILLED} SELECT e.recording_id, e.event_id, e.t // {HOUR} AS idx, round(f.value, 6) AS value FROM trains e JOIN filled f ON f.recording_id = e.recording_id AND f.idx = e.t // {HOUR}"),
    "j8_unit_pairs": (j8, f"WITH {TRAINS}, u AS (SELECT DISTINCT recording_id, unit_id FROM trains) SELECT a.recording_id, a.unit_id AS ref, b.unit_id AS target FROM u a JOIN u b ON a.recording_id = b.recording_id AND a.unit_id < b.unit_id"),
    "j9_pairs_within": (j9, f"WITH {TRAINS} SELECT a.recording_id, a.event_id AS ref, b.event_id AS target, b.t - a.t AS delta FROM trains a JOIN trains b ON a.recording_id = b.recording_id AND a.event_id != b.event_id AND b.t - a.t >= -{HOUR // 2} AND b.t - a.t < {HOUR // 2}"),
    "a1_peri_event": (a1, f"WITH {_HOURS} SELECT e.recording_id, e.event_id, CAST(o AS INTEGER) AS \"offset\", round(f.value, 6) AS value FROM ev e, (SELECT unnest(range(-2, 4)) AS o), filled f WHERE e.at - 2 >= 0 AND e.at + 3 < e.n AND f.recording_id = e.recording_id AND f.idx = e.at + o"),
    "a1_peri_event_padded": (a1_padded, f"WITH {_HOURS}, w AS (SELECT e.recording_id, e.event_id, e.at, o FROM ev e, (SELECT unnest(range(-2, 4)) AS o)) SELECT w.recording_id, w.event_id, CAST(w.o AS INTEGER) AS \"offset\", round(f.value, 6) AS value FROM w LEFT JOIN filled f ON f.recording_id = w.recording_id AND f.idx = w.at + w.o"),
    "a2_event_triggered_average": (a2, f"WITH {_HOURS}, s AS (SELECT e.recording_id, o, f.value FROM ev e, (SELECT unnest(range(-6, 7)) AS o), filled f WHERE e.at - 6 >= 0 AND e.at + 6 < e.n AND f.recording_id = e.recording_id AND f.idx = e.at + o) SELECT recording_id, CAST(o AS INTEGER) AS \"offset\", count(*) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END, 4) AS std, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END / sqrt(count(*)), 4) AS sem FROM s GROUP BY ALL"),
    "a4_frame_window_average": (a4, f"WITH {_HOURS}, k AS (SELECT recording_id, count(*) AS k FROM ev GROUP BY ALL), s AS (SELECT e.recording_id, o, f.value FROM ev e, (SELECT unnest(range(-48, 49)) AS o), filled f WHERE e.at - 48 >= 0 AND e.at + 48 < e.n AND f.recording_id = e.recording_id AND f.idx = e.at + o) SELECT s.recording_id, CAST(o AS INTEGER) AS \"offset\", round(sum(value) / any_value(k), 4) AS mean FROM s JOIN k ON s.recording_id = k.recording_id GROUP BY s.recording_id, o"),
    "a5_correlogram": (a5, f"WITH {TRAINS} SELECT a.recording_id, a.unit_id AS ref, b.unit_id AS target, {_BINNED}, count(*) AS n FROM trains a JOIN trains b ON a.recording_id = b.recording_id AND {_NEAR} GROUP BY ALL"),
    "a6_auto_correlogram": (a6, f"WITH {TRAINS}, {_RATES}, c AS (SELECT a.recording_id, a.unit_id, {_BINNED}, count(*) AS n FROM trains a JOIN trains b ON a.recording_id = b.recording_id AND a.unit_id = b.unit_id AND {_NEAR} GROUP BY ALL) SELECT r.recording_id, r.unit_id, CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n, round(CASE WHEN g.bin = {BINS // 2} THEN 0.0 WHEN r.rate > 0 THEN coalesce(c.n, 0) / (r.n_events * {float(BIN)!r}) / r.rate END, 6) AS value FROM rates r CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) g LEFT JOIN c ON c.recording_id = r.recording_id AND c.unit_id = r.unit_id AND c.bin = g.bin"),
    "a7_cross_correlogram": (a7, f"WITH {TRAINS}, {_RATES}, c AS (SELECT a.recording_id, a.unit_id AS ref, b.unit_id AS target, {_BINNED}, count(*) AS n FROM trains a JOIN trains b ON a.recording_id = b.recording_id AND a.unit_id < b.unit_id AND {_NEAR} GROUP BY ALL) SELECT a.recording_id, a.unit_id AS ref, b.unit_id AS target, CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n, round(CASE WHEN b.rate > 0 THEN coalesce(c.n, 0) / (a.n_events * {float(BIN)!r}) / b.rate END, 6) AS value FROM rates a JOIN rates b ON a.recording_id = b.recording_id AND a.unit_id < b.unit_id CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) g LEFT JOIN c ON c.recording_id = a.recording_id AND c.ref = a.unit_id AND c.target = b.unit_id AND c.bin = g.bin"),
    "a8_event_correlogram": (a8, f"WITH {TRAINS}, {_RATES}, k AS (SELECT recording_id, count(*) AS n_ref FROM trains WHERE unit_id = 0 GROUP BY ALL), c AS (SELECT b.recording_id, b.unit_id, {_BINNED}, count(*) AS n FROM trains a JOIN trains b ON a.recording_id = b.recording_id AND a.unit_id = 0 AND b.unit_id > 0 AND {_NEAR} GROUP BY ALL) SELECT r.recording_id, r.unit_id, CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n, round(CASE WHEN r.rate > 0 THEN coalesce(c.n, 0) / (k.n_ref * {float(BIN)!r}) / r.rate END, 6) AS value FROM rates r JOIN k ON k.recording_id = r.recording_id CROSS JOIN (SELECT unnest(range(0, {BINS})) AS bin) g LEFT JOIN c ON c.recording_id = r.recording_id AND c.unit_id = r.unit_id AND c.bin = g.bin WHERE r.unit_id > 0"),
    "a9_event_rates": (a9, f"WITH {TRAINS}, {_RATES} SELECT recording_id, unit_id, n_events, round(rate * 1e9, 6) AS rate FROM rates"),
    "a10_interval_histogram": (a10, f"WITH {TRAINS}, i AS (SELECT recording_id, unit_id, CAST(t - lag(t) OVER (PARTITION BY recording_id, unit_id ORDER BY t) AS DOUBLE) AS x FROM trains), e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 20 AS w FROM i), b AS (SELECT recording_id, unit_id, CAST(least(floor((x - lo) / w), 19) AS INTEGER) AS bin, lo, w FROM i, e WHERE x IS NOT NULL) SELECT recording_id, unit_id, bin, round(lo + (bin + 0.5) * w, 3) AS centre, count(*) AS n FROM b GROUP BY ALL"),
    "a10_log_interval_histogram": (a10_log, f"WITH {TRAINS}, i AS (SELECT recording_id, unit_id, ln(t - lag(t) OVER (PARTITION BY recording_id, unit_id ORDER BY t)) AS x FROM trains), b AS (SELECT recording_id, unit_id, CAST(CASE WHEN x < 15 THEN 0 WHEN x < 18 THEN 1 WHEN x < 20 THEN 2 WHEN x < 22 THEN 3 WHEN x < 24 THEN 4 WHEN x < 26 THEN 5 ELSE 6 END AS INTEGER) AS bin FROM i WHERE x BETWEEN 10 AND 30) SELECT recording_id, unit_id, bin, [12.5, 16.5, 19.0, 21.0, 23.0, 25.0, 28.0][bin + 1]::DOUBLE AS centre, count(*) AS n FROM b GROUP BY ALL"),
    "a11_phase_histogram": (a11, f"WITH {PHASES}, b AS (SELECT recording_id, unit_id, least(floor((phase + {views.math.pi!r}) / {views.math.pi / 9!r}), 17) AS bin FROM phases), c AS (SELECT recording_id, unit_id, bin, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT recording_id, unit_id, sum(n) AS total FROM c GROUP BY ALL) SELECT k.recording_id, k.unit_id, CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / (k.total * {views.math.pi / 9!r}), 8) AS density FROM k CROSS JOIN (SELECT unnest(range(0, 18)) AS bin) g LEFT JOIN c ON c.recording_id = k.recording_id AND c.unit_id = k.unit_id AND c.bin = g.bin"),
    "a11_phase_checks": (a11_checks, f"WITH {PHASES} SELECT recording_id, round(min(phase), 8) AS low, round(max(phase), 8) AS high, count(*) FILTER (WHERE phase IS NULL) AS missing, count(*) FILTER (WHERE isinf(phase)) AS infinite FROM phases GROUP BY ALL"),
    "a12_mean_density": (a12, f"WITH {PHASES}, b AS (SELECT recording_id, unit_id, least(floor((phase + {views.math.pi!r}) / {views.math.pi / 9!r}), 17) AS bin FROM phases), c AS (SELECT recording_id, unit_id, bin, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT recording_id, unit_id, sum(n) AS total FROM c GROUP BY ALL), h AS (SELECT k.recording_id, k.unit_id, g.bin, coalesce(c.n, 0) / (k.total * {views.math.pi / 9!r}) AS density FROM k CROSS JOIN (SELECT unnest(range(0, 18)) AS bin) g LEFT JOIN c ON c.recording_id = k.recording_id AND c.unit_id = k.unit_id AND c.bin = g.bin) SELECT recording_id, CAST(bin AS INTEGER) AS bin, round(avg(density), 8) AS mean_density, round(stddev_pop(density) / sqrt(count(*)), 8) AS sem FROM h GROUP BY ALL"),
    "a12_mean_vector": (a12_vector, f"WITH {PHASES}, u AS (SELECT recording_id, unit_id, avg(cos(phase)) AS c, avg(sin(phase)) AS s FROM phases GROUP BY ALL), m AS (SELECT recording_id, avg(c) AS c, avg(s) AS s FROM u GROUP BY ALL) SELECT recording_id, round(atan2(s, c), 6) AS theta, round(sqrt(c * c + s * s), 8) AS radius FROM m"),
    "u1_apply_to_units": (u1, f"WITH {TRAINS}, c AS (SELECT recording_id, unit_id, t // {DAY} AS day, count(*) AS n FROM trains GROUP BY ALL) SELECT recording_id, unit_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS busiest FROM c GROUP BY ALL"),
    "u2_permutation_test": (_test("poisson"), _test_sql("poisson")),
    "u2_jitter_test": (_test("jitter"), _test_sql("jitter")),
    "u2_shift_test": (_test("shift"), _test_sql("shift")),
    "u2_shuffle_test": (_test("shuffle"), _test_sql("shuffle")),
    "w15_jitter": (_draws("jitter"), _draws_sql("jitter")),
    "w16_shift": (_draws("shift"), _draws_sql("shift")),
    "w17_shuffle_intervals": (_draws("shuffle"), _draws_sql("shuffle")),
    "w18_poisson": (_draws("poisson"), _draws_sql("poisson")),
}
