"""Queries of sampled signals and clocks: alignment, sequences, normalisation, spectra.

Recordings are users, whose number grows with the events; pairs of signals are users with neighbouring ids.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axonflow.functions import signals as kernels
from axonflow.functions.scalars import rounded
from axonflow.operators import align, select, sequence, spectral, stats
from axonflow.plans import views
from axonflow.plans.views import CLOCK, DAILY, DAY, HOUR, HOURS, TRAINS
from axonflow.plans.views import USER_FILLED as FILLED
from axonflow.plans.views import USER_HOURLY as HOURLY

R = "recording_id"
WINDOWS = "w AS (SELECT * FROM (VALUES ('control', 0.0, 240.0), ('treatment', 360.0, 600.0)) v(period, start_min, end_min))"


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _near(c, n=6):
    """:func:`_r` for columns with a value for every sample."""
    return rounded(F.col(c), n).alias(c)


def _windows(df, spark):
    return df.select("subject").distinct().crossJoin(F.broadcast(views.windows(spark)))  # two rows


def f2(spark, d):
    signal = views.user_filled(spark, d).withColumnRenamed(R, "subject")
    return select.slice_periods(signal, _windows(signal, spark), 1 / 60).select("subject", "period", "idx", _r("value"))


def f3(spark, d):
    return select.trim_edges(views.user_filled(spark, d), [R], 100).select(R, "idx", _r("value"))


def f11(spark, d):
    return select.frames_in_range(views.clock(spark, d), 3 * DAY, 20 * DAY, 50)


def f13(spark, d):
    both = views.neighbours(spark, d)
    return select.complete_pairs(both, "x", "y").select(R, "idx", _r("x"), _r("y"))


def j1(spark, d):
    samples = views.trains(spark, d).where("unit_id < 4").select(R, F.col("event_id").alias("idx"), "t")
    queries = views.trains(spark, d).where("unit_id >= 4").select(R, F.col("event_id").alias("query_id"), "t")
    return align.nearest(queries, samples, 2 * HOUR)


def j2(spark, d):
    hours = views.user_filled(spark, d).select(R, "idx")
    first = views.clock(spark, d).groupBy(R, F.floor(F.col("t") / (5 * HOUR)).alias("_f")).agg(F.min(F.floor(F.col("t") / HOUR)).alias("idx"))
    frames = first.select(R, "idx", (F.row_number().over(Window.partitionBy(R).orderBy("idx")) - 1).alias("frame_idx"))
    return align.frame_labels(hours, frames)


def j4(spark, d):
    samples = views.trains(spark, d).where("unit_id < 4").select(R, F.col("event_id").alias("idx"), "t", "value")
    queries = views.trains(spark, d).where("unit_id >= 4").select(R, F.col("event_id").alias("query_id"), "t")
    return align.downsample(samples, align.nearest(queries, samples, 2 * HOUR)).select(R, "frame_idx", "idx", "t", _r("value"))


def j4_clock(spark, d):
    h = views.trains(spark, d).select(R, F.col("event_id").alias("idx"), "t", "unit_id")
    return align.clock_conflicts(h.where("unit_id < 6").withColumn("t", F.when(F.col("unit_id") == 3, F.col("t") + 1).otherwise(F.col("t"))), h.where("unit_id > 1"))


def j5(spark, d):
    pairs = views.daily(spark, d)
    x, y = pairs.select(F.col("subject").alias(R), F.col("idx").alias("frame_idx"), F.col("x").alias("value")), pairs.where("x > 1").select(F.col("subject").alias(R), F.col("idx").alias("frame_idx"), F.col("y").alias("value"))
    return align.pair_signals(x, y).select(R, "frame_idx", _r("x"), _r("y"))


def w1(spark, d):
    """Levels alternate but where a pulse falls on a whole multiple of 97 microseconds: its level is read wrongly."""
    flipped = F.col("frame_idx") + (F.col("t") % 97 == 0).cast("long")
    return align.pulse_alternation(views.clock(spark, d).select(R, "t", F.when(flipped % 2 == 0, "high").otherwise("low").alias("label")))


def w2(spark, d):
    return align.sync_gaps(views.clock(spark, d), 3 * HOUR)


def w3(spark, d):
    out = align.repair_gaps(views.clock(spark, d).select(R, (F.col("t") / 1_000_000).alias("t")), 3 * 3600, 3600)
    return out.select(R, "position", (F.floor(F.col("t") * 1000 + 0.25) / 1000).alias("t"), "inserted")


def w3_low(spark, d):
    return align.low_confidence(views.clock(spark, d), 3 * HOUR, HOUR)


def w4(spark, d):
    return sequence.fill_missing(views.user_sparse(spark, d), 2, [R]).select(R, "idx", _near("value"), "is_valid")


def w5(spark, d):
    flags = views.user_hourly(spark, d).select(R, "idx", F.col("value").isNotNull().alias("is_valid"))
    return sequence.dilate_invalid(flags, 2, [R])


def w6(spark, d):
    return sequence.mask_intervals(views.user_filled(spark, d), [R], F.col("value") > 20, 0.5, 10.0)


def w7(spark, d):
    return sequence.keep_durations(w6(spark, d), 2.0, 6.0)


def w8(spark, d):
    return sequence.merge_close(w6(spark, d), 5.0, [R])


def w9(spark, d):
    return sequence.unit_events(views.user_filled(spark, d), 1, 10.0, [R], flat=False).select(R, "idx", _r("value"))


def w9_plain(spark, d):
    whole = views.user_filled(spark, d).withColumn("value", F.floor(F.col("value") / 20).cast("double"))
    return sequence.peaks(whole, 1.0, [R]).select(R, "idx", _r("value"))


def w10(spark, d):
    return sequence.spike_events(views.user_filled(spark, d)).groupBy(R).agg(F.count(F.lit(1)).alias("n"))


def w11(spark, d):
    return sequence.upward_crossings(views.user_filled(spark, d), 25.0, [R]).select(R, "idx", _r("value"))


def w12(spark, d):
    whole = views.user_filled(spark, d).withColumn("value", F.floor("value").cast("double"))
    return sequence.step_changes(whole, [R]).withColumn("change", F.round("change", 3))


def w13(spark, d):
    out = sequence.suppress_artifacts(views.user_sparse(spark, d).filled(0.0), 1.0, [R], limit=60.0, max_gap_seconds=3.0, width=9)
    return out.select(R, "idx", _near("value", 9), "flagged")


def w14(spark, d):
    """Segments are the days on which a user has events; the days between them are holes."""
    days = views.user_hourly(spark, d).withColumn("day", F.floor(F.col("idx") / 24))
    hour = F.struct("idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    packed = days.groupBy(R, "day").agg(F.sort_array(F.collect_list(hour)).alias("v"), F.count("value").alias("_seen")).where("_seen > 0")
    segments = packed.select(R, (F.col("day") * 24.0 + 0.2).alias("t_start"), F.lit(1.0).alias("fs"), F.col("v.value").alias("values"))
    return sequence.stitch_segments(segments, [R]).select(R, "idx", _r("t"), _r("value"), "filled")


def w21(spark, d):
    return sequence.moving_mean(views.user_filled(spark, d), 5, [R]).select(R, "idx", _r("value", 5))


def a15(spark, d):
    return stats.pooled_z(views.user_hourly(spark, d), [R]).select(R, "idx", _r("z", 5))


def a16(spark, d):
    return stats.block_z(views.user_filled(spark, d), [R], 100).select(R, "idx", _r("z", 5))


def a17(spark, d):
    return stats.regression(views.daily(spark, d), ["subject"], least=None).select("subject", "n", _r("r"), _r("slope"), _r("intercept", 5))


def a18(spark, d):
    pairs = spectral.numbered(views.daily(spark, d), ["subject"])
    return stats.effective_n(pairs, ["subject"], 20).select("subject", "n", _r("n_effective", 4))


def a18_all(spark, d):
    out = stats.robust_correlation(spectral.numbered(views.daily(spark, d), ["subject"]), ["subject"], max_lags=20)
    return out.select("subject", "n", "n_effective", *(_r(c) for c in ("r", "p_value", "p_value_corrected", "ci_lower", "ci_upper")))


def a26(spark, d):
    return stats.outlier_flags(views.user_sparse(spark, d), [R], limit=1.0).select(R, "idx", "is_outlier")


def a27(spark, d):
    return stats.percentile_limits(views.user_hourly(spark, d), [R]).select(R, _r("low", 5), _r("high", 5))


def a28(spark, d):
    return stats.envelope(views.user_filled(spark, d), [R], 60).select(R, "idx", _r("value"))


def p1(spark, d):
    return spectral.zero_phase(views.user_filled(spark, d), [R], 2, [0.05, 0.2], "band", 1.0).select(R, "idx", _r("value"))


def p1_fir(spark, d):
    return spectral.zero_phase(views.user_filled(spark, d), [R], 31, 0.1, "low", 1.0, "fir").select(R, "idx", _r("value"))


def p3(spark, d):
    return spectral.phase_and_envelope(views.user_sparse(spark, d).filled(0.0), [R]).select(R, "idx", _near("phase"), _near("envelope"))


def p4(spark, d):
    out = spectral.multitaper_spectrogram(views.user_filled(spark, d), [R], 1.0, 48.0, 24.0, 2.0, detrend="constant")
    return out.select(R, "t", _r("freq"), _r("power"))


def p5(spark, d):
    from axonflow.functions.scalars import power_to_db

    return views.user_hourly(spark, d).select(R, "idx", F.round(power_to_db(F.col("value")), 6).alias("db"))


def p6(spark, d):
    return spectral.band_power(views.user_filled(spark, d), [R], 1.0, (0.03, 0.06), 48.0, 24.0, 2.0).select(R, _r("power_db"))


def _pairs(spark, d):
    return views.user_neighbours(spark, d)


def p7(spark, d):
    return spectral.coherence(views.sparse_neighbours(spark, d).filled(0.0), [R], 1.0, 32).select(R, _near("freq"), _near("coherence"))


def p8(spark, d):
    return spectral.cross_correlation(views.sparse_neighbours(spark, d).filled(0.0), [R], 1.0, 10).select(R, "lag", _near("value"))


def p9(spark, d):
    out = spectral.signal_statistics(_pairs(spark, d), [R], 1.0, (0.03, 0.2), 48.0, 24.0, 2.0, 10, 32)
    return out.select(R, "measurement", _r("value", 5))


def p10(spark, d):
    return spectral.coherogram(views.sparse_neighbours(spark, d).filled(0.0), [R], 1.0, 48.0, 24.0).select(R, "t", _near("freq"), _near("coherence"))


def p11(spark, d):
    return spectral.wavelet_transform(views.user_sparse(spark, d).filled(0.0), [R], [0.05, 0.1, 0.2], 1.0).where("idx >= 0").select(R, "idx", "freq", _near("re"), _near("im"))


def p12(spark, d):
    return spectral.oscillatory_events(views.user_sparse(spark, d).filled(0.0), [R], 1.0, (0.05, 0.2), (1.0, 10.0), (2.0, 40.0), 2.0)


_GAP = f"g AS (SELECT *, lead(t) OVER (PARTITION BY recording_id ORDER BY t) - t AS dt FROM clock)"
_NUMBERED = "n AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY idx) - 1 AS i, x, y FROM daily)"
_MASK = "m AS (SELECT recording_id, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k, idx FROM filled WHERE value > 20), iv AS (SELECT recording_id, min(idx) / 0.5 + 10.0 AS \"start\", max(idx) / 0.5 + 10.0 AS \"end\" FROM m GROUP BY recording_id, k)"
_S = "s AS (SELECT recording_id, event_id AS idx, t, value FROM trains WHERE unit_id < 4), q AS (SELECT recording_id, event_id AS query_id, t FROM trains WHERE unit_id >= 4)"
_NEAREST = f"{_S}, b AS (SELECT q.*, (SELECT max(struct_pack(t := s.t, i := s.idx)) FROM s WHERE s.recording_id = q.recording_id AND s.t <= q.t) AS lo, (SELECT min(struct_pack(t := s.t, i := s.idx)) FROM s WHERE s.recording_id = q.recording_id AND s.t > q.t) AS hi FROM q), nn AS (SELECT recording_id, query_id, t, CASE WHEN hi IS NULL OR (lo IS NOT NULL AND t - lo.t <= hi.t - t) THEN lo ELSE hi END AS s FROM b)"
_PAIR = "p AS (SELECT a.recording_id, a.idx, a.value AS x, b.value AS y FROM filled a JOIN filled b ON a.idx = b.idx AND CAST(b.recording_id AS BIGINT) = CAST(a.recording_id AS BIGINT) + 1)"

_P3 = f"""WITH {FILLED}, n AS (SELECT recording_id, count(*) AS n FROM filled GROUP BY ALL),
k AS (SELECT n, m, CASE WHEN n % 2 = 0 THEN CASE WHEN m % 2 = 1 THEN 2.0 / n / tan(pi() * m / n) ELSE 0.0 END ELSE (cos(pi() * m / n) - CASE WHEN m % 2 = 1 THEN -1.0 ELSE 1.0 END) / sin(pi() * m / n) / n END AS h
  FROM (SELECT n, unnest(range(1, n)) AS m FROM (SELECT DISTINCT n FROM n))),
y AS (SELECT t.recording_id, t.idx, any_value(t.value) AS value, sum(s.value * k.h) AS y FROM filled t JOIN n ON n.recording_id = t.recording_id JOIN filled s ON s.recording_id = t.recording_id AND s.idx <> t.idx AND s.value <> 0
  JOIN k ON k.n = n.n AND k.h <> 0 AND k.m = (t.idx - s.idx + n.n) % n.n GROUP BY t.recording_id, t.idx)
SELECT f.recording_id, f.idx, round(atan2(coalesce(y.y, 0.0), f.value), 6) AS phase, round(sqrt(f.value ** 2 + coalesce(y.y, 0.0) ** 2), 6) AS envelope FROM filled f LEFT JOIN y ON y.recording_id = f.recording_id AND y.idx = f.idx"""
#: Tapers of 48 samples, as a table of the SQL.
_TAPERS = ", ".join(f"({k}, {i}, {float(v)!r}::DOUBLE)" for k, taper in enumerate(kernels.slepian(48, 2.0, 3)[0]) for i, v in enumerate(taper))
_P4 = f"""WITH {FILLED}, tapers(k, i, v) AS (VALUES {_TAPERS}),
basis AS (SELECT k, i, q, v * cos(2 * pi() * q * i / 64) AS c, v * sin(2 * pi() * q * i / 64) AS s FROM tapers, (SELECT unnest(range(0, 33)) AS q)),
starts AS (SELECT recording_id, unnest(range(0, max(idx) - 46, 24)) AS a FROM filled GROUP BY recording_id),
x AS (SELECT f.recording_id, a, f.idx - a AS i, value - avg(value) OVER (PARTITION BY f.recording_id, a) AS v FROM filled f JOIN starts s ON s.recording_id = f.recording_id AND f.idx BETWEEN a AND a + 47),
f AS (SELECT recording_id, a, q, k, sum(x.v * c) ** 2 + sum(x.v * s) ** 2 AS p FROM x JOIN basis ON basis.i = x.i GROUP BY ALL),
spectrum AS (SELECT recording_id, a + 24.0 AS t, q / 64 AS freq, avg(p) * CASE WHEN q IN (0, 32) THEN 1 ELSE 2 END AS power FROM f GROUP BY recording_id, a, q)"""
_P11 = f"""WITH {FILLED}, w(freq, scale) AS (VALUES (0.05::DOUBLE, 20.0::DOUBLE), (0.1, 10.0), (0.2, 5.0)),
sizes AS (SELECT *, CAST(floor(16 * scale) AS BIGINT) + 1 AS n, (SELECT CAST(floor(16 * max(scale)) AS BIGINT) + 1 FROM w) AS size FROM w),
k AS (SELECT freq, (size - n) // 2 + j AS k, size, (n - 1 - j) / scale - 8 AS t FROM (SELECT *, unnest(range(0, n)) AS j FROM sizes)),
kernel AS (SELECT freq, (size - 1) // 2 - k AS ahead, freq * exp(-t * t / 1.5) / pow(pi() * 1.5, 0.25) * cos(2 * pi() * t) AS re, -freq * exp(-t * t / 1.5) / pow(pi() * 1.5, 0.25) * sin(2 * pi() * t) AS im FROM k)
SELECT f.recording_id, f.idx - ahead AS idx, freq, round(sum(value * re), 6) + 0.0 AS re, round(sum(value * im), 6) + 0.0 AS im FROM filled f, kernel
WHERE f.idx - ahead >= 0 AND f.idx - ahead <= (SELECT max(idx) FROM filled) GROUP BY f.recording_id, f.idx - ahead, freq"""

#: Effective numbers of samples.
_EFFECTIVE = f"WITH {DAILY}, {_NUMBERED}, c AS (SELECT subject, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY subject)), l AS (SELECT a.subject, b.i - a.i AS lag, sum(a.x * b.x) AS sx, sum(a.y * b.y) AS sy, any_value(a.k) AS k FROM c a JOIN c b ON a.subject = b.subject AND b.i - a.i BETWEEN 0 AND least(20, a.k // 4) GROUP BY ALL), z AS (SELECT subject, sx, sy FROM l WHERE lag = 0), s AS (SELECT l.subject, any_value(k) AS n, sum(CASE WHEN lag > 0 THEN (l.sx / z.sx) * (l.sy / z.sy) END) AS s FROM l JOIN z ON z.subject = l.subject GROUP BY l.subject)"


def p_values_sql(rows: str) -> str:
    """Common table expressions that end in ``p`` (subject, kind, p): two-sided p of Student's t for ``rows`` (subject, kind, t,
    df), by the series of the incomplete beta function, all of whose terms are positive."""
    return f"""pv AS (SELECT subject, kind, df / 2 AS a, t * t / (df + t * t) AS y FROM ({rows}) WHERE df > 0),
terms AS (SELECT subject, kind, a, y, sum(exp(lgamma(a + 0.5 + k) - lgamma(a + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + CASE WHEN k = 0 THEN 0.0 ELSE k * ln(greatest(y, 1e-300)) END)) AS s FROM pv, (SELECT unnest(range(0, 600)) AS k) GROUP BY ALL),
p AS (SELECT subject, kind, 1 - sqrt(y) * pow(1 - y, a) * 2 * exp(lgamma(a + 0.5) - lgamma(0.5) - lgamma(a)) * s AS p FROM terms)"""


_ROBUST = f"""{_EFFECTIVE}, e AS (SELECT subject, greatest(3.0, least(n / (1 + 2 * greatest(0.0, coalesce(s, 0.0))), n)) AS ne FROM s),
g AS (SELECT subject, count(*) AS n, CASE WHEN count(*) >= 10 AND max(x) > min(x) AND max(y) > min(y) THEN corr(y, x) END AS r FROM daily GROUP BY subject),
b AS (SELECT g.*, e.ne FROM g JOIN e ON e.subject = g.subject),
{p_values_sql("SELECT subject, 'plain' AS kind, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2.0::DOUBLE AS df FROM b WHERE r IS NOT NULL UNION ALL SELECT subject, 'corrected', r * sqrt((ne - 2) / (1 - r * r + 1e-10)), ne - 2 FROM b WHERE r IS NOT NULL")}
SELECT b.subject, b.n, CAST(floor(ne) AS BIGINT) AS n_effective, round(r, 6) AS r, round(p1.p, 6) AS p_value, round(p2.p, 6) AS p_value_corrected,
  CASE WHEN ne > 3 THEN round(tanh(atanh(r) - 1.959963984540054 / sqrt(ne - 3)), 6) END AS ci_lower, CASE WHEN ne > 3 THEN round(tanh(atanh(r) + 1.959963984540054 / sqrt(ne - 3)), 6) END AS ci_upper
FROM b LEFT JOIN p p1 ON p1.subject = b.subject AND p1.kind = 'plain' LEFT JOIN p p2 ON p2.subject = b.subject AND p2.kind = 'corrected'"""

def zero_phase_sql(taps: str, pad: int, source: str = FILLED, value: str = "round(value, 6) + 0.0") -> str:
    """Filter ``filled`` of ``source`` forwards and backwards by an impulse response (``taps``: k, h), from the steady state of the
    odd-padded signal."""
    return f"""WITH {source}, {taps},
n AS (SELECT recording_id, count(*) AS n, arg_min(value, idx) AS v0, arg_max(value, idx) AS v1 FROM filled GROUP BY ALL),
e AS (SELECT f.recording_id, f.idx AS m, value FROM filled f
      UNION ALL SELECT f.recording_id, -f.idx, 2 * v0 - value FROM filled f JOIN n ON n.recording_id = f.recording_id WHERE f.idx BETWEEN 1 AND {pad}
      UNION ALL SELECT f.recording_id, 2 * (n - 1) - f.idx, 2 * v1 - value FROM filled f JOIN n ON n.recording_id = f.recording_id WHERE f.idx BETWEEN n - {pad + 1} AND n - 2),
ahead AS MATERIALIZED (SELECT recording_id, m, greatest(m - k, -{pad}) AS at, sum(h) AS h FROM e CROSS JOIN taps GROUP BY ALL),
once AS MATERIALIZED (SELECT a.recording_id, a.m, sum(h * b.value) AS value FROM ahead a JOIN e b ON b.recording_id = a.recording_id AND b.m = a.at GROUP BY ALL),
back AS MATERIALIZED (SELECT o.recording_id, m, least(m + k, n + {pad - 1}) AS at, h FROM once o JOIN n ON n.recording_id = o.recording_id CROSS JOIN taps WHERE m BETWEEN 0 AND n - 1),
twice AS (SELECT a.recording_id, a.m, sum(h * b.value) AS value FROM back a JOIN once b ON b.recording_id = a.recording_id AND b.m = a.at GROUP BY ALL)
SELECT recording_id, m AS idx, {value} AS value FROM twice"""


def impulse_response(n: int, *design) -> str:
    """The first ``n`` samples of a filter's impulse response, by its difference equations, as a table of the SQL."""
    x = [1.0] + [0.0] * (n - 1)
    for b, a in kernels.butterworth(*design):
        y: list[float] = []
        for i in range(n):
            past = sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - j] for j in (1, 2) if i >= j)
            y.append(float(past))
        x = y
    return "taps(k, h) AS (VALUES " + ", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in enumerate(x)) + ")"


_SINC = """raw AS (SELECT k, CASE WHEN k = 15 THEN 0.2 ELSE sin(0.2 * pi() * (k - 15)) / (pi() * (k - 15)) END * (0.54 - 0.46 * cos(2 * pi() * k / 30)) AS h FROM (SELECT unnest(range(0, 31)) AS k)),
taps AS (SELECT k, h / (SELECT sum(h) FROM raw) AS h FROM raw)"""
#: Products of spectra by frequency, and z-scored pairs.
_PRODUCTS = f"WITH {FILLED}, {_PAIR}, w AS (SELECT recording_id, k, i, x - avg(x) OVER (PARTITION BY recording_id, k) AS x, y - avg(y) OVER (PARTITION BY recording_id, k) AS y FROM (SELECT unnest(range(0, ({HOURS} - 32) // 16 + 1)) AS k), p, (SELECT unnest(range(0, 32)) AS i) WHERE p.idx = k * 16 + i), h AS (SELECT recording_id, k, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS x, y * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM w), f AS (SELECT recording_id, k, q, sum(x * cos(2 * pi() * q * i / 32)) AS xr, -sum(x * sin(2 * pi() * q * i / 32)) AS xi, sum(y * cos(2 * pi() * q * i / 32)) AS yr, -sum(y * sin(2 * pi() * q * i / 32)) AS yi FROM h, (SELECT unnest(range(0, 17)) AS q) GROUP BY ALL), s AS (SELECT recording_id, q, sum(xr * xr + xi * xi) AS xx, sum(yr * yr + yi * yi) AS yy, sum(xr * yr + xi * yi) AS re, sum(xr * yi - xi * yr) AS im FROM f GROUP BY ALL)"
_SCORES = f"WITH {FILLED}, {_PAIR}, z AS (SELECT recording_id, idx, (x - avg(x) OVER w) / (stddev_pop(x) OVER w * count(*) OVER w + 1e-12) AS x, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-12) AS y FROM p WINDOW w AS (PARTITION BY recording_id))"
_P9 = f"""WITH pw AS ({_P4} SELECT CAST(recording_id AS BIGINT) AS id, avg(10 * log10(power)) AS db FROM spectrum WHERE freq BETWEEN 0.03 AND 0.2 AND power > 0 GROUP BY ALL),
co AS ({_PRODUCTS} SELECT CAST(recording_id AS BIGINT) AS id, avg((re * re + im * im) / nullif(xx * yy, 0)) AS c FROM s WHERE q / 32 BETWEEN 0.03 AND 0.2 GROUP BY ALL),
cc AS ({_SCORES}, v AS (SELECT a.recording_id, b.idx - a.idx AS lag, sum(a.x * b.y) AS value FROM z a JOIN z b ON a.recording_id = b.recording_id AND b.idx - a.idx BETWEEN -10 AND 10 GROUP BY ALL)
  SELECT CAST(recording_id AS BIGINT) AS id, max({{'value': value, 'minus': -lag}}) AS b FROM v GROUP BY ALL),
w AS (SELECT co.id, p1.db AS power_1, p2.db AS power_2, co.c AS coherence, cc.b.value AS peak, CAST(-cc.b.minus AS DOUBLE) AS lag FROM co JOIN cc ON cc.id = co.id JOIN pw p1 ON p1.id = co.id JOIN pw p2 ON p2.id = co.id + 1)
SELECT CAST(id AS VARCHAR) AS recording_id, measurement, round(CASE measurement WHEN 'power_1' THEN power_1 WHEN 'power_2' THEN power_2 WHEN 'coherence' THEN coherence WHEN 'peak' THEN peak ELSE lag END, 5) AS value
FROM w, (VALUES ('power_1'), ('power_2'), ('coherence'), ('peak'), ('lag')) m(measurement)"""

QUERIES = {
    "f2_slice_periods": (f2, f"WITH {FILLED}, {WINDOWS} SELECT recording_id AS subject, period, idx, round(value, 6) AS value FROM filled, w WHERE idx >= start_min AND idx < end_min"),
    "f3_trim_edges": (f3, f"WITH {FILLED} SELECT recording_id, idx, round(value, 6) AS value FROM filled WHERE idx BETWEEN 100 AND {HOURS - 101}"),
    "f11_frames_in_range": (f11, f"WITH {CLOCK}, r AS (SELECT recording_id, min(frame_idx) FILTER (WHERE t >= {3 * DAY}) AS first_frame, max(frame_idx) FILTER (WHERE t <= {20 * DAY}) AS last_frame FROM clock GROUP BY ALL) SELECT recording_id, first_frame, last_frame, range(first_frame // 50, last_frame // 50 + 1) AS files FROM r WHERE first_frame <= last_frame"),
    "f13_complete_pairs": (f13, f"WITH {HOURLY} SELECT a.recording_id, a.idx, round(a.value, 6) AS x, round(b.value, 6) AS y FROM hourly a JOIN hourly b ON a.idx = b.idx AND CAST(b.recording_id AS BIGINT) = CAST(a.recording_id AS BIGINT) + 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL"),
    "j1_nearest": (j1, f"WITH {TRAINS}, {_NEAREST} SELECT recording_id, query_id, t, s.i AS idx, s.t AS sample_t FROM nn"),
    "j2_frame_labels": (j2, f"WITH {FILLED}, c AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, epoch_us(ts) - 1704067200000000 AS t FROM events), f AS (SELECT recording_id, min(t // {HOUR}) AS idx FROM c GROUP BY recording_id, t // {5 * HOUR}), k AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS k, idx AS lo, lead(idx) OVER (PARTITION BY recording_id ORDER BY idx) AS hi FROM f) SELECT h.recording_id, h.idx, coalesce(k.k, 0) AS frame_label FROM filled h LEFT JOIN k ON k.recording_id = h.recording_id AND h.idx > k.lo AND h.idx <= k.hi"),
    "j4_downsample": (j4, f"WITH {TRAINS}, {_NEAREST} SELECT nn.recording_id, nn.query_id AS frame_idx, nn.s.i AS idx, v.t, round(v.value, 6) AS value FROM nn JOIN s v ON v.idx = nn.s.i AND v.recording_id = nn.recording_id"),
    "j4_clock_conflicts": (j4_clock, f"WITH {TRAINS}, a AS (SELECT recording_id, event_id AS idx, CASE WHEN unit_id = 3 THEN t + 1 ELSE t END AS t_1 FROM trains WHERE unit_id < 6), b AS (SELECT recording_id, event_id AS idx, t AS t_2 FROM trains WHERE unit_id > 1) SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, coalesce(a.idx, b.idx) AS idx, t_1, t_2 FROM a FULL JOIN b ON a.recording_id = b.recording_id AND a.idx = b.idx WHERE t_1 IS DISTINCT FROM t_2"),
    "j5_pair_signals": (j5, f"WITH {DAILY} SELECT subject AS recording_id, idx AS frame_idx, round(x, 6) AS x, round(y, 6) AS y FROM daily WHERE x > 1"),
    "w1_pulse_alternation": (w1, f"WITH {CLOCK}, l AS (SELECT recording_id, t, (frame_idx + CAST(t % 97 = 0 AS BIGINT)) % 2 AS label FROM clock), g AS (SELECT *, lag(label, 2) OVER w AS two, lag(label) OVER w AS one FROM l WINDOW w AS (PARTITION BY recording_id ORDER BY t)) SELECT recording_id, coalesce(bool_and(two = label), true) AND arg_max(coalesce(one != label, false), t) AS alternates FROM g GROUP BY ALL"),
    "w2_sync_gaps": (w2, f"WITH {CLOCK}, {_GAP} SELECT recording_id, t, CAST(frame_idx AS INTEGER) AS position, dt FROM g WHERE dt > {3 * HOUR}"),
    "w3_repair_gaps": (w3, f"WITH {CLOCK}, s AS (SELECT recording_id, t / 1000000 AS t FROM clock), g AS (SELECT *, lead(t) OVER (PARTITION BY recording_id ORDER BY t) - t AS dt FROM s), k AS (SELECT *, CASE WHEN dt > 10800 THEN greatest(CAST(round_even(dt / 3600, 0) AS INTEGER), 1) ELSE 1 END AS g FROM g), e AS (SELECT recording_id, t, dt, g, unnest(range(0, g)) AS i FROM k), o AS (SELECT recording_id, t + coalesce(i * dt / g, 0.0) AS t, i > 0 AS inserted FROM e) SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS INTEGER) AS position, floor(t * 1000 + 0.25::DOUBLE) / 1000 AS t, inserted FROM o"),
    "w3_low_confidence": (w3_low, f"WITH {CLOCK}, {_GAP} SELECT recording_id, CAST(frame_idx AS INTEGER) AS \"first\", CAST(frame_idx + round_even(dt / {HOUR}, 0) AS INTEGER) AS \"last\" FROM g WHERE dt > {3 * HOUR}"),
    "w4_fill_missing": (w4, f"WITH {HOURLY}, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS pi, last_value(value IGNORE NULLS) OVER w AS pv, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER v AS ni, first_value(value IGNORE NULLS) OVER v AS nv FROM hourly WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), r AS (SELECT *, coalesce(ni, {HOURS}) - coalesce(pi, -1) - 1 AS run FROM k) SELECT recording_id, idx, round(CASE WHEN value IS NOT NULL THEN value WHEN run <= 2 THEN CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * ((idx - pi) / (ni - pi)) END ELSE 0.0 END, 6) AS value, value IS NOT NULL OR run <= 2 AS is_valid FROM r"),
    "w5_dilate_invalid": (w5, f"WITH {HOURLY} SELECT recording_id, idx, bool_and(value IS NOT NULL) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS is_valid FROM hourly"),
    "w6_mask_intervals": (w6, f"WITH {FILLED}, {_MASK} SELECT * FROM iv"),
    "w7_keep_durations": (w7, f"WITH {FILLED}, {_MASK} SELECT * FROM iv WHERE \"end\" - \"start\" BETWEEN 2.0 AND 6.0"),
    "w8_merge_close": (w8, f"WITH {FILLED}, {_MASK}, u AS (SELECT *, max(\"end\") OVER (PARTITION BY recording_id ORDER BY \"start\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iv), n AS (SELECT *, sum(CASE WHEN \"start\" - upto < 5.0 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY \"start\") AS k FROM u) SELECT recording_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM n GROUP BY recording_id, k"),
    "w9_unit_events": (w9, f"WITH {FILLED}, x AS (SELECT recording_id, idx, lead(value) OVER w - value AS v FROM filled WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), y AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) SELECT recording_id, idx, round(v, 6) AS value FROM y WHERE v > a AND v > b AND v >= 10"),
    "w9_flat_peaks": (w9_plain, f"WITH {FILLED}, x AS (SELECT recording_id, idx, floor(value / 20) AS v FROM filled), c AS (SELECT *, sum(CASE WHEN v IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY idx) AS k FROM (SELECT *, lag(v) OVER (PARTITION BY recording_id ORDER BY idx) AS p FROM x)), g AS (SELECT recording_id, k, min(idx) AS a, max(idx) AS b, any_value(v) AS v FROM c GROUP BY ALL), y AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM g WINDOW w AS (PARTITION BY recording_id ORDER BY k)) SELECT recording_id, (a + b) // 2 AS idx, v AS value FROM y WHERE v > l AND v > r AND v >= 1"),
    "w10_spike_events": (w10, f"WITH {FILLED} SELECT recording_id, count(*) AS n FROM filled WHERE value > 0 GROUP BY ALL"),
    "w11_upward_crossings": (w11, f"WITH {FILLED}, x AS (SELECT *, lag(value) OVER (PARTITION BY recording_id ORDER BY idx) AS p FROM filled) SELECT recording_id, idx, round(value, 6) AS value FROM x WHERE value >= 25 AND p < 25"),
    "w12_step_changes": (w12, f"WITH {FILLED}, x AS (SELECT recording_id, idx, lead(floor(value)) OVER w - floor(value) AS a FROM filled WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), y AS (SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY idx) - a AS c FROM x) SELECT recording_id, idx + 1 AS idx, c AS change FROM y WHERE abs(c) > 1"),
    "w13_suppress_artifacts": (w13, f"WITH {FILLED}, m AS (SELECT recording_id, idx, value - avg(value) OVER (PARTITION BY recording_id) AS v FROM filled), k AS (SELECT *, last_value(CASE WHEN abs(v) > 60 THEN idx END IGNORE NULLS) OVER w AS p, first_value(CASE WHEN abs(v) > 60 THEN idx END IGNORE NULLS) OVER u AS n FROM m WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), f AS (SELECT *, abs(v) > 60 OR coalesce(n - p - 1 < 3, false) AS flagged, least(idx - p, n - idx) AS d FROM k) SELECT recording_id, idx, round(v * CASE WHEN flagged THEN 1 - 0.5 * (1 - cos(2 * pi() * 4 / 8)) WHEN d <= 4 THEN 1 - 0.5 * (1 - cos(2 * pi() * (4 + d) / 8)) ELSE 1 END, 9) AS value, flagged FROM f"),
    "w14_stitch_segments": (w14, f"WITH {HOURLY}, s AS (SELECT recording_id, idx, CASE WHEN max(value IS NOT NULL) OVER (PARTITION BY recording_id, idx // 24) THEN coalesce(value, 0.0) END AS v FROM hourly), e AS (SELECT recording_id, min(idx) AS lo, max(idx) AS hi FROM s WHERE v IS NOT NULL GROUP BY ALL), k AS (SELECT s.*, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS pi, last_value(v IGNORE NULLS) OVER w AS pv, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER u AS ni, first_value(v IGNORE NULLS) OVER u AS nv FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT k.recording_id, idx - e.lo AS idx, round(0.2::DOUBLE + idx, 6) AS t, round(coalesce(v, pv + (nv - pv) * (idx - pi) / (ni - pi)), 6) AS value, v IS NULL AS filled FROM k JOIN e ON e.recording_id = k.recording_id AND idx BETWEEN lo AND hi"),
    "w21_moving_mean": (w21, f"WITH {FILLED} SELECT recording_id, idx, round(sum(value) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 5) AS value FROM filled"),
    "a15_pooled_z": (a15, f"WITH {HOURLY} SELECT recording_id, idx, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 5) AS z FROM hourly WINDOW w AS (PARTITION BY recording_id)"),
    "a16_block_z": (a16, f"WITH {FILLED} SELECT recording_id, idx, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 5) AS z FROM filled WINDOW w AS (PARTITION BY recording_id, idx // 100)"),
    "a17_regression": (a17, f"WITH {DAILY} SELECT subject, count(*) AS n, round(corr(y, x), 6) AS r, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM daily GROUP BY ALL"),
    "a18_effective_n": (a18, f"{_EFFECTIVE} SELECT subject, n, round(greatest(3.0, least(n / (1 + 2 * greatest(0.0, s)), n)), 4) AS n_effective FROM s"),
    "a18_robust_correlation": (a18_all, _ROBUST),
    "a26_outlier_flags": (a26, f"WITH {HOURLY}, m AS (SELECT recording_id, median(value) AS m FROM hourly GROUP BY ALL), s AS (SELECT h.recording_id, median(abs(h.value - m.m)) AS mad FROM hourly h JOIN m ON m.recording_id = h.recording_id GROUP BY ALL) SELECT h.recording_id, h.idx, coalesce(abs(h.value - m.m) > 1.4826 * s.mad, true) AS is_outlier FROM hourly h JOIN m ON m.recording_id = h.recording_id JOIN s ON s.recording_id = h.recording_id"),
    "a27_percentile_limits": (a27, f"WITH {HOURLY} SELECT recording_id, round(quantile_cont(value, 0.05), 5) AS low, round(quantile_cont(value, 0.95), 5) AS high FROM hourly GROUP BY ALL"),
    "a28_envelope": (a28, f"WITH {FILLED}, b AS (SELECT *, CAST(floor((idx - min(idx) OVER r) * 30 / count(*) OVER r) AS BIGINT) AS b FROM filled WINDOW r AS (PARTITION BY recording_id)), m AS (SELECT recording_id, b, arg_min(idx, (value, idx)) AS lo, arg_max(idx, (value, -idx)) AS hi FROM b GROUP BY ALL), p AS (SELECT recording_id, lo AS idx FROM m UNION SELECT recording_id, hi FROM m) SELECT p.recording_id, p.idx, round(f.value, 6) AS value FROM p JOIN filled f ON f.recording_id = p.recording_id AND f.idx = p.idx"),
    "p5_power_db": (p5, f"WITH {HOURLY} SELECT recording_id, idx, CASE WHEN value > 0 THEN round(10 * log10(value), 6) END AS db FROM hourly"),
    "p7_coherence": (p7, f"{_PRODUCTS} SELECT recording_id, round(q / 32, 6) AS freq, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM s"),
    "p8_cross_correlation": (p8, f"{_SCORES} SELECT a.recording_id, CAST(b.idx - a.idx AS INTEGER) AS lag, round(sum(a.x * b.y), 6) AS value FROM z a JOIN z b ON a.recording_id = b.recording_id AND b.idx - a.idx BETWEEN -10 AND 10 GROUP BY a.recording_id, b.idx - a.idx"),
    "p10_coherogram": (p10, f"WITH {FILLED}, {_PAIR}, w AS (SELECT recording_id, k, i, x - avg(x) OVER v AS x, y - avg(y) OVER v AS y FROM (SELECT unnest(range(0, ({HOURS} - 48) // 24 + 1)) AS k), p, (SELECT unnest(range(0, 48)) AS i) WHERE p.idx = k * 24 + i WINDOW v AS (PARTITION BY recording_id, k)), h AS (SELECT recording_id, k, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 48)) AS x, y * (0.5 - 0.5 * cos(2 * pi() * i / 48)) AS y FROM w), f AS (SELECT recording_id, k, q, sum(x * cos(2 * pi() * q * i / 48)) AS xr, -sum(x * sin(2 * pi() * q * i / 48)) AS xi, sum(y * cos(2 * pi() * q * i / 48)) AS yr, -sum(y * sin(2 * pi() * q * i / 48)) AS yi FROM h, (SELECT unnest(range(0, 25)) AS q) GROUP BY ALL), s AS (SELECT recording_id, k, q, avg(xr * xr + xi * xi) OVER n AS xx, avg(yr * yr + yi * yi) OVER n AS yy, avg(xr * yr + xi * yi) OVER n AS re, avg(xr * yi - xi * yr) OVER n AS im FROM f WINDOW n AS (PARTITION BY recording_id, q ORDER BY k ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)) SELECT recording_id, CAST(k * 24 + 24 AS DOUBLE) AS t, round(q / 48, 6) AS freq, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM s"),
    "p1_zero_phase": (p1, zero_phase_sql(impulse_response(192, 2, [0.05, 0.2], "band", 1.0), 15)), "p1_zero_phase_fir": (p1_fir, zero_phase_sql(_SINC, 93)), "p3_phase_and_envelope": (p3, _P3),
    "p4_multitaper_spectrogram": (p4, f"{_P4} SELECT recording_id, t, round(freq, 6) AS freq, round(power, 6) AS power FROM spectrum"),
    "p6_band_power": (p6, f"{_P4} SELECT recording_id, round(avg(10 * log10(power)), 6) AS power_db FROM spectrum WHERE freq BETWEEN 0.03 AND 0.06 AND power > 0 GROUP BY ALL"),
    "p9_signal_statistics": (p9, _P9), "p11_wavelet_transform": (p11, _P11), "p12_oscillatory_events": (p12, None),
}
