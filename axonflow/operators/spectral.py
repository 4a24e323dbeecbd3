"""Filters, phases, spectrograms, coherence, cross-correlation and wavelets over many recordings at once.

Kernels run on packed chunks: runs of consecutive samples with as many neighbours (halo) on either side as the kernel
needs, so window-local work never needs a whole recording; the halo of a recursive filter is as long as its memory.
Analytic signals, global by nature, are transformed over many tasks where they are long. Products of windows are summed by Spark.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonflow.functions import signals as kernels
from axonflow.functions.scalars import power_to_db
from axonflow.operators import buckets, sequence, transform
from axonflow.operators.chunked import Sparse, by_chunk, chunks, indexed, key_schema, with_moments
from axonflow.sources.scratch import written


def numbered(samples: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Samples numbered without gaps from 0 within each group, as ``idx``."""
    return buckets.numbered(samples, keys, [idx], "_place").withColumn(idx, F.col("_place")).drop("_place")


def zero_phase(samples: DataFrame, keys: list[str], order: int, cut, kind: str, rate: float, family: str = "butter", idx: str = "idx", core: int = buckets.SIZE) -> DataFrame:
    """keys, idx, value: each signal filtered forwards and backwards; signals shorter than the padding give no rows.

    Samples count in order of ``idx``, gaps in it do not matter. A chunk's halo is as long as the filter remembers, so
    that the chunks' values are those of the whole signal to rounding. A missing value makes the values of its chunk
    missing, and of those whose halo holds it.
    """
    halo = kernels.settling(order, cut, kind, rate, family)
    core = max(core, halo)
    kept = samples.select(*keys, F.col(idx).alias("_idx"), F.col("value").cast("double").alias("value"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(row) -> dict:
        x = np.asarray(row.value, float)
        try:
            y = kernels.zero_phase(x, order, cut, kind, rate, family)
        except ValueError:
            return {idx: [], "value": []}
        start = row.chunk * core - row.first
        return {idx: row.at[start : start + core], "value": y[start : start + core]}

    placed = buckets.numbered(kept, keys, ["_idx"], "_n")
    packed = chunks(placed, keys, core, halo, halo, ("value", "_idx"), "_n")
    return by_chunk(packed.withColumnRenamed("_idx", "at"), keys, f"`{idx}` {kinds['_idx']}, value double", run)


def filter_responses(cuts: DataFrame, keys: list[str], kind: str, rate: float, order: int = 2, points: int = 8000, family: str = "butter") -> DataFrame:
    """keys, freq and gain at ``points`` frequencies of the filter with each row's ``cut`` (keys, cut)."""
    rows = cuts.select(*keys, "cut", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))

    def run(batches):
        for pdf in batches:
            for cut, g in pdf.groupby("cut", sort=False):
                freq, gain = kernels.magnitude_response(cut, kind, rate, order, g["_k"].to_numpy(float), points, family)
                yield g[keys].assign(freq=freq, gain=gain)

    return rows.mapInPandas(run, f"{key_schema(cuts, keys)}, freq double, gain double")


#: Signals of so many samples at most are transformed whole, each in a task; longer ones over many tasks.
WHOLE = 1 << 20


def phase_and_envelope(samples: DataFrame | Sparse, keys: list[str], idx: str = "idx", whole: int = WHOLE, cells: int = transform.CELLS) -> DataFrame:
    """keys, idx, value, phase in (-pi, pi] and envelope of the analytic signal.

    A missing value makes all phases and envelopes of its signal missing. Long signals agree with whole ones to rounding.
    """

    def run(row) -> dict:
        z = kernels.analytic(row.value)
        return {idx: row.at, "value": row.value, "phase": np.angle(z), "envelope": np.abs(z)}

    sparse = isinstance(samples, Sparse)
    kept = samples.samples(keys) if sparse else samples
    kept = kept.select(*keys, idx, F.coalesce(F.col("value").cast("double"), F.lit(np.nan)).alias("value"))
    sizes = samples.sizes(keys) if sparse else kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes if sparse else written(sizes, "signal-sizes")
    whole_signals = samples if sparse else kept
    mixed = not sizes.where(F.col("_n") > whole).isEmpty()
    if mixed:
        short = sizes.where(F.col("_n") <= whole).select(*keys).hint("shuffle_hash")
        whole_signals = Sparse(samples.rows.join(short, keys), samples.values, samples.fill) if sparse else kept.join(short, keys)
    packed, columns = indexed(whole_signals, idx)
    short = by_chunk(chunks(packed, keys, None, values=columns, idx=idx), keys, f"{key_schema(kept, [idx, 'value'])}, phase double, envelope double", run)
    if not mixed:
        return short
    kept = kept.join(sizes.where(F.col("_n") > whole).select(*keys).hint("shuffle_hash"), keys)
    long = written(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.max(F.abs("value")).alias("_scale")), "long-signals")
    placed = buckets.numbered(kept, keys, [idx], "_p")
    y = transform.hilbert(placed.select(*keys, "_p", "value"), keys, long, cells)
    met = placed.join(y, [*keys, "_p"])
    return short.unionByName(met.select(*keys, idx, "value", F.atan2("_y", "value").alias("phase"), F.hypot("_y", "value").alias("envelope")))


def _windows(values: np.ndarray, first: int, core_start: int, core: int, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (multiples of ``step`` within the core) and the complete windows there."""
    starts = np.arange(core_start, core_start + core, step)
    starts = starts[(starts >= max(first, 0)) & (starts + length <= first + len(values))]
    return starts, sliding_window_view(values, length)[starts - first] if len(starts) else np.zeros((0, length))


def multitaper_spectrogram(samples: DataFrame, keys: list[str], rate: float, window: float, step: float, time_bandwidth: float, tapers: int | None = None, band: tuple[float, float] | None = None, detrend: str = "linear", weighting: str = "unity", min_nfft: int = 0, per_chunk: int = 32) -> DataFrame:
    """keys, t, freq, power. ``samples``: keys, idx (from 0, without gaps), value; missing values are null.

    Windows start every ``step`` seconds; t is the middle of the window. Each chunk holds ``per_chunk`` of them.
    """
    length, hop = round(window * rate), round(step * rate)
    count = tapers or int(2 * time_bandwidth) - 1
    nfft = max(1 << max(length - 1, 1).bit_length(), 1 << max(min_nfft - 1, 0).bit_length() if min_nfft else 1)
    bank, concentration = kernels.slepian(length, time_bandwidth, count)
    freqs = np.arange(nfft // 2 + 1) * rate / nfft
    low, high = band or (0.0, rate / 2)
    keep = (freqs >= low) & (freqs <= min(high, rate / 2))
    core = per_chunk * hop

    def run(row) -> dict:
        values = np.asarray(row.value, float)
        starts, windows = _windows(values, row.first, row.chunk * core, core, length, hop)
        power = kernels.multitaper(windows, rate, bank, concentration, nfft, keep, detrend, weighting)
        return {"t": np.repeat((starts + round(length / 2)) / rate, keep.sum()), "freq": np.tile(freqs[keep], len(starts)), "power": power.ravel()}

    packed = chunks(samples, keys, core, 0, max(length - hop, 0))
    out = by_chunk(packed, keys, "t double, freq double, power double", run)
    return out.withColumn("power", F.nanvl("power", F.lit(None).cast("double")))


def band_power(samples: DataFrame, keys: list[str], rate: float, band: tuple[float, float], window: float, step: float, time_bandwidth: float) -> DataFrame:
    """keys, power_db: mean of the decibels over all windows and the band's frequencies."""
    spectrum = multitaper_spectrogram(samples, keys, rate, window, step, time_bandwidth, detrend="constant")
    return spectrum.where(F.col("freq").between(*band)).groupBy(*keys).agg(F.avg(power_to_db(F.col("power"))).alias("power_db"))


def _products(rate: float, length: int, hop: int):
    """Frequencies of a Hann window (constant trend removed), and a function: the windows of x and y of a packed row that start within
    [start, start + core), as their starts and their products (pxx, pyy, re, im), each windows by frequencies."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    freqs = np.fft.rfftfreq(length, 1 / rate)
    sides = np.full(len(freqs), 2.0)
    sides[0] = 1
    if length % 2 == 0:
        sides[-1] = 1
    scale = sides / (rate * (taper**2).sum())

    def products(row, start: int, core: int) -> tuple[np.ndarray, dict]:
        starts, x = _windows(np.asarray(row.x, float), row.first, start, core, length, hop)
        _, y = _windows(np.asarray(row.y, float), row.first, start, core, length, hop)
        fx, fy = (np.fft.rfft(kernels.detrended(v, "constant") * taper) for v in (x, y))
        cross = fx.conj() * fy * scale
        return starts, {"pxx": np.abs(fx) ** 2 * scale, "pyy": np.abs(fy) ** 2 * scale, "re": cross.real, "im": cross.imag}

    return freqs, products


def coherence(pairs: DataFrame | Sparse, keys: list[str], rate: float, seconds: float | None = None, per_chunk: int = 64) -> DataFrame:
    """keys, freq, coherence: magnitude-squared coherence over Welch windows, half of which overlap.

    The windows of a chunk are added up where they are.
    """
    length = int(rate * seconds) if seconds else 256
    hop = length - length // 2
    core = per_chunk * hop
    freqs, products = _products(rate, length, hop)

    def run(row) -> dict:
        starts, found = products(row, row.chunk * core, core)
        return {"freq": freqs if len(starts) else freqs[:0]} | {k: v.sum(axis=0) if len(starts) else freqs[:0] for k, v in found.items()}

    parts = by_chunk(chunks(pairs, keys, core, 0, max(length - hop, 0), ("x", "y")), keys, "freq double, pxx double, pyy double, re double, im double", run)
    sums = parts.groupBy(*keys, "freq").agg(*(F.sum(c).alias(c) for c in ("pxx", "pyy", "re", "im")))
    return sums.select(*keys, "freq", ((F.col("re") ** 2 + F.col("im") ** 2) / F.nullif(F.col("pxx") * F.col("pyy"), F.lit(0.0))).alias("coherence"))


def band_coherence(pairs: DataFrame, keys: list[str], rate: float, band: tuple[float, float], seconds: float | None = None) -> DataFrame:
    return coherence(pairs, keys, rate, seconds).where(F.col("freq").between(*band)).groupBy(*keys).agg(F.avg("coherence").alias("coherence"))


def coherogram(pairs: DataFrame | Sparse, keys: list[str], rate: float, window: float = 5.0, step: float = 2.5, average: int = 8, per_chunk: int = 64) -> DataFrame:
    """keys, t, freq, coherence in sliding windows; spectra are averaged over ``average`` windows (-3 .. +4 of 8).

    A chunk has the windows beside its own in its halo, so that no spectrum is shuffled.
    """
    length, hop = int(window * rate), int(step * rate)
    before, after = average // 2 - 1, average // 2
    core = per_chunk * hop
    freqs, products = _products(rate, length, hop)

    def run(row) -> dict:
        start = row.chunk * core
        starts, found = products(row, start - before * hop, core + (before + after) * hop)
        # beyond the first and the last window there is none: the mean is over those that exist
        frames = lambda v: sliding_window_view(np.concatenate([np.zeros((before, *v.shape[1:])), v, np.zeros((after, *v.shape[1:]))]), before + after + 1, axis=0).sum(axis=-1)
        own = (starts >= start) & (starts < start + core)
        n = frames(np.ones(len(starts)))[own, None]
        mean = {k: frames(v)[own] / n for k, v in found.items()}
        t = (starts[own] + length / 2) / rate
        over, under = mean["re"] ** 2 + mean["im"] ** 2, mean["pxx"] * mean["pyy"]
        return {"t": np.repeat(t, len(freqs)), "freq": np.tile(freqs, len(t)), "over": over.ravel(), "under": under.ravel()}

    packed = chunks(pairs, keys, core, before * hop, max(length - hop, 0) + after * hop, ("x", "y"))
    out = by_chunk(packed, keys, "t double, freq double, over double, under double", run)
    return out.select(*keys, "t", "freq", (F.col("over") / F.nullif("under", F.lit(0.0))).alias("coherence"))


def cross_correlation(pairs: DataFrame | Sparse, keys: list[str], rate: float, max_lag: float = 10.0) -> DataFrame:
    """keys, lag (samples), value: normalised cross-correlation; at a positive lag the second signal is delayed.

    ``pairs``: keys, idx (from 0, without gaps), x, y. Means and deviations are global and come first.
    """
    most = int(max_lag * rate + 1e-9)
    scaled, moments = with_moments(pairs, keys, ["x", "y"])
    core = max(4 * most, 1024)
    lags = np.arange(-most, most + 1)

    def run(row) -> dict:
        x = (np.asarray(row.x, float) - row._mean_x) / (row._std_x * row._n + 1e-12)
        y = (np.asarray(row.y, float) - row._mean_y) / (row._std_y + 1e-12)
        start = row.chunk * core
        mine = np.zeros(len(x))
        a, b = max(start - row.first, 0), min(start + core - row.first, len(x))
        mine[a:b] = x[a:b]
        wide = np.concatenate([np.zeros(most), y, np.zeros(most)])
        return {"lag": lags, "value": np.correlate(wide, mine, "valid")}

    parts = by_chunk(chunks(scaled, keys, core, most, most, ("x", "y"), same=moments), keys, "lag int, value double", run)
    return parts.groupBy(*keys, "lag").agg(F.sum("value").alias("value"))


def peak_cross_correlation(pairs: DataFrame, keys: list[str], rate: float, max_lag: float = 10.0) -> DataFrame:
    """keys, peak, lag (seconds): the largest value and the smallest lag that has it."""
    values = cross_correlation(pairs, keys, rate, max_lag)
    best = F.max(F.struct("value", (-F.col("lag")).alias("minus")))
    return values.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.value").alias("peak"), (-F.col("b.minus") / F.lit(rate)).alias("lag"))


def signal_statistics(pairs: DataFrame, keys: list[str], rate: float, band: tuple[float, float], window: float = 60.0, step: float = 3.0, time_bandwidth: float = 3.0, max_lag: float = 10.0, seconds: float | None = None) -> DataFrame:
    """keys, measurement, value: both powers, coherence, peak cross-correlation and its lag, as long rows."""
    power = lambda c, name: band_power(pairs.select(*keys, "idx", F.col(c).alias("value")), keys, rate, band, window, step, time_bandwidth).withColumnRenamed("power_db", name)
    wide = power("x", "power_1").join(power("y", "power_2"), keys).join(band_coherence(pairs, keys, rate, band, seconds), keys).join(peak_cross_correlation(pairs, keys, rate, max_lag), keys)
    return wide.unpivot(keys, ["power_1", "power_2", "coherence", "peak", "lag"], "measurement", "value")


def wavelet_transform(samples: DataFrame | Sparse, keys: list[str], freqs: list[float], rate: float, gaussian_width: float = 1.5, window_length: float = 1.0, norm: str | None = "l1") -> DataFrame:
    """keys, idx, freq, re, im: Morlet coefficients aligned with the samples; chunks with a kernel's halo are exact."""
    bank = kernels.morlet_bank(freqs, rate, gaussian_width, window_length)
    scale, size = kernels.wavelet_scale(freqs, rate, norm), len(bank[0])
    core = max(4096, size)

    def run(row) -> dict:
        x, start = np.asarray(row.value, float), max(row.chunk * core, row.first)
        n = min((row.chunk + 1) * core, row.first + len(x)) - start
        at = start - row.first
        # output i of the aligned convolution reads inputs i - size // 2 .. i + (size - 1) // 2
        wide = np.concatenate([np.zeros(size), x, np.zeros(size)])
        out = []
        for k, s in zip(bank, scale, strict=True):
            full = np.convolve(wide, k, "valid")
            a = size + at + (size - 1) // 2 - (size - 1)
            out.append(full[a : a + n] * s)
        z = np.array(out)
        return {"idx": np.tile(np.arange(start, start + n), len(bank)), "freq": np.repeat(np.asarray(freqs, float), n), "re": z.real.ravel(), "im": z.imag.ravel()}

    packed = chunks(samples, keys, core, size, size)
    return by_chunk(packed, keys, "idx long, freq double, re double, im double", run)


def oscillatory_events(samples: DataFrame | Sparse, keys: list[str], rate: float, band: tuple[float, float], threshold: tuple[float, float], duration: tuple[float, float], min_gap: float, smooth: int = 11, order: int = 2, t_start: float = 0.0, whole: int = WHOLE) -> DataFrame:
    """keys, start, end, power_db, amplitude, peak_time of bursts in a band.

    Band-pass, envelope, boxcar, z-score; samples with lower <= z <= upper form intervals, which are kept by duration
    and then merged when closer than ``min_gap``. Constant signals have none. Sparse signals of up to ``whole`` samples go
    through all steps in a task, in one pass.
    """
    if band[0] >= band[1] or threshold[0] >= threshold[1] or duration[0] >= duration[1] or min_gap < 0 or smooth <= 0:
        raise ValueError("bands have to be ordered, the gap and the window positive")
    steps = (keys, rate, band, threshold, duration, min_gap, smooth, order, t_start)
    if not isinstance(samples, Sparse):
        found = _long_bursts(samples, *steps)
    else:
        sizes = samples.sizes(keys)
        mixed = not sizes.where(F.col("_n") > whole).isEmpty()
        some = lambda kept: Sparse(samples.rows.join(sizes.where(kept).select(*keys).hint("shuffle_hash"), keys), samples.values, samples.fill)
        found = _short_bursts(some(F.col("_n") <= whole) if mixed else samples, *steps)
        if mixed:
            found = found.unionByName(_long_bursts(some(F.col("_n") > whole).samples(keys), *steps))
    return found.select(*keys, "start", "end", power_to_db(F.col("_power")).alias("power_db"), "amplitude", (t_start + F.col("_peak") / rate).alias("peak_time"))


def _short_bursts(samples: Sparse, keys: list[str], rate: float, band: tuple[float, float], threshold: tuple[float, float], duration: tuple[float, float], min_gap: float, smooth: int, order: int, t_start: float) -> DataFrame:
    """keys, start, end, _power, amplitude and _peak (index) of the bursts of signals that fit in a task."""

    def run(row) -> dict:
        out = {name: np.zeros(0) for name in ("start", "end", "_power", "amplitude")} | {"_peak": np.zeros(0, int)}
        x = row.value
        if not x.min() < x.max():
            return out
        try:
            envelope = np.abs(kernels.analytic(kernels.zero_phase(x, order, list(band), "band", rate)))
        except ValueError:  # shorter than the padding
            return out
        wide = np.concatenate([np.zeros(smooth // 2), envelope, np.zeros((smooth - 1) // 2)])
        smoothed = sum(wide[k : k + len(x)] for k in range(smooth)) / smooth
        deviation = smoothed.std()
        if not deviation > 0:
            return out
        z = (smoothed - smoothed.mean()) / deviation
        flags = np.concatenate([[False], (z >= threshold[0]) & (z <= threshold[1]), [False]])
        first, last = np.flatnonzero(flags[1:] & ~flags[:-1]), np.flatnonzero(flags[:-1] & ~flags[1:]) - 1
        start, end = row.at[first] / rate + t_start, row.at[last] / rate + t_start
        kept = (end - start >= duration[0]) & (end - start <= duration[1])
        start, end = start[kept], end[kept]
        new = np.concatenate([[True], ~(start[1:] - end[:-1] < min_gap)])[: len(start)]
        start, end = start[new], end[np.append(new[1:], True)[: len(end)]]
        low, high = np.floor((start - t_start) * rate + 1e-9).astype(int) - row.first, np.ceil((end - t_start) * rate - 1e-9).astype(int) - row.first
        inside = [envelope[i : j + 1] for i, j in zip(low, high, strict=True)]
        peak = row.first + low + np.array([e.argmax() for e in inside], int)
        return {"start": start, "end": end, "_power": np.array([(e**2).mean() for e in inside]), "amplitude": np.array([e.max() for e in inside]), "_peak": peak}

    return by_chunk(chunks(samples, keys, None), keys, "start double, end double, _power double, amplitude double, _peak long", run)


def _long_bursts(samples: DataFrame, keys: list[str], rate: float, band: tuple[float, float], threshold: tuple[float, float], duration: tuple[float, float], min_gap: float, smooth: int, order: int, t_start: float) -> DataFrame:
    """:func:`_short_bursts` of signals of any length."""
    varied = samples.groupBy(*keys).agg(F.var_pop("value").alias("_v")).where("_v > 0").drop("_v")
    # what is read more than once is written, so that filter, transform and boxcar run once each
    filtered = written(zero_phase(samples.join(varied.hint("shuffle_hash"), keys, "left_semi"), keys, order, list(band), "band", rate), "filtered")
    wrapped = written(phase_and_envelope(filtered, keys).select(*keys, "idx", "envelope"), "envelopes")
    smoothed = written(sequence.moving_mean(wrapped.withColumnRenamed("envelope", "value"), smooth, keys), "smoothed")
    moments = smoothed.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).where("_s > 0")
    z = smoothed.join(moments.hint("shuffle_hash"), keys).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s"))
    flagged = written(z.where(F.col("z").between(*threshold)).select(*keys, "idx"), "flagged")
    spans = sequence.mask_intervals(flagged, keys, F.lit(True), rate, t_start)
    spans = sequence.merge_close(sequence.keep_durations(spans, *duration), min_gap, keys)
    low, high = F.floor((F.col("start") - t_start) * rate + 1e-9), F.ceil((F.col("end") - t_start) * rate - 1e-9)
    # Spark does not foresee how many samples the bursts have, and would broadcast them
    inside = spans.withColumn("idx", F.explode(F.sequence(low, high))).join(wrapped.select(*keys, "idx", "envelope").hint("merge"), [*keys, "idx"])
    best = F.max(F.struct("envelope", (-F.col("idx")).alias("m")))
    out = inside.groupBy(*keys, "start", "end").agg(F.avg(F.col("envelope") ** 2).alias("_power"), best.alias("_b"))
    return out.select(*keys, "start", "end", "_power", F.col("_b.envelope").alias("amplitude"), (-F.col("_b.m")).alias("_peak"))
