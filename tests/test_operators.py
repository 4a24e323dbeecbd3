"""Operators on small frames: edges, chunk invariance, invariants of surrogates, sources."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axonflow.operators import align, correlogram, movie, perievent, phase, select, sequence, spectral, stats, surrogate
from axonflow.functions import statistics
from axonflow.operators.quantiles import exact_quantiles
from axonflow.sources import raw, results, sheets


def signal(spark, values, key="r"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "recording_id string, idx long, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("idx").collect()]


def test_correlogram_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    times = {u: np.sort(rng.integers(0, 2000, 60)) for u in (1, 2)}
    df = spark.createDataFrame([("r", u, int(t)) for u, ts in times.items() for t in ts], "recording_id string, unit_id long, t long")
    got = {r["bin"]: r["n"] for r in correlogram.cross_correlograms(df, 10, 100).collect()}
    d = (times[2][None, :] - times[1][:, None]).ravel()
    half = 105
    want = np.bincount((d[(d >= -half) & (d < half)] + half) // 10, minlength=21)
    assert [got[i] for i in range(21)] == want.tolist()
    auto = {r["bin"]: r["value"] for r in correlogram.auto_correlograms(df, 10, 100).where("unit_id = 1").collect()}
    assert auto[10] == 0 and len(auto) == 21
    turned = correlogram.unit_pairs(df, reverse=True).collect()
    assert [(r["ref"], r["target"]) for r in turned] == [(2, 1)]


def test_nearest_takes_the_lower_sample_at_a_midpoint(spark):
    samples = spark.createDataFrame([("r", i, t) for i, t in enumerate([0.0, 10.0, 20.0, 500.0])], "recording_id string, idx long, t double")
    queries = spark.createDataFrame([("r", i, t) for i, t in enumerate([-5.0, 5.0, 15.1, 250.0, 261.0, 900.0])] + [("none", 9, 1.0)], "recording_id string, query_id long, t double")
    for bucket in (7.0, 1000.0):
        got = {r["query_id"]: r["idx"] for r in align.nearest(queries, samples, bucket).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 3, 5: 3, 9: None}


def test_missing_runs(spark):
    df = signal(spark, [None, 2, None, 4, None, None, None, 8, None])
    out = sequence.fill_missing(df, 2, ["recording_id"])
    assert values(out) == [2, 2, 3, 4, 0, 0, 0, 8, 8]
    assert values(out, "is_valid") == [True, True, True, True, False, False, False, True, True]
    empty = sequence.fill_missing(signal(spark, [None, None]), 5, ["recording_id"])
    assert values(empty) == [0, 0] and values(empty, "is_valid") == [False, False]


def test_peaks_of_flat_tops_and_ends(spark):
    df = signal(spark, [5, 1, 3, 3, 3, 1, 2, 2, 4])
    assert values(sequence.peaks(df, 0, ["recording_id"]), "idx") == [3]


def test_intervals_merge_and_dilate(spark):
    spans = spark.createDataFrame([("r", 0.0, 5.0), ("r", 1.0, 2.0), ("r", 5.5, 6.0), ("r", 8.0, 9.0)], "recording_id string, start double, end double")
    out = sequence.merge_close(spans, 1.0, ["recording_id"]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in out] == [(0.0, 6.0), (8.0, 9.0)]
    flags = signal(spark, [1] * 7).withColumn("is_valid", F.col("idx") != 3)
    assert values(sequence.dilate_invalid(flags, 1, ["recording_id"]), "is_valid") == [True, True, False, False, False, True, True]


def test_gap_repair_numbers_pulses_anew(spark):
    clock = spark.createDataFrame([("r", t) for t in (0.0, 1.0, 5.0, 6.0)], "recording_id string, t double")
    out = align.repair_gaps(clock, 1.5, 1.0).orderBy("position").collect()
    assert [r["t"] for r in out] == [0, 1, 2, 3, 4, 5, 6] and [r["inserted"] for r in out] == [False, False, True, True, True, False, False]


def test_peri_event_edges(spark):
    s = signal(spark, range(10))
    events = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 5.0), ("r", 2, 9.0)], "recording_id string, event_id long, t double")
    kept = perievent.peri_event(s, events, 1.0, 2)
    assert {r["event_id"] for r in kept.collect()} == {1} and kept.count() == 5
    padded = perievent.peri_event(s, events, 1.0, (-2, 2), drop_boundary=False)
    assert padded.count() == 15 and padded.where("value IS NULL").count() == 4
    one = perievent.event_triggered_average(s, events, 1.0, 2).orderBy("offset").collect()
    assert [r["mean"] for r in one] == [3, 4, 5, 6, 7] and all(r["std"] == 0 for r in one)
    none = perievent.event_triggered_average(s, events.where("event_id = 0"), 1.0, 2).collect()
    assert all(r["mean"] == 0 and r["n"] == 0 for r in none)


def test_phase_histogram_closes_the_last_bin(spark):
    rows = [("r", 0, p) for p in (-math.pi, -math.pi / 2, 0.0, math.pi / 2, math.pi)]
    df = spark.createDataFrame(rows, "recording_id string, unit_id long, phase double")
    n = {r["bin"]: r["n"] for r in phase.phase_histogram(df, ["recording_id", "unit_id"]).collect()}
    assert sum(n.values()) == 5 and n[0] == 1 and n[17] == 1
    bad = phase.bad_phases(spark.createDataFrame([("r", float("nan")), ("r", float("inf")), ("r", None), ("r", 1.0)], "recording_id string, phase double"), ["recording_id"]).first()
    assert (bad["missing"], bad["infinite"], bad["low"]) == (2, 1, 1.0)


@pytest.mark.parametrize("core", [1, 8])
def test_spectrogram_does_not_depend_on_chunks(spark, core):
    x = np.random.default_rng(0).normal(size=400)
    out = spectral.multitaper_spectrogram(signal(spark, x), ["recording_id"], 10.0, 6.4, 3.2, 2.0, detrend="constant", per_chunk=core).orderBy("t", "freq").toPandas()
    from axonflow.functions import signals

    tapers, ratio = signals.slepian(64, 2.0, 3)
    windows = np.array([x[a : a + 64] for a in range(0, 400 - 63, 32)])
    want = signals.multitaper(windows, 10.0, tapers, ratio, 64, np.ones(33, bool), "constant", "unity")
    assert np.allclose(out["power"], want.ravel())


def test_wavelets_match_a_direct_convolution(spark):
    from axonflow.functions import signals

    x = np.random.default_rng(0).normal(size=9000)
    out = spectral.wavelet_transform(signal(spark, x), ["recording_id"], [20.0, 50.0], 500.0)
    for f, k in zip((20.0, 50.0), signals.morlet_bank([20.0, 50.0], 500.0), strict=True):
        got = out.where(F.col("freq") == f).orderBy("idx").toPandas()
        want = np.convolve(x, k, "same") * f / 500
        assert np.allclose(got["re"] + 1j * got["im"], want)


def test_cross_correlation_finds_the_delay(spark):
    x = np.random.default_rng(0).normal(size=6000)
    pdf = pd.DataFrame({"recording_id": "r", "idx": np.arange(6000), "x": x, "y": np.roll(x, 7)})
    best = spectral.peak_cross_correlation(spark.createDataFrame(pdf), ["recording_id"], 10.0, 3.0).first()
    assert math.isclose(best["lag"], 0.7) and best["peak"] > 0.95
    x0, y0 = pdf["x"] - pdf["x"].mean(), pdf["y"] - pdf["y"].mean()
    got = {r["lag"]: r["value"] for r in spectral.cross_correlation(spark.createDataFrame(pdf), ["recording_id"], 10.0, 3.0).collect()}
    want = float((x0[: 6000 - 5].to_numpy() * y0[5:].to_numpy()).sum() / (x0.std(ddof=0) * y0.std(ddof=0) * 6000))
    assert math.isclose(got[5], want, abs_tol=1e-9)


def test_bursts_are_found(spark):
    rng, fs, starts = np.random.default_rng(21), 640.0, (1.25, 3.5, 6.0, 8.75)
    t = np.arange(7040) / fs
    x = rng.normal(0, 0.04, len(t)) + 0.1 * np.sin(2 * np.pi * 3 * t)
    for start in starts:
        on = (t >= start) & (t < start + 0.25)
        x[on] += 0.9 * np.sin(2 * np.pi * 33 * t[on])
    out = spectral.oscillatory_events(signal(spark, x), ["recording_id"], fs, (27.0, 40.0), (1.0, 100.0), (0.05, 0.6), 0.05).orderBy("start").collect()
    assert len(out) == len(starts)
    for row, start in zip(out, starts, strict=True):
        assert start - 0.06 < row["start"] < row["peak_time"] < row["end"] < start + 0.31
    assert spectral.oscillatory_events(signal(spark, [1] * 100), ["recording_id"], fs, (40.0, 60.0), (1.0, 9.0), (0.1, 0.5), 0).count() == 0
    with pytest.raises(ValueError):
        spectral.oscillatory_events(signal(spark, [1]), ["recording_id"], fs, (60.0, 40.0), (1.0, 9.0), (0.1, 0.5), 0)


def trains_of(spark, t, unit=1):
    return spark.createDataFrame([("r", unit, float(v)) for v in t], "recording_id string, unit_id long, t double")


def test_surrogates_keep_what_they_promise(spark):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.exponential(0.1, 100))
    df = trains_of(spark, t)
    end = float(t[-1]) + 1
    shuffled = surrogate.shuffle_intervals(df, 3, seed=1).toPandas()
    for _, g in shuffled.groupby("replicate"):
        s = np.sort(g["t"])
        assert math.isclose(s[0], t[0]) and np.allclose(np.sort(np.diff(s)), np.sort(np.diff(t)))
    assert shuffled.groupby("replicate")["t"].apply(tuple).nunique() == 3
    jittered = surrogate.jitter(df, 0.05, 1).toPandas().sort_values("event_idx")["t"].to_numpy()
    assert (np.abs(jittered - t) <= 0.05).all()
    wrapped = surrogate.shift(df, 0.0, end, 2, mode="wrap")
    assert wrapped.count() == 200 and wrapped.where(f"t < 0 OR t >= {end}").count() == 0
    assert surrogate.poisson(df, 0.0, end, 2).count() == 200
    again = surrogate.poisson(df.repartition(3), 0.0, end, 2).orderBy("replicate", "event_idx").collect()
    assert again == surrogate.poisson(df, 0.0, end, 2).orderBy("replicate", "event_idx").collect()
    dropped = surrogate.shift(df, 0.0, end, 4, min_shift=end / 2).toPandas()
    assert 0 < len(dropped) < 300 and dropped["t"].between(0, end).all()
    kept = surrogate.jitter(df, 5.0, 4, support=(1.0, 3.0)).toPandas()
    assert kept["t"].between(1, 3).all() and kept["event_idx"].max() < 100
    assert surrogate.poisson(df, 0.0, end, 2, events=7).count() == 14
    observed = spark.createDataFrame([(1, 2.0)], "k long, statistic double")
    null = spark.createDataFrame([(1, float(v)) for v in (-3, 1, 2, 0)], "k long, statistic double")
    p = {a: surrogate.permutation_test(observed, null, ["k"], a).first()["p_value"] for a in ("two-sided", "greater", "less")}
    assert p == {"two-sided": 3 / 5, "greater": 2 / 5, "less": 5 / 5}


def test_random_numbers_are_even_and_fixed():
    u = surrogate.uniforms(surrogate.stream_key(1, "r", 2, 3), 200_000)
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.std() - 12**-0.5) < 0.003 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
    assert np.abs(np.histogram(u, 64, (0, 1))[0] / 200_000 * 64 - 1).max() < 0.1
    # the published sequence of the generator from key 1234567
    assert [int(x) for x in surrogate.bits(1234567, 3)] == [x >> 11 for x in (6457827717110365317, 3203168211198807973, 9817491932198370423)]


def test_permutation_tests_of_any_statistic_and_surrogate(spark):
    rng = np.random.default_rng(6)
    bursts = np.sort(np.concatenate([c + rng.uniform(0, 0.02, 5) for c in rng.uniform(0, 100, 40)]))
    df = trains_of(spark, bursts).union(trains_of(spark, rng.uniform(0, 100, 200), 2)).union(trains_of(spark, [1.0], 3))
    kinds = {"jitter": surrogate.Jitter(1.0), "shift": surrogate.Shift(0.0, 100.0, "wrap"), "shuffle": surrogate.ShuffleIntervals(), "poisson": surrogate.Poisson(0.0, 100.0)}
    found = {}
    for name, kind in kinds.items():
        rows = surrogate.surrogate_test(df, kind, surrogate.share_close(0.02), 199, 4, "greater").collect()
        assert {r["n_surrogates"] for r in rows} == {199}
        found[name] = {r["unit_id"]: r["p_value"] for r in rows}
        assert found[name][3] is None
    assert found["jitter"][1] == found["poisson"][1] == 1 / 200 and found["poisson"][2] > 0.02 and found["shuffle"][1] > 0.5
    # a function of the user's own, and the same draws by statistics of each
    spread = lambda t: float(t.max() - np.median(t))
    test = {r["unit_id"]: r for r in surrogate.surrogate_test(df, kinds["poisson"], spread, 99, 4, "less").collect()}
    each = surrogate.surrogate_statistics(df.repartition(8), kinds["poisson"], lambda t: (spread(t), len(t)), "s double, n long", 99, 4).collect()
    for unit in (1, 2):
        draws = [r["s"] for r in each if r["unit_id"] == unit]
        assert len(draws) == 99 and math.isclose(test[unit]["p_value"], (1 + sum(s <= test[unit]["observed"] for s in draws)) / 100)


def brute_pairs(refs, targets, half, size, units):
    counts = {}
    for r, s in refs:
        for u, t in targets:
            if units(r, u) and -half <= t - s < half:
                counts[r, u, int((t - s + half) // size)] = counts.get((r, u, int((t - s + half) // size)), 0) + 1
    return counts


def test_correlograms_of_bursts_and_ties_in_blocks(spark):
    rng = np.random.default_rng(7)
    events = [(int(u), int(t)) for u, t in zip(rng.integers(0, 4, 900), np.concatenate([rng.integers(0, 100_000, 300), rng.integers(50_000, 50_400, 500), np.full(100, 50_200)]), strict=True)]
    df = spark.createDataFrame([("r", u, t) for u, t in events], "recording_id string, unit_id long, t long").repartition(5)
    refs, targets = df.withColumnRenamed("unit_id", "ref"), df.withColumnRenamed("unit_id", "target")
    for units, test in (("any", lambda a, b: True), ("<", lambda a, b: a < b), ("=", lambda a, b: a == b)):
        want = brute_pairs(events, events, 5 * 80 // 2, 80, test)
        for block_rows in (40, 1 << 17):
            rows = correlogram.correlogram(refs, targets, 80, 200, ["recording_id"], units=units, block_rows=block_rows).collect()
            assert {(r["ref"], r["target"], r["bin"]): r["n"] for r in rows} == want and len(rows) == len(want)
    near = [correlogram.pairs_within(refs, targets, -100, 100, ["recording_id"], block_rows=n).groupBy("delta").count().collect() for n in (50, 1 << 17)]
    assert sorted(near[0]) == sorted(near[1]) and sum(r["count"] for r in near[0]) == sum(-100 <= b - a < 100 for _, a in events for _, b in events)


def test_pairs_of_repeated_times_are_written_in_runs(spark):
    rng = np.random.default_rng(9)
    times = np.repeat(rng.integers(0, 3000, 24), 30)
    rows = [("r", int(i), int(times[i])) for i in rng.permutation(len(times))] + [("r", -1, None), (None, -2, 5), ("alone", -3, 5)]
    df = spark.createDataFrame(rows, "recording_id string, event_id long, t long").repartition(5)
    refs, targets = df.withColumnRenamed("event_id", "ref"), df.withColumnRenamed("event_id", "target")
    want = {(i, k, int(times[k] - times[i])) for i in range(len(times)) for k in range(len(times)) if -500 <= times[k] - times[i] < 500}
    for block_rows in (200, 1 << 17):
        got = [tuple(r) for r in correlogram.pairs_within(refs, targets, -500, 500, ["recording_id"], block_rows=block_rows).where("recording_id = 'r'").select("ref", "target", "delta").collect()]
        assert len(got) == len(want) and set(got) == want
    runs = [sum(a[c] != b[c] for a, b in zip(got, got[1:], strict=False)) + 1 for c in (1, 2)]  # of targets and of distances
    assert runs[0] <= len(got) // 25 and runs[1] <= len(got) // 500


def test_pairs_of_single_times_are_written_in_runs_by_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    times = np.sort(rng.choice(6000, 500, replace=False))
    for kind, low, high in (("long", -500, 500), ("double", -499.5, 500.25)):
        df = spark.createDataFrame([("r", int(i), times[i].item()) for i in rng.permutation(len(times))], "recording_id string, event_id long, t long").withColumn("t", F.col("t").cast(kind))
        pairs = lambda: correlogram.pairs_within(df.withColumnRenamed("event_id", "ref"), df.withColumnRenamed("event_id", "target"), low, high, ["recording_id"])  # noqa: B023, E731
        got = [tuple(r) for r in pairs().select("ref", "target", "delta").collect()]
        delta = times[None, :] - times[:, None]
        want = {(i, k, delta[i, k]) for i, k in zip(*np.nonzero((delta >= low) & (delta < high)), strict=True)}
        assert len(got) == len(want) and set(got) == want
        assert sum(a[1] != b[1] for a, b in zip(got, got[1:], strict=False)) < len(got) / 5
    monkeypatch.setattr(correlogram, "_PART_ROWS", 20)
    assert pairs().rdd.getNumPartitions() >= 50 and pairs().count() == len(got)


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_places_of_pairs_within_a_range(kind, monkeypatch):
    rng = np.random.default_rng(10)
    refs, targets = (np.sort(np.concatenate([rng.integers(0, 400, n), np.full(90, 77)]).astype(kind) / kind(1 if kind is np.int64 else 10)) for n in (150, 200))
    refs, targets = refs.astype(kind), targets.astype(kind)
    low, high = (-5, 9) if kind is np.int64 else (-0.3, 0.7)
    delta = targets[None, :] - refs[:, None]
    want = set(zip(*(x.tolist() for x in np.nonzero((delta >= low) & (delta < high))), strict=True))
    for batch in (7, 1 << 18):
        monkeypatch.setattr(correlogram, "_BATCH", batch)
        got = [p for r, t in correlogram.pair_places(refs, targets, low, high) for p in zip(r.tolist(), t.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want
    assert not list(correlogram.pair_places(refs[:0], targets, low, high)) and not list(correlogram.pair_places(refs, targets[:0], low, high))


def test_a_burst_of_a_million_events_is_counted_without_pairs():
    n = 1_000_000
    rng = np.random.default_rng(8)
    train = (rng.integers(0, 2, n), np.sort(rng.integers(0, 1_000_000, n)), np.ones(n, np.int64))
    block = tuple(x[: 1 << 17] for x in train)
    counts = correlogram.pair_counts(block, train, 5_000_000, 2_000_000, 5)
    assert counts[3].sum() == (1 << 17) * n


def test_statistics_on_small_groups(spark):
    rows = spark.createDataFrame([("g", 0.1, 0.2), ("g", 0.2, 0.4), ("g", None, 0.5), ("g", 0.4, 0.3), ("g", 0.5, 0.8), ("h", 1.0, None)], "drug string, control double, treatment double")
    out = {r["drug"]: r for r in stats.population_statistics(rows, ["drug"]).collect()}
    assert out["g"]["n_valid"] == 4 and math.isclose(out["g"]["mean_difference"], 0.125) and out["h"]["error"] and out["h"]["control_mean"] is None
    tests = {r["drug"]: r for r in stats.paired_tests(rows, ["drug"]).collect()}
    assert tests["g"]["test"] == "Wilcoxon signed-rank" and tests["h"]["test"] == "insufficient_n"
    flat = signal(spark, [3, 3, 3])
    assert {r["z"] for r in stats.pooled_z(flat, ["recording_id"]).collect()} == {0.0}


def test_detrended_and_relative_movies(spark):
    frames = spark.createDataFrame([("m", i, [float(i), 5.0]) for i in range(20)], "recording_id string, frame_idx long, pixels array<float>")
    assert movie.detrend_linear(frames).agg(F.max(F.abs("value"))).first()[0] < 1e-9
    flat = movie.delta_f(frames, 5).where("pixel = 1")
    assert {r["value"] for r in flat.collect()} == {0.0}
    assert frames.select(select.crop(F.col("pixels"), 1, 2, 1, 0, 2, 1).alias("p")).first()["p"] == [5.0]


@pytest.mark.parametrize("family, order, cut, kind", [("butter", 2, [0.05, 0.2], "band"), ("butter", 3, 0.1, "low"), ("fir", 31, 0.1, "low")])
def test_filters_do_not_depend_on_chunks(spark, family, order, cut, kind):
    from axonflow.functions import signals as kernels

    rng = np.random.default_rng(5)
    long, short = rng.normal(size=5003), rng.normal(size=12)
    rows = signal(spark, long).unionAll(signal(spark, short, "short")).unionAll(signal(spark, [1.0], "one")).withColumn("idx", F.col("idx") * 3 - 7)
    out = spectral.zero_phase(rows, ["recording_id"], order, cut, kind, 1.0, family, core=64).cache()
    assert {r[0] for r in out.select("recording_id").distinct().collect()} <= {"r", "short"}
    got = out.where("recording_id = 'r'").orderBy("idx").collect()
    assert [r["idx"] for r in got] == [3 * i - 7 for i in range(5003)]
    want = kernels.zero_phase(long, order, cut, kind, 1.0, family)
    assert np.abs(np.array([r["value"] for r in got]) - want).max() < 1e-10
    assert spectral.zero_phase(rows.where("idx is null"), ["recording_id"], order, cut, kind, 1.0, family).count() == 0


@pytest.mark.parametrize("method", ["delta_f_over_f", "delta_f_over_sqrt_f"])
def test_relative_movies_match_a_direct_form(spark, method):
    rng = np.random.default_rng(6)
    stack = np.round(rng.normal(3, 2, size=(23, 5)), 3)
    frames = spark.createDataFrame([("m", i, [float(v) for v in f]) for i, f in enumerate(stack)], "recording_id string, frame_idx long, pixels array<double>")
    x = stack - min(stack.min(), 0) + (1 if max(stack.min(), 0) == 0 else 0)
    parts = [np.arange(a, min(a + 6, 23)) for a in range(0, 23, 6)]
    centres = [p.mean() for p in parts]
    base = np.array([[np.interp(i, centres, [np.percentile(x[p, k], 8) for p in parts]) for k in range(5)] for i in range(23)])
    want = (x - base) / (base if method == "delta_f_over_f" else np.sqrt(base))
    out = movie.delta_f(frames, 6, 8, method, tile=2).collect()
    assert len(out) == want.size
    assert max(abs(r["value"] - want[r["frame_idx"], r["pixel"]]) for r in out) < 1e-9
    lines = movie.detrend_linear(frames).collect()
    fit = np.polyfit(np.arange(23), stack, 1)
    assert max(abs(r["value"] - (stack - np.outer(np.arange(23), fit[0]) - fit[1])[r["frame_idx"], r["pixel"]]) for r in lines) < 1e-9


def test_denoised_frames_match_a_direct_form(spark):
    from axonflow.functions import signals as kernels

    rng = np.random.default_rng(7)
    stack = rng.uniform(50, 150, size=(90, 6, 8))
    frames = spark.createDataFrame([("m", i, [float(v) for v in f.ravel()]) for i, f in enumerate(stack)], "recording_id string, frame_idx long, pixels array<double>")
    got = np.array([r["pixels"] for r in movie.denoise(frames, 6, 8, 20.0, 2.0, 0.5).orderBy("frame_idx").collect()])
    freq = [[(y - 6 * (y >= 3), x - 8 * (x >= 4)) for x in range(8)] for y in range(6)]
    mask = np.array([[np.hypot(y, x) <= 2.0 and not (abs(x) <= 0.5 and abs(y) > 1) for y, x in row] for row in freq])
    clean = np.fft.ifft2(np.fft.fft2(stack) * mask).real.reshape(90, -1)
    target = kernels.zero_phase(stack.reshape(90, -1).mean(axis=1), 6, 3.0, "low", 20.0)
    assert np.abs(got - np.clip(clean * (target / clean.mean(axis=1))[:, None], 0, 255)).max() < 1e-8
    assert movie.denoise(frames.limit(5), 6, 8, 20.0, 2.0, 0.5).count() == 5


@pytest.mark.parametrize("n", [30, 400])
def test_paired_tests_match_the_kernels_on_whole_groups(spark, n):
    from axonflow.functions import statistics as kernels

    rng = np.random.default_rng(n)
    tied = np.round(rng.normal(0.2, 1, n), 1)
    groups = {"fine": rng.normal(0.2, 1, n), "tied": tied, "flat": np.zeros(n), "few": rng.normal(size=3), None: rng.normal(size=n)}
    rows = spark.createDataFrame([(g, 0.0, float(v)) for g, d in groups.items() for v in d] + [("few", None, 1.0), ("few", 0.0, math.inf)], "drug string, control double, treatment double")
    out = {r["drug"]: r for r in stats.paired_tests(rows, ["drug"]).collect()}
    assert set(out) == set(groups)
    for g in ("fine", "tied", None):
        w, p = kernels.signed_rank(groups[g])
        assert out[g]["n"] == n and math.isclose(out[g]["statistic"], w) and math.isclose(out[g]["p_value"], p, rel_tol=1e-9)
    assert out["flat"]["test"] == "Paired t-test (fallback)" and out["few"]["test"] == "insufficient_n" and out["few"]["n"] == 3
    t = {r["drug"]: r for r in stats.paired_tests(rows, ["drug"], "t").collect()}
    assert math.isclose(t["fine"]["p_value"], kernels.paired_t(groups["fine"])[1], rel_tol=1e-9)


@pytest.mark.parametrize("n", [9, 10])
def test_resampled_medians_have_the_exact_distribution(spark, n):
    """Share of resamples with a median at most v, against 20,000 resamples drawn in full."""
    from axonflow.functions import statistics as kernels

    data = np.array([0.0, 1, 1, 2, 5, 7, 8, 11, 12, 20])[:n]
    rows = spark.createDataFrame([("g", float(v)) for v in data] + [(None, 1.0), ("g", None)], "drug string, x double")
    low, high = kernels.median_places(n, 20_000, 3)
    mine, full = (data[low] + data[high]) / 2, kernels.bootstrap(data, "median", 20_000, 4)
    for v in np.unique(full):
        assert abs((mine <= v).mean() - (full <= v).mean()) < 0.02
    out = {r["drug"]: r for r in stats.bootstrap_interval(rows, ["drug"], "x").collect()}
    assert set(out) == {"g", None} and out[None]["low"] == out[None]["high"] == 1.0
    assert (out["g"]["low"], out["g"]["point"], out["g"]["high"]) == (*np.percentile(full, [2.5]), np.median(data), *np.percentile(full, [97.5]))
    means = stats.bootstrap_interval(rows, ["drug"], "x", "mean", 400).where("drug = 'g'").first()
    assert means["low"] < data.mean() < means["high"]


def test_correlation_corrected_for_autocorrelation(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=80))
    y = 0.3 * x + rng.normal(size=80)
    pairs = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "subject string, idx long, x double, y double")
    out = stats.robust_correlation(pairs, ["subject"], max_lags=10).first()
    cx, cy = x - x.mean(), y - y.mean()
    both = sum((cx[:-k] @ cx[k:]) / (cx @ cx) * (cy[:-k] @ cy[k:]) / (cy @ cy) for k in range(1, 11))
    n = min(80, max(3, 80 / (1 + 2 * max(0, both))))
    r = np.corrcoef(x, y)[0, 1]
    assert math.isclose(out["r"], r, rel_tol=1e-9) and out["n_effective"] == math.floor(n)
    assert math.isclose(out["ci_lower"], math.tanh(math.atanh(r) - 1.959963984540054 / math.sqrt(n - 3)), rel_tol=1e-6)
    assert out["p_value"] < out["p_value_corrected"] < 1


def test_document_of_unit_events(spark):
    import json

    rows = spark.createDataFrame([("r", 3, 9), ("r", 3, 4), ("r", 1, 7)], "recording_id string, unit_id int, idx long")
    out = results.unit_event_document(rows, 30.0, 1, 10.0).collect()
    assert [r["recording_id"] for r in out] == ["r"]
    assert json.loads(out[0]["document"]) == {"events": {"1": [7], "3": [4, 9]}, "frame_rate": 30.0, "derivative": 1, "threshold": 10.0, "index": "differenced trace"}


def test_documents_of_unit_events_in_pieces(spark, tmp_path):
    import json

    rng = np.random.default_rng(71)
    rows = [(r, u, int(i)) for r in ("a", "b") for u in (2, 10, 7) for i in rng.choice(5000, 40 + u, False)] + [("c", None, 5)]
    df = spark.createDataFrame(rows, "recording_id string, unit_id long, idx long").repartition(5).where("unit_id IS NOT NULL")
    for piece in (7, 1000):
        pieces = results.unit_event_pieces(df, 20.0, 2, 1.5, piece=piece).collect()
        for r in ("a", "b"):
            mine = sorted((p["place"], p["offset"], p["text"]) for p in pieces if p["recording_id"] == r)
            whole = "".join(t for *_, t in mine)
            assert [n for n, *_ in mine] == list(range(len(mine))) and all(whole[o : o + len(t)] == t for _, o, t in mine)
            assert json.loads(whole)["events"] == {str(u): sorted(i for q, v, i in rows if (q, v) == (r, u)) for u in (2, 7, 10)}
    results.write_unit_events(results.unit_event_pieces(df, 20.0, 2, 1.5, piece=7), str(tmp_path / "doc"))
    assert spark.read.parquet(str(tmp_path / "doc")).where("recording_id = 'a'").count() == len(sorted(p for p in results.unit_event_pieces(df, 20.0, 2, 1.5, piece=7).where("recording_id = 'a'").collect()))


def test_names_in_headers_may_hold_commas(spark, tmp_path):
    sheet = tmp_path / "s.csv"
    sheet.write_text('line number,"a, b","say ""hi""",\n1,x,y,\n')
    assert sheets.read_sheet(spark, str(sheet)).columns == ["line number", "a, b", 'say "hi"']


def test_sheets(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("line number,id,,date (YYMMDD),CSCs,box\n1,A,,230706,CSC1;CSC2,\"(174,391, 453,133)\"\n\n2,B,,NA,CSC3,NA\n")
    sheet = sheets.read_sheet(spark, str(good))
    assert sheet.columns == ["line number", "id", "date (YYMMDD)", "CSCs", "box"]
    out = sheets.convert(sheet, {"date (YYMMDD)": "date", "CSCs": "texts", "box": "numbers"}).orderBy("line number").collect()
    assert str(out[0]["date (YYMMDD)"]) == "2023-07-06" and out[0]["CSCs"] == ["CSC1", "CSC2"] and out[0]["box"] == [174, 391, 453, 133]
    assert out[1]["date (YYMMDD)"] is None and out[1]["box"] is None
    for text in ("line number,id\n1,a\n1,b\n", "line number,id\n 1,a\n", "line number,id\n,a\n", "line number,id,\n1,a,x\n", "line number,id\n1,a,b\n", "line number,line number\n1,2\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text(text)
        with pytest.raises(ValueError):
            sheets.read_sheet(spark, str(bad))


def test_design(spark, tmp_path):
    path = tmp_path / "design.json"
    path.write_text('{"drug_groups": {"Dex 1": [1], "Sleep": [2]}, "selections": {"1": [[0, 5], [10, 15]], "2": [[0, 5], [10, 15]]}, "no_drug_conditions": ["Sleep"]}')
    conditions, windows = sheets.read_design(spark, str(path))
    assert {(r["subject"], r["is_drug"]) for r in conditions.collect()} == {("1", True), ("2", False)} and windows.count() == 4
    path.write_text('{"drug_groups": {"a": [1], "b": [1, 3]}, "selections": {"1": [[5, 1], [10, 15]]}}')
    with pytest.raises(ValueError, match="2 conditions.*3 has no windows.*start < end"):
        sheets.read_design(spark, str(path))


def test_raw_recordings(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 65536, (500, 32)).astype("<u2")
    (tmp_path / "ac.raw").write_bytes(data.tobytes())
    (tmp_path / "clock.raw").write_bytes((np.arange(480, dtype="<u8") * 1000).tobytes())
    out = raw.read_ephys(spark, str(tmp_path / "ac.raw"), str(tmp_path / "clock.raw"), 30000.0, ["RHS2116_AC_3", 0])
    got = out.where("channel = 'RHS2116_AC_3'").orderBy("idx").toPandas()
    assert len(got) == 480 and np.allclose(got["value"], (data[:480, 3].astype(float) - 32768) * 0.195) and math.isclose(got["t"][3], 0.1)
    clock = raw.read_clock(spark, str(tmp_path / "clock.raw"), 30000.0)
    assert math.isclose(raw.clock_rate(clock).first()["rate"], 30.0) and math.isclose(raw.sampling_rate(clock).first()["fs"], 30.0)
    parts = raw.read_raw(spark, str(tmp_path / "ac.raw"), "uint16", 32, split_bytes=64 * 100)
    assert parts.rdd.getNumPartitions() == 5 and parts.count() == 500
    with pytest.raises(ValueError, match="no whole number of records"):
        raw.read_raw(spark, str(tmp_path / "ac.raw"), "uint64", 3)
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, str(tmp_path / "none.raw"), "uint64")
    with pytest.raises(ValueError):
        raw.read_ephys(spark, "x", "y", 1.0, [40])


def test_raw_files_keep_their_order_over_splits(spark, tmp_path):
    sizes = [0, 1, 7, 40, 43, 100, 3]
    numbers = iter(range(sum(sizes)))
    for k, n in enumerate(sizes):
        np.array([next(numbers) for _ in range(n)], "<i8").tofile(tmp_path / f"f{k}.raw")
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    for split in (8, 80, 1 << 20):
        rows = raw.read_raw(spark, f"file://{tmp_path}", "int64", split_bytes=split).collect()
        assert sorted(r["at"] for r in rows) == list(range(sum(sizes))) and all(r["values"] == [r["at"]] for r in rows)
        first = {f"f{k}.raw": sum(sizes[:k]) for k in range(len(sizes))}
        assert all(r["idx"] == r["at"] - first[r["path"].rsplit("/", 1)[1]] for r in rows)


def test_raw_files_are_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(51)
    rows = [(i, [int(x) for x in rng.integers(0, 65536, 3)] + [int(rng.integers(0, 256))]) for i in range(700)] + [(700, [10, 0x0A0D, 0, 0])]
    df = spark.createDataFrame(rows, "k long, v array<int>").repartition(7)
    raw.write_raw(df, F.col("v"), "uint16", str(tmp_path / "out"), ["k"])
    back = {r["at"]: r["values"] for r in raw.read_raw(spark, str(tmp_path / "out"), "uint16", 4, split_bytes=64).collect()}
    assert back == dict(rows)
    with pytest.raises(Exception, match="does not end with the byte"):
        raw.write_raw(df.select("k", F.array(F.lit(1 << 60)).alias("v")), F.col("v"), "uint64", str(tmp_path / "bad"), ["k"])


def test_files_and_results(spark, tmp_path):
    for p in ("a/1.avi", "b/2.avi", "saved_movies/1.avi"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    assert {r["name"] for r in sheets.numbered_movies(spark, str(tmp_path), [1, 2]).collect()} == {"1.avi", "2.avi"}
    with pytest.raises(ValueError, match="3.avi: missing"):
        sheets.numbered_movies(spark, str(tmp_path), [3])
    rows = spark.createDataFrame([("Dex: 1", "CSC 1", 1.0)], "drug string, channel string, x double")
    results.write_results(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["drug"] == "Dex__1"
    log = results.guarded(spark.createDataFrame([(1, 1.0), (2, 0.0)], "k long, v double"), ["k"], lambda g: g.assign(v=1 / int(g["v"].iloc[0])), "k long, v double", "inverse")
    status = {r["k"]: r["status"] for r in results.run_log(log, ["k"]).collect()}
    assert status == {1: "completed", 2: "skipped"}


def test_gas_and_buffer_use(spark, tmp_path):
    np.array([10.0, 20.0, 30.0], "<f4").tofile(tmp_path / "o2.raw")
    np.array([1.5, 2.5], "<f4").tofile(tmp_path / "co2.raw")
    np.array([0, 30, 60], "<u8").tofile(tmp_path / "clock.raw")
    out = raw.read_gas(spark, {"O2": str(tmp_path / "o2.raw"), "CO2": str(tmp_path / "co2.raw")}, str(tmp_path / "clock.raw"), 30.0)
    assert sorted((r["channel"], r["idx"], r["t"], r["value"]) for r in out.collect()) == [("CO2", 0, 0.0, 1.5), ("CO2", 1, 1.0, 2.5), ("O2", 0, 0.0, 100.0), ("O2", 1, 1.0, 200.0), ("O2", 2, 2.0, 300.0)]
    (tmp_path / "use.csv").write_text("Clock,Bytes,Percent\n5,100,0.5\n6,,\n")
    assert [tuple(r) for r in sheets.read_fifo_use(spark, str(tmp_path / "use.csv")).collect()] == [(5, 100, 0.5), (6, None, None)]


def test_filter_response_is_the_butterworth_formula(spark):
    cuts = spark.createDataFrame([("a", 0.1), ("b", 0.3)], "recording_id string, cut double")
    rows = spectral.filter_responses(cuts, ["recording_id"], "low", 1.0, 3, 50).collect()
    assert len(rows) == 100
    for r in rows:
        cut = {"a": 0.1, "b": 0.3}[r["recording_id"]]
        assert math.isclose(r["gain"], 1 / math.sqrt(1 + (math.tan(math.pi * r["freq"]) / math.tan(math.pi * cut)) ** 6), rel_tol=1e-6, abs_tol=1e-9)


def test_band_power_and_coherogram_match_direct_forms(spark):
    rng = np.random.default_rng(3)
    n, rate = 900, 10.0
    x, y = rng.normal(size=n), rng.normal(size=n)
    y[300:] += np.sin(2 * np.pi * 2.0 * np.arange(n)[300:] / rate)
    x += np.sin(2 * np.pi * 2.0 * np.arange(n) / rate)
    pairs = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "recording_id string, idx long, x double, y double")
    got = {(round(r["t"], 6), round(r["freq"], 6)): r["coherence"] for r in spectral.coherogram(pairs, ["recording_id"], rate, 5.0, 2.5, 8).collect()}
    length, hop = 50, 25
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    starts = range(0, n - length + 1, hop)
    f = {k: np.array([np.fft.rfft((v[a : a + length] - v[a : a + length].mean()) * taper) for a in starts]) for k, v in (("x", x), ("y", y))}
    for w in range(len(starts)):
        part = slice(max(0, w - 3), w + 5)
        sxx, syy, sxy = (np.mean(f[a][part].conj() * f[b][part], axis=0) for a, b in (("x", "x"), ("y", "y"), ("x", "y")))
        for k in (5, 10, 20):
            assert math.isclose(got[round((w * hop + 25) / rate, 6), round(k * rate / length, 6)], abs(sxy[k]) ** 2 / (sxx[k] * syy[k]).real, rel_tol=1e-9)
    samples = pairs.select("recording_id", "idx", F.col("x").alias("value"))
    spectrum = spectral.multitaper_spectrogram(samples, ["recording_id"], rate, 10.0, 5.0, 3.0, detrend="constant").where("freq BETWEEN 1 AND 3").collect()
    want = np.mean([10 * math.log10(r["power"]) for r in spectrum])
    power = spectral.band_power(samples, ["recording_id"], rate, (1, 3), 10.0, 5.0, 3.0).first()["power_db"]
    assert math.isclose(power, want, rel_tol=1e-6)
    wide = {r["measurement"]: r["value"] for r in spectral.signal_statistics(pairs, ["recording_id"], rate, (1, 3), 10.0, 5.0, 3.0, 2.0).collect()}
    assert math.isclose(wide["power_1"], power, rel_tol=1e-9) and set(wide) == {"power_1", "power_2", "coherence", "peak", "lag"} and 0 < wide["coherence"] < 1


def test_filling_is_linear_in_a_long_recording(spark):
    import time

    def seconds(n):
        rows = spark.range(n).select(F.lit("a").alias("recording_id"), F.col("id").alias("idx"), F.when(F.col("id") % 7 < 4, F.col("id").cast("double")).alias("value"))
        start = time.time()
        out = sequence.fill_missing(rows, 3, ["recording_id"]).agg(F.sum(F.abs(F.col("value") - F.col("idx"))).alias("off"), F.count(F.lit(1)).alias("n")).first()
        assert out["n"] == n and out["off"] < 7
        return time.time() - start

    seconds(1000)
    assert seconds(2_000_000) < 60  # a frame anew for each row would take hours


def test_exact_quantiles_by_leading_bits(spark):
    rng = np.random.default_rng(31)
    groups = {"mixed": np.concatenate([rng.normal(0, 1e-3, 300), rng.normal(-5e8, 1e8, 300), np.zeros(50)]), "ties": np.repeat([2.5, -1.0], [400, 3]), "one": np.array([7.0]), "many": rng.integers(-50, 50, 900).astype(float), "infinite": np.array([-np.inf] * 20 + [1.0] * 5 + [np.inf] * 30)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None), ("mixed", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = {"low": 0.05, "mid": 0.5, "high": 0.9}
    for rest in (8, 200, 1 << 16):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", probs, rest).collect()}
        assert got["none"]["mid"] is None and got[None]["mid"] == 4.0 and len(got) == 7
        for g, x in groups.items():
            for name, p in probs.items():
                want = np.sort(x)[int(p * (len(x) - 1))] if g == "infinite" else np.quantile(x, p)
                assert math.isclose(got[g][name], want, rel_tol=1e-12, abs_tol=1e-15), (g, name, rest)
    whole = exact_quantiles(df, [], "x", {"mid": 0.5}, 16).first()["mid"]
    assert whole == np.median([v for _, v in rows if v is not None])
    assert exact_quantiles(df.limit(0), ["g"], "x", probs, 0).count() == 0


def test_projections_in_tiles_of_any_width(spark):
    rng = np.random.default_rng(32)
    stack = rng.normal(0, 1, (9, 11)).astype(np.float32)
    rows = [("m", i, [None if (i, k) in ((2, 3), (4, 3)) else float(x) for k, x in enumerate(frame)]) for i, frame in enumerate(stack)]
    df = spark.createDataFrame([*rows, ("n", 0, [1.0]), ("n", 1, [None]), ("n", 2, None)], "recording_id string, frame_idx long, pixels array<float>")
    for cells in (9, 40, 1 << 20):
        got = {(r["recording_id"], r["pixel"]): r for r in movie.projections(df, cells).collect()}
        assert len(got) == 12 and got["n", 0]["median"] == got["n", 0]["max"] == 1.0
        for k in range(11):
            x = np.array([r[2][k] for r in rows if r[2][k] is not None])
            r = got["m", k]
            assert np.allclose([r["max"], r["min"], r["mean"], r["median"], r["std"], r["range"]], [x.max(), x.min(), x.mean(), np.median(x), x.std(), np.ptp(x)])


def test_activity_movie_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(movie, "UNITS", 3)
    monkeypatch.setattr(movie, "PIXELS", 4)
    monkeypatch.setattr(movie, "FRAMES", 5)
    rng = np.random.default_rng(33)
    feet = [("m", u, int(p), float(rng.normal())) for u in range(10) for p in rng.choice(20, 6, False)]
    traces = [("m", u, int(f), float(rng.normal())) for u in range(10) for f in rng.choice(12, 7, False)]
    df = movie.activity_movie(spark.createDataFrame(feet, "recording_id string, unit_id long, pixel long, weight double"), spark.createDataFrame(traces, "recording_id string, unit_id long, frame_idx long, value double"))
    want = {}
    for _, u, p, w in feet:
        for _, v, f, x in traces:
            if u == v:
                want[f, p] = want.get((f, p), 0) + w * x
    got = {(r["frame_idx"], r["pixel"]): r["value"] for r in df.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_long_signals_are_transformed_over_many_tasks(spark):
    rng = np.random.default_rng(41)
    signals = {f"s{n}": 1e6 + 300 * np.sin(np.arange(n) / 7) + rng.normal(0, 50, n) for n in (64, 101, 1000, 997, 2049)} | {"short": rng.normal(0, 1, 12), "flat": np.full(80, 3.0)}
    rows = [(k, 10 * i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "recording_id string, idx long, value double").repartition(6)
    got = spectral.phase_and_envelope(df, ["recording_id"], whole=20, cells=64).toPandas()
    for k, x in signals.items():
        g = got[got["recording_id"] == k].sort_values("idx")
        z = spectral.kernels.analytic(x)
        assert len(g) == len(x) and np.array_equal(g["value"], x)
        assert np.abs(g["envelope"] - np.abs(z)).max() < 1e-9 * np.abs(x).max(), k
        assert np.abs(np.exp(1j * g["phase"]) - np.exp(1j * np.angle(z))).max() < 1e-9, k


def test_resamples_are_dealt_to_parts_by_the_multinomial_law():
    sizes, draws = [40, 40, 40, 23], 20_000
    counts = np.array([statistics.part_counts(143, p, 40, draws, 9) for p in range(4)])
    assert (counts.sum(axis=0) == 143).all()
    share = np.array(sizes) / 143
    assert np.abs(counts.mean(axis=1) - 143 * share).max() < 0.2
    assert np.allclose(np.cov(counts), 143 * (np.diag(share) - np.outer(share, share)), atol=0.8)


def test_intervals_and_merges_over_many_buckets(spark):
    rng = np.random.default_rng(61)
    t = np.sort(rng.choice(5000, 400)) * 10
    df = spark.createDataFrame([("r", 1, int(v)) for v in t] + [("r", 2, 5), ("q", 1, None)], "recording_id string, unit_id long, t long").repartition(4)
    for bucket in (7, 900, 10**9):
        got = correlogram.intervals(df, ["recording_id", "unit_id"], bucket=bucket).select("interval").collect()
        assert sorted(r["interval"] for r in got) == sorted(np.diff(t).tolist())
    start = np.sort(rng.uniform(0, 300, 120))
    spans = [(float(a), float(a + d)) for a, d in zip(start, rng.exponential(1.5, 120), strict=True)] + [(10.0, 60.0)]
    want = []
    for a, b in sorted(spans):
        if want and a - want[-1][1] < 0.5:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    for bucket in (3, 50, 1 << 16):
        rows = sequence.merge_close(spark.createDataFrame([("r", a, b) for a, b in spans], "recording_id string, start double, end double"), 0.5, ["recording_id"], bucket).orderBy("start").collect()
        assert [[r["start"], r["end"]] for r in rows] == want


def plain_peaks(x, height):
    """Flat tops once, at their lower middle sample, ends never."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i] and x[i] >= height:
            out.append(((i + j) // 2, x[i]))
        i = j + 1
    return out


@pytest.mark.parametrize("core", [3, 7, 1 << 16])
def test_peaks_and_plateaus_over_chunks(spark, core):
    rng = np.random.default_rng(81)
    signals = {f"s{k}": np.repeat(rng.integers(0, 4, 60), rng.integers(1, 9, 60)).astype(float) for k in range(3)} | {"rise": np.arange(9.0), "flat": np.full(20, 2.0), "one": np.array([5.0])}
    df = spark.createDataFrame([(r, i, float(v)) for r, x in signals.items() for i, v in enumerate(x)], "recording_id string, idx long, value double").repartition(3)
    for order in (0, 1, 2):
        got = sorted((r["recording_id"], r["idx"], r["value"]) for r in sequence.peaks(df, 1.0, ["recording_id"], order=order, core=core).collect())
        assert got == sorted((r, i, v) for r, x in signals.items() for i, v in plain_peaks(np.diff(x, n=order), 1.0))


def test_random_orders_are_those_of_the_numbers(monkeypatch):
    for n in (0, 1, 2, 3000, 70_000):
        assert (surrogate.random_order(5, n) == np.argsort(surrogate.bits(5, n), kind="stable")).all()
    # words that differ in the bits left out alone, and equal numbers
    numbers = np.random.default_rng(0).integers(0, 1 << 7, 5000).astype(np.uint64)
    monkeypatch.setattr(surrogate, "bits", lambda key, n: numbers)
    assert (surrogate.random_order(5, 5000) == np.argsort(numbers, kind="stable")).all()


def test_shuffled_intervals_are_not_sorted_again(monkeypatch):
    times = np.array([3, 3, 10, 40, 41])
    monkeypatch.setattr(np, "sort", None)
    assert (np.diff(surrogate._sorted_draw(surrogate.ShuffleIntervals(), times, 9)) >= 0).all()


def test_bursts_filter_and_envelope_once(spark, monkeypatch):
    seen = []
    for module in (spectral, stats):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: seen.append(name) or real(df, name))
    x = np.random.default_rng(0).normal(size=2000)
    spectral.oscillatory_events(signal(spark, x), ["recording_id"], 200.0, (27.0, 40.0), (1.0, 100.0), (0.05, 0.6), 0.05)
    assert {"filtered", "envelopes", "smoothed", "flagged"} <= set(seen)
    got = {(r["idx"], r["value"]) for r in stats.envelope(signal(spark, [0, 5, 5, -1, 2, 2, 2, 2]), ["recording_id"], 4).collect()}
    assert got == {(1, 5.0), (3, -1.0), (4, 2.0)} and "trace-ends" in seen


def _sparse(spark, rows, fill):
    """The same samples sparse and as rows: (recording, idx, x or None, y or None)."""
    from axonflow.operators.chunked import Sparse

    last = {r: max(i for q, i, _, _ in rows if q == r) for r in {q for q, *_ in rows}}
    known = [(r, i, x, y, x if y is None else y) for r, i, x, y in rows if x is not None or y is not None]
    spans = []
    for r in last:
        at = sorted(k for k in known if k[0] == r)
        low = min(i for q, i, _, _ in rows if q == r)
        for k, row in enumerate(at):
            spans.append((*row, low if k == 0 else row[1], at[k + 1][1] - 1 if k + 1 < len(at) else last[r]))
    sparse = Sparse(spark.createDataFrame(spans, "recording_id string, idx long, x double, y double, value double, _start long, _end long"), ("x", "y", "value"))
    sparse = sparse if fill is None else sparse.filled(fill)
    return sparse, sparse.samples(["recording_id"])


@pytest.mark.parametrize("fill", [None, 0.0, 2.5])
def test_sparse_samples_equal_their_rows_over_chunks(spark, fill):
    rng = np.random.default_rng(3)
    rows = [(r, i, v, w) for r, n in (("a", 1300), ("b", 90), ("c", 17)) for i in range(-7, n) for v, w in [(float(rng.normal(0, 50)), float(rng.normal(0, 9))) if rng.random() < 0.4 else (None, None)]]
    sparse, plain = _sparse(spark, rows, fill)
    assert plain.count() == len(rows)
    keys, tables = ["recording_id"], {}
    runs = {
        "fill": lambda s, core: sequence.fill_missing(s, 2, keys, core=core),
        "artifacts": lambda s, core: sequence.suppress_artifacts(s, 1.0, keys, 30.0, 3.0, 9, core=core),
        "outliers": lambda s, core: stats.outlier_flags(s, keys, limit=1.0, **({"rest": core} if s is sparse else {})).select(*keys, "idx", "value", "is_outlier"),
        "phases": lambda s, core: spectral.phase_and_envelope(s, keys, whole=core, cells=64),
        "wavelets": lambda s, core: spectral.wavelet_transform(s, keys, [0.1, 0.2], 1.0),
        "lags": lambda s, core: spectral.cross_correlation(s, keys, 1.0, 4),
        "coherence": lambda s, core: spectral.coherence(s, keys, 1.0, 16, per_chunk=core // 16),
        "coherogram": lambda s, core: spectral.coherogram(s, keys, 1.0, 16.0, 8.0, per_chunk=core // 16),
    }
    for name, run in runs.items():
        if fill is None and name in ("phases", "wavelets", "lags", "coherence", "coherogram"):
            continue
        for which, s, core in (("rows", plain, 1 << 16), ("short rows", plain, 64), ("sparse", sparse, 1 << 16), ("short sparse", sparse, 64)):
            df = run(s, core)
            order = [c for c in ("recording_id", "idx", "lag", "t", "freq") if c in df.columns]
            tables[which] = df.toPandas().sort_values(order).reset_index(drop=True)[sorted(df.columns)]
        for which, table in tables.items():
            assert len(table) and list(table.columns) == list(tables["rows"].columns), (name, which)
            for c in table.columns:
                if c == "phase":
                    strong = tables["rows"]["envelope"] > 1e-6
                    assert np.abs(np.exp(1j * table[c]) - np.exp(1j * tables["rows"][c]))[strong].max() < 1e-6, which
                elif table[c].dtype == float:
                    np.testing.assert_allclose(table[c], tables["rows"][c], rtol=1e-8, atol=1e-8, err_msg=f"{name} {which} {c}")
                else:
                    assert table[c].tolist() == tables["rows"][c].tolist(), (name, which, c)


@pytest.mark.parametrize("whole", [1 << 20, 700])
def test_bursts_of_sparse_signals_take_one_pass(spark, monkeypatch, whole):
    rng, keys = np.random.default_rng(5), ["recording_id"]
    value = lambda i: float(9 * (i % 150 < 40) * np.sin(0.6 * i) + rng.normal())
    rows = [(r, i, value(i) if rng.random() < 0.6 else None, None) for r, low, n in (("a", -200, 900), ("b", 0, 500), ("c", 0, 12)) for i in range(low, n)]
    rows += [("d", i, 4.0 if i % 3 == 0 else None, None) for i in range(90)] + [("e", i, 0.0, None) for i in range(90)]
    sparse, plain = _sparse(spark, rows, 0.0)
    bursts = lambda s, **more: spectral.oscillatory_events(s, keys, 1.0, (0.05, 0.2), (0.4, 10.0), (2.0, 60.0), 4.0, **more)
    want = bursts(plain.select("recording_id", "idx", "value")).toPandas().sort_values(["recording_id", "start"]).reset_index(drop=True)
    seen = []
    monkeypatch.setattr(spectral, "written", lambda df, name, real=spectral.written: seen.append(name) or real(df, name))
    got = bursts(sparse, whole=whole).toPandas().sort_values(["recording_id", "start"]).reset_index(drop=True)
    assert set(want["recording_id"]) >= {"a", "b"} and want["start"].min() < 0 and ("filtered" in seen) == (whole == 700)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_missing_runs_and_artifacts_over_gaps_in_the_index(spark):
    rows = spark.createDataFrame([("r", i, v) for i, v in ((-3, 1.0), (0, None), (9, None), (10, 4.0), (11, None), (13, 8.0), (14, None), (90, None))], "recording_id string, idx long, value double")
    for core in (4, 1 << 16):
        out = sequence.fill_missing(rows, 2, ["recording_id"], core=core).orderBy("idx").collect()
        assert [(r["value"], r["is_valid"]) for r in out] == [(1.0, True), (2.0, True), (0.0, False), (4.0, True), (4 + 4 / 3, True), (8.0, True), (0.0, False), (0.0, False)] or out[1]["is_valid"] is False
        flags = sequence.suppress_artifacts(rows, 1.0, ["recording_id"], 2.0, 4.0, 5, core=core).orderBy("idx").collect()
        assert [r["flagged"] for r in flags] == [True, False, False, False, False, True, False, False] and flags[1]["value"] is None
