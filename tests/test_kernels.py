"""Numeric kernels against direct formulas."""

import math

import numpy as np
import pytest

from axonflow.functions import signals, statistics


def direct_filter(sections, x):
    for b, a in sections:
        step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        s = np.linalg.solve(np.eye(2) - step, into) * x[0]
        out = np.empty_like(x)
        for i, v in enumerate(x):
            out[i] = b[0] * v + s[0]
            s = step @ s + into * v
        x = out
    return x


@pytest.mark.parametrize("order,cut,kind", [(2, 5.0, "low"), (3, 5.0, "high"), (2, [4.0, 9.0], "band"), (6, 3.0, "low")])
def test_butterworth_gain_and_recursion(order, cut, kind):
    fs = 50.0
    sections = signals.butterworth(order, cut, kind, fs)
    f, gain = signals.magnitude_response(cut, kind, fs, order, np.array(cut if isinstance(cut, list) else [cut]) / (fs / 2) * 1000, 1000)
    assert np.allclose(f, cut) and np.allclose(gain, math.sqrt(0.5), atol=1e-9)
    x = np.random.default_rng(0).normal(size=1000)
    got = x
    for b, a in sections:
        got = signals._section(b, a, got)
    assert np.allclose(got, direct_filter(sections, x), atol=1e-9)


def test_zero_phase_keeps_a_passed_tone_in_place():
    t = np.arange(2000) / 100
    x = np.sin(2 * np.pi * 2 * t)
    assert np.abs(signals.zero_phase(x, 2, [0.5, 8.0], "band", 100.0) - x)[300:-300].max() < 0.02
    assert np.abs(signals.zero_phase(x, 101, 20.0, "low", 100.0, "fir") - x)[300:-300].max() < 0.02
    with pytest.raises(ValueError):
        signals.zero_phase(x, 2, 1.0, "low", 100.0, "odd")


def test_analytic_envelope_of_a_tone():
    t = np.arange(512) / 64
    z = signals.analytic(np.cos(2 * np.pi * 4 * t))
    assert np.allclose(np.abs(z), 1) and np.allclose(np.angle(z[:4]), 2 * np.pi * 4 * t[:4])


@pytest.mark.parametrize("n", [64, 200])
def test_slepian_tapers(n):
    tapers, ratio = signals.slepian(n, 2.5, 4)
    assert np.allclose(tapers @ tapers.T, np.eye(4), atol=1e-8)
    w, k = 2.5 / n, np.arange(n)
    kernel = np.where(k[:, None] == k, 2 * w, np.sin(2 * np.pi * w * (k[:, None] - k)) / (np.pi * np.where(k[:, None] == k, 1, k[:, None] - k)))
    assert np.allclose([t @ kernel @ t for t in tapers], ratio, atol=1e-8) and ratio[0] > 0.999


def test_slepian_by_bisection_agrees_with_the_dense_form():
    n, k = 300, np.arange(300)
    d, e = ((n - 1 - 2 * k) / 2) ** 2 * math.cos(2 * math.pi * 2 / n), k[1:] * (n - k[1:]) / 2
    dense = np.linalg.eigh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))[1][:, ::-1][:, :3].T
    assert np.allclose(np.abs(signals._largest_vectors(d, e, 3)), np.abs(dense), atol=1e-6)


def test_multitaper_power_of_a_direct_transform():
    rng, fs = np.random.default_rng(1), 64.0
    x = rng.normal(size=(3, 128))
    x[1], x[2, 5] = 0, np.nan
    tapers, ratio = signals.slepian(128, 2.0, 3)
    keep = np.ones(65, bool)
    out = signals.multitaper(x, fs, tapers, ratio, 128, keep, "constant", "unity")
    centred = x[0] - x[0].mean()
    basis = np.exp(-2j * np.pi * np.outer(np.arange(65), np.arange(128)) / 128)
    want = np.mean([np.abs(basis @ (centred * t)) ** 2 for t in tapers], axis=0) / fs
    want[1:-1] *= 2
    assert np.allclose(out[0], want) and (out[1] == 0).all() and np.isnan(out[2]).all()
    assert (signals.multitaper(x[:1], fs, tapers, ratio, 128, keep, "linear", "adapt") > 0).all()


def test_t_tail_and_signed_rank():
    assert math.isclose(float(statistics.t_two_sided(2.0, 10)), 0.07338803, rel_tol=1e-6)
    assert math.isclose(float(statistics.t_two_sided(1.0, 1)), 0.5, rel_tol=1e-9)
    d = np.array([1.0, 2, 3, 4, 5, -6])
    w, p = statistics.signed_rank(d)
    signs = [[(m >> i) & 1 for i in range(6)] for m in range(64)]
    sums = np.array([sum(r for r, s in zip(range(1, 7), x, strict=True) if s) for x in signs])
    assert w == 6 and math.isclose(p, 2 * (sums <= 6).mean())
    assert math.isnan(statistics.signed_rank(np.zeros(3))[1])
    assert 0 < statistics.signed_rank(np.array([1.0, 1, 2, 0, -1]))[1] <= 1


def test_bootstrap_is_reproducible_and_brackets_the_mean():
    x = np.random.default_rng(0).normal(3, 1, 50)
    a, b = statistics.bootstrap(x, "mean", 500, 1), statistics.bootstrap(x, "mean", 500, 1)
    assert (a == b).all() and np.percentile(a, 2.5) < x.mean() < np.percentile(a, 97.5)
