"""Statistical kernels in numpy: t tails, the signed-rank test, resampled intervals."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, evaluated by Lentz's method."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - value, value)


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(np.broadcast(t, df).shape, np.nan)
    t, df = np.broadcast_to(t, out.shape), np.broadcast_to(df, out.shape)
    ok = np.isfinite(t) & (df > 0)
    out[ok] = incomplete_beta(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    out[np.isinf(t) & (df > 0)] = 0.0
    return out


def correlation_p(r, n) -> np.ndarray:
    """Two-sided p of a correlation of n pairs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share their mean."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return ((last - count + 1 + last) / 2)[inverse]


def signed_rank(difference: np.ndarray) -> tuple[float, float]:
    """Wilcoxon's smaller rank sum and its two-sided p; zeros are dropped.

    Exact by counting subsets of ranks for up to 50 differences without ties or zeros, else the normal approximation
    with the variance corrected for ties.
    """
    d = difference[np.isfinite(difference)]
    had_zeros = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if not n:
        return math.nan, math.nan
    r = ranks(np.abs(d))
    _, ties = np.unique(r, return_counts=True)
    return signed_rank_p(n, float(r[d > 0].sum()), had_zeros, float((ties.astype(float) ** 3 - ties).sum()))


def signed_rank_p(n: int, plus: float, had_zeros: bool, ties: float) -> tuple[float, float]:
    """The same from the count of non-zero differences, the positive ones' rank sum and the sum of t^3 - t over ties."""
    if not n:
        return math.nan, math.nan
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not had_zeros and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return w, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else math.nan


def paired_t(difference: np.ndarray) -> tuple[float, float]:
    d = difference[np.isfinite(difference)]
    n = len(d)
    if n < 2 or d.std(ddof=1) == 0:
        return math.nan, math.nan
    t = d.mean() / (d.std(ddof=1) / math.sqrt(n))
    return float(t), float(t_two_sided(t, n - 1))


def bootstrap(data: np.ndarray, statistic: str, draws: int, seed: int) -> np.ndarray:
    """The statistic ('median' or 'mean') of resamples with replacement, a bounded block of draws at a time."""
    rng, of = np.random.default_rng(seed), np.median if statistic == "median" else np.mean
    step = max(1, 1_000_000 // max(len(data), 1))
    return np.concatenate([of(data[rng.integers(0, len(data), (min(step, draws - a), len(data)))], axis=1) for a in range(0, draws, step)])


def part_counts(n: int, part: int, size: int, draws: int, seed: int) -> np.ndarray:
    """How many rows of each resample of ``n`` rows fall in a part, when all parts but the last hold ``size`` rows.

    The resample is dealt down a binary tree of parts, at each node by a binomial number that depends on seed and node alone. So
    each part finds its own numbers, and those of all parts add up to ``n``: a multinomial law, exactly.
    """
    low, high, node, counts = 0, -(-n // size), 1, np.full(draws, n)
    rows = lambda a, b: min(b * size, n) - a * size
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, 0, node]).binomial(counts, rows(low, middle) / rows(low, high))
        if part < middle:
            high, counts, node = middle, left, 2 * node
        else:
            low, counts, node = middle, counts - left, 2 * node + 1
    return counts


def part_sums(data: np.ndarray, counts: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Sums of as many values of a part as each resample has there, drawn with replacement, some resamples at a time."""
    rng, sums, ends, a = np.random.default_rng([seed, 1, part]), np.zeros(len(counts)), np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000, side="right")))
        owner = np.repeat(np.arange(b - a), counts[a:b])
        sums[a:b] = np.bincount(owner, data[rng.integers(0, len(data), len(owner))], b - a)
        a = b
    return sums


def median_places(n: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) of the two values whose mean is a resample's median, among the n sorted values, for each draw.

    A resample picks the places floor(n U) of n uniform numbers, so its middle values sit at floor(n V) of the middle order
    statistics V, which are beta distributed; the upper of two follows from the lower.
    """
    rng, m = np.random.default_rng(seed), (n + 1) // 2
    low = rng.beta(m, n + 1 - m, draws)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - m, draws)
    return tuple(np.minimum((v * n).astype(np.int64), n - 1) for v in (low, high))
