"""Signal kernels in numpy: filters, analytic signal, tapers, spectra, wavelets. One chunk or group at a time."""

from __future__ import annotations

import math

import numpy as np

# --- filters ------------------------------------------------------------------------------------------------------


def butterworth(order: int, cut, kind: str, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth filter; kind is low, high or band."""
    kind = kind.lower().removesuffix("pass")
    warped = 2 * fs * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "low":
        poles, zeros = warped[0] * poles, np.zeros(0)
    elif kind == "high":
        poles, zeros = warped[0] / poles, np.zeros(order)
    elif kind == "band":
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros = np.concatenate([half + root, half - root]), np.zeros(order)
    else:
        raise ValueError(f"unknown kind of filter: {kind}")
    poles = (2 * fs + poles) / (2 * fs - poles)
    zeros = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(poles) - len(zeros))])
    # unit gain in the middle of the pass band
    at = {"low": 0.0, "high": np.pi}.get(kind, 2 * math.atan(math.sqrt(warped[0] * warped[-1]) / (2 * fs)))
    z = np.exp(1j * at)
    gain = np.prod(np.abs(z - poles)) / np.prod(np.abs(z - zeros))
    return _sections(zeros, poles, gain)


def _sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Group conjugate poles (and real ones two by two) and give each group two zeros."""
    upper = sorted(poles[poles.imag > 1e-12], key=lambda p: -abs(p))
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    groups = [[p, p.conjugate()] for p in upper] + [real[i : i + 2] for i in range(0, len(real), 2)]
    high, low = list(zeros[zeros.real > 0]), list(zeros[zeros.real <= 0])
    out = []
    for g in groups:
        z = []
        while len(z) < len(g):  # alternate, so that a band filter has a zero at either end in each section
            z.append((high if high and (len(z) % 2 == 0 or not low) else low).pop())
        out.append((np.real(np.poly(z)), np.real(np.poly(g))))
    b, a = out[0]
    out[0] = (b * gain, a)
    return [(np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))) for b, a in out]


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, block: int = 256) -> np.ndarray:
    """One section along x from its steady state for x[0]: the state space in blocks instead of sample by sample."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    state = np.linalg.solve(np.eye(2) - step, into) * x[0]
    n = len(x)
    rows = -(-n // block)
    padded = np.zeros(rows * block)
    padded[:n] = x
    padded = padded.reshape(rows, block)
    powers = np.empty((block + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(block):
        powers[k + 1] = powers[k] @ step
    response = np.concatenate([[b[0]], (powers[: block - 1] @ into)[:, 0]])
    lag = np.arange(block)[:, None] - np.arange(block)
    forced = padded @ np.where(lag >= 0, response[np.abs(lag)], 0.0).T
    reach = powers[block - 1 :: -1][:block] @ into  # what each sample leaves in the state at the block's end
    left = padded @ reach
    states = np.empty((rows, 2))
    for r in range(rows):
        states[r] = state
        state = powers[block] @ state + left[r]
    return (forced + states @ powers[:block, 0, :].T).ravel()[:n]


def _odd_pad(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n else x


def settling(order: int, cut, kind: str, fs: float, family: str = "butter", left: float = 1e-18) -> int:
    """Samples after which no more than ``left`` of an edge remains in :func:`zero_phase`, and at least its padding."""
    if family.lower() == "fir":
        return 3 * order + 1
    slowest = max(np.abs(np.roots(a)).max() for _, a in butterworth(order, cut, kind, fs))
    return math.ceil(math.log(left) / math.log(slowest)) + 6 * (order + 1) if 0 < slowest < 1 else 6 * (order + 1)


def zero_phase(x: np.ndarray, order: int, cut, kind: str, fs: float, family: str = "butter") -> np.ndarray:
    """Filter forwards and backwards with odd padding at both ends; the result has the input's length."""
    family = family.lower()
    if family == "fir":
        taps = windowed_sinc(order, cut, kind, fs)
        run = lambda v: np.convolve(np.concatenate([np.full(len(taps) - 1, v[0]), v]), taps, "valid")
        pad = 3 * len(taps)
    elif family in ("butter", "butterworth"):
        sections = butterworth(order, cut, kind, fs)
        pad = 3 * (order * (2 if kind.lower().startswith("band") else 1) + 1)

        def run(v):
            for b, a in sections:
                v = _section(b, a, v)
            return v

    else:
        raise ValueError(f"unknown family of filters: {family}")
    if len(x) <= pad:
        raise ValueError("the signal is shorter than the padding")
    out = _odd_pad(np.asarray(x, float), pad)
    for _ in range(2):
        out = run(out)[::-1]
    return out[pad : len(out) - pad]


def windowed_sinc(n: int, cut, kind: str, fs: float) -> np.ndarray:
    """FIR taps by the window method (Hamming), with unit gain in the middle of the (first) pass band."""
    kind = kind.lower().removesuffix("pass")
    cuts = np.atleast_1d(np.asarray(cut, float)) / (fs / 2)
    edges = {"low": [0, *cuts], "high": [*cuts, 1], "band": [*cuts], "bandstop": [0, cuts[0], cuts[-1], 1]}[kind]
    if n % 2 == 0 and edges[-1] == 1:
        raise ValueError("a filter that passes the highest frequency needs an odd number of taps")
    m = np.arange(n) - (n - 1) / 2
    taps = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in zip(edges[::2], edges[1::2], strict=True)) * np.hamming(n)
    middle = 0.0 if edges[0] == 0 else 1.0 if edges[1] == 1 else (edges[0] + edges[1]) / 2
    return taps / np.sum(taps * np.cos(np.pi * m * middle))


def magnitude_response(cut, kind: str, fs: float, order: int, points: np.ndarray, total: int, family: str = "butter") -> tuple[np.ndarray, np.ndarray]:
    """Frequency and gain of the filter at points k / total of the way to the Nyquist frequency."""
    w = np.pi * points / total
    z = np.exp(-1j * w)
    if family == "fir":
        gain = np.abs(np.polyval(windowed_sinc(order, cut, kind, fs)[::-1], z))
    else:
        gain = np.abs(np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in butterworth(order, cut, kind, fs)], axis=0))
    return w * fs / (2 * np.pi), gain


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal: negative frequencies off, positive ones doubled."""
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)


# --- tapers and spectra ---------------------------------------------------------------------------------------------


def slepian(n: int, half_bandwidth: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers (count, n) of unit energy and their concentrations.

    They are eigenvectors of a symmetric tridiagonal matrix: dense for short windows, else by bisection on Sturm counts
    and inverse iteration, for all tapers at once.
    """
    w = half_bandwidth / n
    k = np.arange(n)
    diagonal = ((n - 1 - 2 * k) / 2) ** 2 * math.cos(2 * math.pi * w)
    beside = k[1:] * (n - k[1:]) / 2
    if n <= 1024:
        _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        tapers = vectors[:, ::-1][:, :count].T
    else:
        tapers = _largest_vectors(diagonal, beside, count)
    for i, t in enumerate(tapers):
        first = t.sum() if i % 2 == 0 else t[np.argmax(np.abs(t) > 1e-8)]
        if first < 0:
            tapers[i] = -t
    m = 1 << int(2 * n - 1).bit_length()
    spectrum = np.abs(np.fft.rfft(tapers, m)) ** 2
    auto = np.fft.irfft(spectrum, m)[:, :n]
    kernel = np.concatenate([[2 * w], 4 * w * np.sinc(2 * w * k[1:])])
    return tapers, auto @ kernel


def _largest_vectors(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = np.full(count, (d - reach).min()), np.full(count, (d + reach).max())
    square = e * e
    for _ in range(70):
        middle = (low + high) / 2
        q, above = d[0] - middle, np.zeros(count)
        above += q > 0
        for i in range(1, len(d)):
            q = d[i] - middle - square[i - 1] / np.where(q == 0, 1e-300, q)
            above += q > 0
        enough = above > np.arange(count)
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    shift = (low + high) / 2
    v = np.random.default_rng(0).normal(size=(count, len(d)))
    for _ in range(3):
        diagonal = d[None, :] - shift[:, None]
        factor, right = np.empty_like(v), v.copy()
        factor[:, 0] = diagonal[:, 0]
        for i in range(1, len(d)):
            f = e[i - 1] / np.where(factor[:, i - 1] == 0, 1e-300, factor[:, i - 1])
            factor[:, i] = diagonal[:, i] - f * e[i - 1]
            right[:, i] -= f * right[:, i - 1]
        v[:, -1] = right[:, -1] / np.where(factor[:, -1] == 0, 1e-300, factor[:, -1])
        for i in range(len(d) - 2, -1, -1):
            v[:, i] = (right[:, i] - e[i] * v[:, i + 1]) / np.where(factor[:, i] == 0, 1e-300, factor[:, i])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def detrended(windows: np.ndarray, how: str) -> np.ndarray:
    if how == "off":
        return windows
    out = windows - windows.mean(axis=1, keepdims=True)
    if how == "linear":
        t = np.arange(windows.shape[1]) - (windows.shape[1] - 1) / 2
        out = out - (out @ t / (t @ t))[:, None] * t
    return out


def multitaper(windows: np.ndarray, fs: float, tapers: np.ndarray, concentration: np.ndarray, nfft: int, keep: np.ndarray, detrend: str, weighting: str) -> np.ndarray:
    """One-sided power per window (rows) and kept frequency; windows of zeros give 0, with missing samples NaN."""
    out = np.zeros((len(windows), int(keep.sum())))
    missing, zero = np.isnan(windows).any(axis=1), (windows == 0).all(axis=1)
    out[missing] = np.nan
    use = ~missing & ~zero
    if not use.any():
        return out
    x = detrended(windows[use], detrend)
    power = np.abs(np.fft.rfft(x[:, None, :] * tapers, nfft)) ** 2
    if weighting == "adapt":
        variance = (x * x).mean(axis=1)[:, None]
        spread = (1 - concentration)[None, :] * variance
        estimate = power[:, :2].mean(axis=1)
        for _ in range(3):
            b = estimate[:, None, :] / (estimate[:, None, :] * concentration[None, :, None] + spread[:, :, None])
            weight = b**2 * concentration[None, :, None]
            estimate = (weight * power).sum(axis=1) / weight.sum(axis=1)
    else:
        weight = concentration / len(concentration) if weighting == "eigen" else np.full(len(concentration), 1 / len(concentration))
        estimate = np.einsum("wkf,k->wf", power, weight)
    sides = np.full(nfft // 2 + 1, 2.0)
    sides[0] = 1
    if nfft % 2 == 0:
        sides[-1] = 1
    out[use] = (estimate * sides / fs)[:, keep]
    return out


#: Half the support of the mother wavelet, in its own time.
SUPPORT = 8.0


def morlet(time: np.ndarray, gaussian_width: float, window_length: float) -> np.ndarray:
    """Complex Morlet mother wavelet: a plane wave of ``window_length`` cycles a unit of time under a normalised Gaussian."""
    envelope = np.exp(-np.square(time) / gaussian_width) / (np.pi * gaussian_width) ** 0.25
    return envelope * np.exp(2j * np.pi * window_length * time)


def morlet_bank(freqs, fs: float, gaussian_width: float = 1.5, window_length: float = 1.0) -> list[np.ndarray]:
    """Kernels whose convolution with a signal correlates it with the wavelet at each frequency, all of one length.

    A kernel at scale s (samples a unit of the wavelet's time) holds the conjugate wavelet at the samples' own times, last one
    first, within ``SUPPORT`` of its middle. Tables of the wavelet with a finite step move its times by a step at most.
    """
    freqs = np.atleast_1d(np.asarray(freqs, float))
    sizes = np.array([fs, gaussian_width, window_length, *freqs.ravel()], float)
    if freqs.ndim != 1 or not freqs.size or not np.isfinite(sizes).all() or (sizes <= 0).any():
        raise ValueError("frequencies, rate and widths have to be positive")
    scales = fs * window_length / freqs
    counts = np.floor(2 * SUPPORT * scales).astype(int) + 1
    out = np.zeros((len(freqs), counts.max()), complex)
    for row, scale, n in zip(out, scales, counts, strict=True):
        before = (len(row) - n) // 2
        row[before : before + n] = np.conj(morlet(np.arange(n - 1, -1, -1) / scale - SUPPORT, gaussian_width, window_length))
    return list(out)


def wavelet_scale(freqs, fs: float, norm: str | None) -> np.ndarray:
    if norm not in ("l1", "l2", None):
        raise ValueError("norm is l1, l2 or none")
    f = np.asarray(freqs, float)
    return {"l1": f / fs, "l2": np.sqrt(f) / fs, None: np.ones(len(f))}[norm]
