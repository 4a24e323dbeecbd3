"""Hashed word shingles of whole texts: numpy kernels that run inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_POWERS = np.ones(1, np.uint64)
#: Texts are hashed together up to so many bytes; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 1024), 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word ``[^\\x20\\x09-\\x0D]+``; ASCII letters should be lower-case already."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    length = last - first
    values = _BYTES[raw[inside]]
    starts = np.cumsum(length) - length
    at = np.arange(len(values)) - np.repeat(starts, length)
    total = np.add.reduceat(values * _powers(int(length.max()))[at], starts)
    return mix(total ^ mix(length.astype(np.uint64))), first


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    With fewer words than ``words`` the whole sequence is one shingle; without words or text the set is empty.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode().lower()
        if group and held + len(data) > CHUNK_BYTES:
            out += _sets(group, words)
            group, held = [], 0
        group.append(data)
        held += len(data) + 1
    return out + _sets(group, words)


def _sets(group: list[bytes], words: int) -> list[np.ndarray]:
    if not group:
        return []
    hashes, first = word_hashes(b" ".join(group))
    ends = np.cumsum([len(x) + 1 for x in group])
    cuts = np.searchsorted(first, ends)
    full = hashes.copy()[: max(len(hashes) - words + 1, 0)]
    for j in range(1, words):
        full = mix(full * U(0x9E3779B97F4A7C15) + hashes[j : j + len(full)])
    out, a = [], 0
    for b in cuts.tolist():
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            h = hashes[a : a + 1]
            for j in range(a + 1, b):
                h = mix(h * U(0x9E3779B97F4A7C15) + hashes[j : j + 1])
            out.append(mix(h ^ U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
