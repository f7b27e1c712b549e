"""Vectorised hashing of words and shingles over batches of UTF-8 texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
#: Multipliers and byte codes of two independent hashes.
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (20240501, 20240502)]
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, modulo 2^64."""
    if which not in _POW or len(_POW[which][0]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _P[which], np.uint64)
        p[0] = 1
        q = np.full(size, pow(_P[which], -1, 1 << 64), np.uint64)
        q[0] = 1
        _POW[which] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW[which]


def prefix(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums s[i] over buf[:i] of byte code times power; see span_hash()."""
    p, _ = powers(len(buf) + 1, which)
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(_BYTES[which][buf] * p[: len(buf)], out=s[1:])
    return s


def span_hash(s: np.ndarray, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of buf[a:b], equal for equal bytes wherever they stand."""
    _, q = powers(len(s), which)
    return mix((s[b] - s[a]) * q[a] + (b - a).astype(np.uint64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and where each text's words begin.

    Words are runs of bytes that are not ASCII white space.
    """
    joined = b" ".join(texts).lower()
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ws = np.empty(len(buf) + 2, bool)
    ws[0] = ws[-1] = True
    ws[1:-1] = _WS[buf]
    edge = np.flatnonzero(ws[1:] != ws[:-1])
    a, b = edge[::2], edge[1::2]
    h = span_hash(prefix(buf), a, b)
    offsets = np.zeros(len(texts) + 1, np.int64)
    offsets[1:] = np.searchsorted(a, ends, side="left")
    return h, offsets


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text as 64-bit hashes; with fewer words, the whole sequence as one."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        h, off = words_of(group)
        for i in range(len(group)):
            w = h[off[i] : off[i + 1]]
            n = len(w)
            if n == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            m = min(k, n)
            x = np.full(n - m + 1, m, np.uint64)
            for j in range(m):
                x = mix(x * U(0xD6E8FEB86659FD93) + w[j : n - m + 1 + j])
            out.append(np.unique(x))

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= 1 << 20:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out
