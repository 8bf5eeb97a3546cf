"""Word shingles of whole texts as 64-bit hashes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BUFFER = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BUFFER + 1)
        _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(n - 1, b)]), dtype=U) for b in (BASE, INVERSE)]
    return _powers


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and where they begin; words are runs without ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    gap = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    low = (b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))).astype(U) + U(1)
    power, back = _tables(len(b) + 1)
    total = np.concatenate([[U(0)], np.cumsum(low * power[: len(b)], dtype=U)])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(U)), start


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles (fewer words: the whole sequence as one; none: empty)."""
    with np.errstate(over="ignore"):
        at = 0
        while at < len(texts):
            parts, size, first = [], 0, at
            while at < len(texts) and (not parts or size < BUFFER):
                parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
                size += len(parts[-1]) + 1
                at += 1
            words, start = word_hashes(b" ".join(parts))
            ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in parts]))
            factors = [mix(U(i + 1) * BASE) | U(1) for i in range(k)]
            rolled = sum(words[i : len(words) - k + 1 + i] * f for i, f in enumerate(factors)) if len(words) >= k else words[:0]
            rolled = mix(rolled)
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if hi - lo >= k:
                    yield np.unique(rolled[lo : hi - k + 1])
                elif hi > lo:
                    yield mix(np.array([sum((words[lo + i] * factors[i] for i in range(hi - lo)), U(hi - lo))], U))
                else:
                    yield words[:0]
        assert at == len(texts) and (first if texts else 0) <= at
