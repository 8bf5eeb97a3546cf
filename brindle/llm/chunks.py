"""White-space chunks of texts with numpy, and a worker's cache of what each chunk maps to."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spread(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of all texts between ASCII white space, the chunk of each place, and the
    places at which each text begins, with the end of the last."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    coded = split.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)


class Rows:
    """chunk -> row of a float array, computed for new chunks in batches; starts anew when full."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, most: int = 200_000):
        self.compute, self.width, self.most = compute, width, most
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, width))

    def of(self, chunks: list[str]) -> np.ndarray:
        if len(self.at) + len(chunks) > self.most:
            self.at = {}
        new = [c for c in chunks if c not in self.at]
        if new:
            first = len(self.at)
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.rows[first + i : first + i + len(part)] = self.compute(part)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
        return self.rows[[self.at[c] for c in chunks]]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs ends[i] : ends[i + 1] of the first axis; an empty run is zero."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]))
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, ends[:-1][full], axis=0)
    return out
