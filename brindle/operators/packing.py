"""Packing lengths into blocks, batch by batch, and balanced partitions."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame


def first_fit_decreasing(lengths: list[int], cut: int) -> list[int]:
    """The bin of each length: longest first, each into the first bin with room. Lengths above cut get one of their own."""
    bins: list[int] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, room in enumerate(bins) if room >= lengths[i]), None)
        if at is None:
            at = len(bins)
            bins.append(cut)
        bins[at] -= lengths[i]
        out[i] = at
    return out


def whole_first_fit(lengths: list[int], cut: int) -> list[tuple[int, int, int, int]]:
    """(index, piece, length, bin) of every piece: first the full blocks of each length, a bin each, then what
    remains of all, by first_fit_decreasing(). A length of 0 has no piece."""
    full = [(i, p) for i, n in enumerate(lengths) for p in range(n // cut)]
    rest = [(i, n // cut, n % cut) for i, n in enumerate(lengths) if n % cut]
    bins = first_fit_decreasing([n for _, _, n in rest], cut)
    return [(i, p, cut, b) for b, (i, p) in enumerate(full)] + [(i, p, n, len(full) + b) for (i, p, n), b in zip(rest, bins, strict=True)]


def next_fit(lengths: list[int], cut: int) -> list[int]:
    out, room, at = [], cut, 0
    for n in lengths:
        if out and n > room:
            at, room = at + 1, cut
        room -= n
        out.append(at)
    return out


def karmarkar_karp(lengths: list[int], k: int, equal: bool = False) -> list[int]:
    """The partition of each length by largest differencing: the two most uneven partial partitions meet, large sums against small.
    equal: partitions hold equally many lengths, whose number k must divide; lengths next in size then begin apart."""
    heap: list = []
    if equal and len(lengths) % k:
        raise ValueError(f"{len(lengths)} lengths do not divide into {k} equal parts")
    if equal:
        by_size = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        for at in range(0, len(by_size), k):
            sets = [(lengths[i], [i]) for i in by_size[at : at + k]]
            heapq.heappush(heap, (sets[-1][0] - sets[0][0], at, sets))
    for i, n in enumerate([] if equal else lengths):
        sets = [(n, [i])] + [(0, [])] * (k - 1)
        heapq.heappush(heap, (-n, i, sets))
    tie = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sets = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], tie, sets))
        tie += 1
    out = [0] * len(lengths)
    for j, (_, members) in enumerate(heap[0][2] if heap else []):
        for i in members:
            out[i] = j
    return out


def knapsack(lengths: list[int], cut: int) -> list[int]:
    """The bin of each length by the greedy knapsack: a bin takes the largest length that still fits, again and again. Lengths above
    cut get -1."""
    out, left = [-1] * len(lengths), sorted((n, i) for i, n in enumerate(lengths) if n <= cut)
    at = 0
    while left:
        room = cut
        while (j := bisect.bisect_right(left, (room, len(lengths)))) > 0:
            n, i = left.pop(j - 1)
            out[i], room = at, room - n
        at += 1
    return out


def greedy_partition(lengths: list[int], k: int, equal: bool = False) -> list[int]:
    """Each length, in the order given, to the part of the least sum so far (ties: the first); equal: of the parts with the fewest rows."""
    sums, rows, out = [0] * k, [0] * k, []
    for n in lengths:
        j = min(range(k), key=lambda j: (rows[j] if equal else 0, sums[j], j))
        sums[j], rows[j] = sums[j] + n, rows[j] + 1
        out.append(j)
    return out


def micro_batches(lengths: list[int], most: int) -> list[int]:
    """Balanced micro-batches of min(rows, ceil(tokens / most)), numbered by descending sum of squared lengths."""
    if not lengths:
        return []
    k = min(len(lengths), max(1, -(-sum(lengths) // most)))
    part = karmarkar_karp(lengths, k)
    work = [sum(n * n for n, p in zip(lengths, part, strict=True) if p == j) for j in range(k)]
    rank = {j: r for r, j in enumerate(sorted(range(k), key=lambda j: (-work[j], j)))}
    return [rank[p] for p in part]


def packed_rows(df: DataFrame, batch: str, row: str, ids: str, cut: int, pad: int = 0) -> DataFrame:
    """Packed rows (batch, bin, input_ids, attention_mask, position_ids) of cut + 1 ids: those of knapsack() in row order, padded; the mask
    numbers the segments from 1, 0 is padding, and positions start anew in each. Rows of more than cut ids go."""
    schema = f"{batch} long, bin long, input_ids array<int>, attention_mask array<int>, position_ids array<int>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        rows, bins = pdf[ids].tolist(), knapsack([len(x) for x in pdf[ids]], cut)
        out = []
        for b in range(max(bins, default=-1) + 1):
            own = [list(x) for x, at in zip(rows, bins, strict=True) if at == b]
            n = sum(map(len, own))
            fill = cut + 1 - n
            out.append((pdf[batch].iloc[0], b, sum(own, []) + [pad] * fill, [i + 1 for i, x in enumerate(own) for _ in x] + [0] * fill, [j for x in own for j in range(len(x))] + [0] * fill))
        return pd.DataFrame(out, columns=[batch, "bin", "input_ids", "attention_mask", "position_ids"])

    return df.select(batch, row, ids).groupBy(batch).applyInPandas(run, schema)


def packed(df: DataFrame, batch: str, row: str, length: str, how, arg: int) -> DataFrame:
    """(batch, row, length, bin) with how(lengths, arg) over each batch in row order. Batches are bounded by their maker."""
    schema = f"{batch} long, {row} long, {length} long, bin long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        return pdf.assign(bin=how(pdf[length].tolist(), arg))[[batch, row, length, "bin"]]

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, schema)


def packed_whole(df: DataFrame, batch: str, row: str, length: str, cut: int) -> DataFrame:
    """(batch, row, piece, length, bin) of whole_first_fit() over each batch in row order; a null length is 0. Batches are bounded by their maker."""
    schema = f"{batch} long, {row} long, piece long, {length} long, bin long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row)
        out = pd.DataFrame(whole_first_fit(pdf[length].fillna(0).astype(int).tolist(), cut), columns=["i", "piece", length, "bin"])
        return pd.DataFrame({batch: pdf[batch].iloc[0], row: pdf[row].to_numpy()[out["i"].to_numpy(int)], "piece": out["piece"], length: out[length], "bin": out["bin"]}).astype("int64")

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, schema)
