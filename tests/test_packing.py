"""Packing covers whole lengths."""

from brindle.operators.packing import whole_first_fit
from brindle.plans.queries import QUERIES


def test_whole_first_fit():
    assert whole_first_fit([25, 3, 0, 10, 7], 10) == [(0, 0, 10, 0), (0, 1, 10, 1), (3, 0, 10, 2), (0, 2, 5, 4), (1, 0, 3, 3), (4, 0, 7, 3)]


def test_pack_first_fit(spark, tmp_path):
    texts = [(1, "x" * 10_000), (2, "y" * 3000), (3, ""), (4, None), (5, "z" * 4096), (1001, "w" * 5)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["pack_first_fit"](spark, str(tmp_path)).collect()
    size, bins = {}, {}
    for r in rows:
        size[r.row] = size.get(r.row, 0) + r.length
        bins[r.batch, r.bin] = bins.get((r.batch, r.bin), 0) + r.length
    assert size == {i: len(t) for i, t in texts if t} and max(bins.values()) <= 4096 and len(bins) == 6


def test_knapsack_and_partitions():
    import itertools
    import random

    from brindle.operators import packing

    rng = random.Random(2)
    for _ in range(30):
        lengths, cut = [rng.randrange(1, 15) for _ in range(9)], 12
        bins = packing.knapsack(lengths, cut)
        left = sorted(n for n in lengths if n <= cut)
        assert [b == -1 for b in bins] == [n > cut for n in lengths]
        for b in range(max(bins) + 1):
            room, want = cut, []
            while any(n <= room for n in left):
                want.append(max(n for n in left if n <= room))
                left.remove(want[-1])
                room -= want[-1]
            assert sorted(want) == sorted(n for n, at in zip(lengths, bins, strict=True) if at == b)
        assert not left
        part = packing.micro_batches(lengths, 30)
        work = [sum(n * n for n, p in zip(lengths, part, strict=True) if p == j) for j in range(max(part) + 1)]
        assert work == sorted(work, reverse=True) and len(work) == min(9, -(-sum(lengths) // 30))
        sums = [sum(n for n, p in zip(lengths, packing.greedy_partition(lengths, 3), strict=True) if p == j) for j in range(3)]
        best = min(max(sum(n for n, p in zip(lengths, how, strict=True) if p == j) for j in range(3)) for how in itertools.product(range(3), repeat=9)) if _ == 0 else 0
        assert max(sums) <= (2 * best if best else sum(lengths))
