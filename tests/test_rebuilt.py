"""Operators rebuilt over tables, against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import advantage as A
from brindle.operators import encoding as E
from brindle.operators import evaluation as V
from brindle.operators import packing as B
from brindle.operators import relational as R
from brindle.operators import sampling as S


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_resampling_is_multinomial(spark, n):
    rng = np.random.default_rng(n)
    w = rng.exponential(size=400) ** 3
    w[7] = w.sum()  # half of all weight
    w[9], w[11] = 0, -1
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)] + [(None, 1.0), (400, None)], "id long, w double").repartition(5)
    got = {r.draw: r.id for r in A.resampled(df, "id", F.col("w"), n).collect()}
    live = np.where(w > 0, w, 0)
    hi = np.cumsum(live)
    u = [r.u for r in spark.range(n).orderBy("id").select((F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40)) / (1 << 40)).alias("u")).collect()]
    want = {k: int(np.searchsorted(hi, x * hi[-1], side="right")) for k, x in enumerate(u)}
    assert len(got) == n and sum(got[k] != want[k] for k in want) <= n // 1000
    assert A.resampled(df.where("w < 0"), "id", F.col("w"), 5).count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "s double")
    one = lambda how: [round(r[0], 6) for r in df.select(A.pf_weight(F.col("s"), F.lit(-2.0), F.lit(3.0), how)).collect()]
    assert one("pow") == [4.0, 0.0, 9.0] and one("max_min") == [1.0, 0.0, 1.0] and one("max_random") == [0.1, 0.1, 0.4]
    with pytest.raises(ValueError):
        A.pf_weight(F.col("s"), F.lit(0), F.lit(0), "other")


def test_running_sums(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"), (F.col("id") % 13).alias("v"), F.repeat(F.lit("x"), 200).alias("wide"))
    got = sorted((r.k, r.v, r.s) for r in S.cumulated(df, ["k"], "v", "s").collect())
    assert [s for _, _, s in got] == list(np.cumsum([v for _, v, _ in got]))


def test_bootstrap(spark):
    rng = np.random.default_rng(4)
    v = {0: rng.normal(size=9), 1: rng.normal(size=30), 2: np.array([5.0])}
    df = spark.createDataFrame([(g, i, float(x)) for g, xs in v.items() for i, x in enumerate(xs)] + [(3, 0, None), (1, 99, None)], "g long, i long, x double")
    mean = {r.g: r for r in V.bootstrap(df, ["g"], "i", "x").collect()}
    best = {r.g: r for r in V.bootstrap(df, ["g"], "i", "x", size=4, reducer="best").collect()}
    assert set(mean) == set(best) == {0, 1, 2}
    for g, xs in v.items():
        n = len(xs)
        assert abs(mean[g]["mean"] - xs.mean()) < 5 * xs.std() / math.sqrt(n * 1000) + 1e-6 and abs(mean[g]["std"] - xs.std() / math.sqrt(n)) < 0.12 * xs.std() / math.sqrt(n) + 1e-6
        up = np.sort(xs)
        p = (np.arange(1, n + 1) / n) ** 4 - (np.arange(n) / n) ** 4
        m = (p * up).sum()
        assert abs(best[g]["mean"] - m) < 5 * math.sqrt((p * (up - m) ** 2).sum() / 1000) + 1e-6
    votes = spark.createDataFrame([(0, i, "a" if i < 6 else "b", float(i < 6)) for i in range(8)], "g long, i long, vote string, value double").withColumn("x", F.struct("vote", "value"))
    got = V.bootstrap(votes, ["g"], "i", "x", size=3, reducer=V.majority_of).first()
    assert abs(got["mean"] - (0.75**3 + 3 * 0.75**2 * 0.25)) < 0.06  # two of three draws vote a


def test_smoothing(spark):
    xs = [float(i % 7) for i in range(300)]
    got = spark.createDataFrame([(xs,), (None,), ([],)], "v array<double>").select(V.smoothed(F.col("v")).alias("y")).collect()
    w, y = 1.8 * (1 / (1 + math.exp(-0.05 * 300)) - 0.5), [xs[0]]
    for x in xs[1:]:
        y.append(y[-1] * w + (1 - w) * x)
    assert np.allclose(got[0].y, y) and got[1].y is None and got[2].y == []


def test_packers_one_by_one():
    assert B.next_fit([4, 7, 3, 9, 1, 12, 2], 10) == [0, 1, 1, 2, 2, 3, 4]
    part = B.karmarkar_karp([8, 7, 6, 5, 4], 2)
    sums = sorted(sum(n for n, p in zip([8, 7, 6, 5, 4], part, strict=True) if p == j) for j in range(2))
    assert sums == [14, 16] and B.karmarkar_karp([], 3) == [] and set(B.karmarkar_karp([5, 5, 5], 3)) == {0, 1, 2}


def test_minhash_bands_by_hand(spark):
    top, step = 1 << 64, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ x >> 27) * 0x94D049BB133111EB % top
        return x ^ x >> 31

    def hashed(window):
        h = 0
        for c in window:
            h = (h * step + ord(c) + 1) % top
        return mix((h + len(window)) % top)

    signed = lambda x: x - top if x >= top >> 1 else x
    rows = [(1, "Some text of words"), (2, "abc"), (3, None), (4, "some TEXT of words"), (5, "")]
    got = {r.doc_id: list(r.signature) for r in R.minhash(spark.createDataFrame(rows, "doc_id long, text string"), "text", 5, 4).collect()}
    for i, text in rows:
        low = (text or "").lower()
        shingles = {low} if len(low) <= 5 else {low[k : k + 5] for k in range(len(low) - 4)}
        want = [signed(min((hashed(x) * (mix(s) | 1) + mix((s + step) % top)) % top for x in shingles)) for s in range(1, 5)]
        assert got[i] == want
    bands = R.band_keys(R.minhash(spark.createDataFrame(rows, "doc_id long, text string"), "text", 5, 4), 2, 2).collect()
    keys = {(r.doc_id, r.band): r.band_key for r in bands}
    assert len(bands) == 10 and keys[1, 0] == keys[4, 0] and keys[1, 1] == keys[4, 1] and keys[1, 0] != keys[2, 0]


def test_best_and_worst_of_n(spark):
    rows = [(s, u, i, float((7 * i + u) % 10)) for s in range(2) for u in range(3) for i in range(10 if u else 3)]
    got = {(r.source, r.n): r for r in V.validation_pass(spark.createDataFrame(rows, "source long, uid long, i long, v double"), "source", "uid", "i", "v", [2, 4]).collect()}
    assert set(got) == {(0, 2), (0, 4), (1, 2), (1, 4)}
    # ten values 0 .. 9: the best of n draws; of three values the prompt counts for n = 2 alone
    best = lambda xs, n: sum(x * (((k + 1) / len(xs)) ** n - (k / len(xs)) ** n) for k, x in enumerate(sorted(xs)))
    three = [float(7 * i % 10) for i in range(3)]
    assert abs(got[0, 4].best_mean - best(range(10), 4)) < 0.2 and abs(got[0, 2].best_mean - (2 * best(range(10), 2) + best(three, 2)) / 3) < 0.2
    assert abs(got[1, 4].best_mean + got[1, 4].worst_mean - 9) < 0.3 and got[1, 4].best_std > 0


def test_packed_attention_and_feedback(spark):
    df = spark.createDataFrame([([1, 1, 2, 0],), ([],)], "m array<int>")
    got = [r[0] for r in df.select(E.block_mask(F.col("m"))).collect()]
    assert got == [[[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]], []]
    x = spark.createDataFrame([([1, 2], [3, 4], [1, 2], [9], True)], "p array<int>, a array<int>, kp array<int>, ka array<int>, good boolean")
    e = E.feedback(*map(F.col, ("p", "a", "kp", "ka", "good")), 10)
    r = x.select(*[c.alias(k) for k, c in e.items()]).first()
    assert (r.input_ids, r.labels, r.kl_input_ids, r.kl_labels, r.kto_tags) == ([1, 2, 3, 4], [-100, -100, 3, 4], [1, 2, 9], [-100, -100, 9], True)
    u = E.unsupervised(F.col("p"), F.col("a"), 3)
    r = x.select(*[c.alias(k) for k, c in u.items()]).first()
    assert len(r.input_ids) + len(r.labels) <= 3 and r.input_ids == [1, 2][: len(r.input_ids)] and r.labels == [3, 4][: len(r.labels)]


def test_draws_by_share_and_ragged_rows(spark):
    one, two = spark.range(5).withColumn("t", F.lit("a")), spark.range(100, 140).withColumn("t", F.lit("b"))
    first = S.interleaved_by([one, two], "id", [1.0, 3.0]).orderBy("position").collect()
    assert [r.position for r in first] == list(range(len(first))) and [r.id for r in first if r.t == "a"] == list(range(sum(r.t == "a" for r in first)))
    every = S.interleaved_by([one, two], "id", [1.0, 3.0], "all").collect()
    assert {r.id for r in every} == {*range(5), *range(100, 140)} and sum(r.t == "b" for r in every) >= 40
    assert S.interleaved_by([one, two.where("false")], "id", [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        S.interleaved_by([one, two], "id", [1.0, 0.0])
    x = spark.createDataFrame([(1, 2), (2, None), (3, -1), (4, 1)], "k long, n int")
    assert [(r.k, r.rep, r.position) for r in S.repeated_by(x, "k", "n").orderBy("position").collect()] == [(1, 0, 0), (1, 1, 1), (4, 0, 2)]
    keep = spark.createDataFrame([(1, True), (3, None), (4, True), (9, True)], "k long, keep boolean")
    assert [(r.k, r.position) for r in S.gathered_by(x.select("k"), "k", keep).orderBy("k").collect()] == [(1, 0), (4, 1)]
    assert [r.k for r in R.where_equal(x, "n=2").collect()] == [1] and R.where_equal(x, {"k": 2, "n": "None"}).count() == 0
    for bad, error in (("n", ValueError), ("other=1", KeyError)):
        with pytest.raises(error):
            R.where_equal(x, bad)


def test_losses_by_name(spark):
    rng = np.random.default_rng(6)
    n = 400
    rows = [(i // 20, i, *map(float, rng.normal(size=3) * [0.4, 0.4, 1]), int(i % 5 != 0)) for i in range(n)]
    x = spark.createDataFrame(rows, "seq long, i long, logp double, old double, adv double, mask int")
    f = lambda name, **how: A.policy_loss(x, name, "seq", ["i"], **how).first()["loss"]
    logp, old, adv, mask = (np.array([r[k] for r in rows]) for k in (2, 3, 4, 5))
    ratio = np.exp(logp - old)
    plain, held = -adv * ratio, -adv * np.clip(ratio, 0.8, 1.2)
    worst = np.maximum(plain, held)
    dual = np.where(adv < 0, np.minimum(worst, -adv * 3), worst)
    assert abs(f("vanilla") - (dual * mask).sum() / mask.sum()) < 1e-5
    # of the tokens in bounds that are not clipped a share drawn by hash counts nothing
    m = mask > 0
    cov = (adv - adv[m].mean()) * (logp - logp[m].mean())
    h = np.array([r.h for r in x.orderBy("i").select(F.xxhash64(F.lit(7), "i").cast("double").alias("h")).collect()])
    may = np.flatnonzero(m & (held <= plain) & (cov >= 0.1) & (cov <= 5))
    hit = may[np.argsort(-h[may], kind="stable")[: max(1, int(m.sum() * 0.05))]]
    keep = np.ones(n)
    keep[hit] = 0
    assert 0 < len(hit) < len(may)
    assert abs(f("clip_cov", share=0.05, low=0.2, high=0.2, bounds=(0.1, 5.0)) - (worst * keep * mask).sum() / mask.sum()) < 1e-5
    assert {f(k) is not None for k in ("gspo", "geo_mean", "gpg", "kl_cov")} == {True}
    with pytest.raises(KeyError):
        f("other")
    with pytest.raises(KeyError):
        A.advantages(x, "other")


def test_bleu_by_hand(spark):
    from collections import Counter

    pairs = [("a b c d e", "a b c d e"), ("a b c d", "a b x d e f"), ("a a a a", "a b"), ("x", "y"), ("the cat the cat on mat", "the cat sat on the mat"), ("b", "b c d")]
    df = spark.createDataFrame([(p.split(), g.split()) for p, g in pairs], "p array<string>, g array<string>")
    got = [r[0] for r in df.select(V.bleu4(F.col("p"), F.col("g"))).collect()]
    for (p, g), b in zip(pairs, got, strict=True):
        p, g = p.split(), g.split()
        if not set(p) & set(g):
            assert b == 0
            continue
        logs = 0
        for n in range(1, 5):
            a, c = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, g))
            both = sum((a & c).values())
            logs += math.log((both or 0.1) / max(1, sum(a.values())))
        want = 100 * (1 if len(p) >= len(g) else math.exp(1 - len(g) / len(p))) * math.exp(logs / 4)
        assert abs(b - want) < 1e-3
