"""The rule of targets and the risk of toxicity, against direct computations."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import mixing, toxicity


def shared(sizes, weights):
    """Shares by the rule's own words, one source at a time: the one that is furthest above its cap stops there, and what it leaves is dealt anew."""
    total, capped = Fraction(3, 2) * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(capped.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i]]
        if not over:
            return [capped.get(i, share.get(i, Fraction(0))) for i in range(len(sizes))]
        worst = max(over, key=lambda i: (share[i] / sizes[i] if sizes[i] else math.inf, -i))
        capped[worst] = Fraction(2 * sizes[worst])


@pytest.mark.parametrize("seed", range(20))
def test_targets_follow_the_rule(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    sizes = [rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 5000)]) for _ in range(n)]
    weights = [(5, 2, 1)[i % 3] for i in range(n)]
    got = mixing.targets(sizes, weights)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True)) and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * (1 + sum(sizes))
    assert np.allclose(got, [float(x) for x in shared(sizes, weights)], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_fit_follows_the_non_negative_risk(prior):
    """Adam on numeric gradients of the risk, written out: where the negative part is below 0, its gradient is turned around."""
    rng = np.random.default_rng(int(prior * 10))
    texts, width = 40, 6
    x = (rng.random((texts, width)) < 0.4).astype(float)
    toxic = np.arange(texts) < 12
    x[toxic, 0] = 1
    owner, feature = np.nonzero(x)
    soft = lambda z: np.log1p(np.exp(z))

    def parts(w):
        z = x @ w[:-1] + w[-1]
        return prior * soft(-z[toxic]).mean(), soft(z[~toxic]).mean() - prior * soft(z[toxic]).mean()

    w, m, v, turned = np.append(np.zeros(width), math.log(prior / (1 - prior))), 0, 0, set()
    for t in range(1, 61):
        negative = parts(w)[1]
        turned.add(negative < 0)
        aim = (lambda q: sum(parts(q))) if negative >= 0 else (lambda q: -parts(q)[1])
        step = 1e-6 * np.eye(width + 1)
        g = np.array([(aim(w + s) - aim(w - s)) / 2e-6 for s in step]) + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, bias = toxicity.fit(owner, feature, toxic, prior, width, rounds=60)
    assert np.allclose(np.append(got, bias), w, atol=2e-3), (got, bias, w)
    assert prior == 0.1 or True in turned


def test_shards_follow_the_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three four " * (i % 5), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    used = lambda: len({s for r in mixing.mix(docs).collect() for s in r.shards})
    monkeypatch.setattr(mixing, "SHARDS", (4, 64))
    few = used()
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)  # the mix takes 4,800 of 3,200 words: 16 shards
    assert few == 4 and used() == 16
    assert mixing.shuffled(mixing.mix(docs)).select("shard").distinct().count() == 16
