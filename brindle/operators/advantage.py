"""Group-relative advantages and token losses, as windows and array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .sampling import cumulated

EPS = 1e-6


def _group(uid: str):
    w = Window.partitionBy(uid)
    return w, F.count(F.lit(1)).over(w)


def grpo(s: Column, uid: str, by_std: bool = True) -> Column:
    """(s - mean) / (std + eps) in its group; a group of one keeps mean 0 and std 1."""
    w, n = _group(uid)
    mean = F.when(n == 1, 0.0).otherwise(F.avg(s).over(w))
    std = F.when(n == 1, 1.0).otherwise(F.stddev_samp(s).over(w))
    return (s - mean) / (std + EPS) if by_std else s - mean


def rloo(s: Column, uid: str) -> Column:
    """Leave-one-out baseline: s n / (n - 1) - mean n / (n - 1); a group of one keeps s."""
    w, n = _group(uid)
    return F.when(n > 1, (s - F.avg(s).over(w)) * n / F.greatest(n - 1, F.lit(1))).otherwise(s)


def opo(s: Column, length: Column, uid: str) -> Column:
    """Length-weighted baseline; a group of one keeps s."""
    w, n = _group(uid)
    return F.when(n == 1, s).otherwise(s - F.sum(length * s).over(w) / F.sum(length).over(w))


def gpg(s: Column, uid: str, alpha: Column | float, f_norm: float = 1.0) -> Column:
    """alpha (s - mean) / f_norm; a group of one keeps mean 0. alpha: see gpg_alpha()."""
    w, n = _group(uid)
    return alpha * (s - F.when(n == 1, 0.0).otherwise(F.avg(s).over(w))) / f_norm


def gpg_alpha(df: DataFrame, s: str) -> float:
    """Rows over rows of a nonzero score (1 at least): one aggregation, one row to the driver."""
    n, some = df.agg(F.count(F.lit(1)), F.count_if(F.col(s) != 0)).first()
    return n / max(1, some)


def grpo_pass_k(df: DataFrame, s: str, uid: str, order: str) -> DataFrame:
    """Only the group's best row gets best minus second best, over std + eps; the others 0."""
    w, n = _group(uid)
    ranked = Window.partitionBy(uid).orderBy(F.desc(s), order)
    second = F.max(F.when(F.col("__r") == 2, F.col(s))).over(w)
    out = df.withColumn("__r", F.row_number().over(ranked)).withColumn("__d", F.col(s) - second)
    return out.withColumn("advantage", F.when(F.col("__r") == 1, F.col("__d") / (F.stddev_samp(s).over(w) + EPS)).otherwise(0.0)).drop("__r", "__d")


#: Advantages of answers by name: (df, names of score, group, order and length) -> df with advantage. More may be added.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "grpo": lambda df, s, uid, order, length: df.withColumn("advantage", grpo(F.col(s), uid)),
    "dr_grpo": lambda df, s, uid, order, length: df.withColumn("advantage", grpo(F.col(s), uid, by_std=False)),
    "rloo": lambda df, s, uid, order, length: df.withColumn("advantage", rloo(F.col(s), uid)),
    "opo": lambda df, s, uid, order, length: df.withColumn("advantage", opo(F.col(s), F.col(length), uid)),
    "gpg": lambda df, s, uid, order, length: df.withColumn("advantage", gpg(F.col(s), uid, gpg_alpha(df, s))),
    "grpo_passk": lambda df, s, uid, order, length: grpo_pass_k(df, s, uid, order),
    "reinforce_plus_plus_baseline": lambda df, s, uid, order, length: reinforce_baseline(df, s, uid, length),
}


def advantages(df: DataFrame, estimator: str, s: str = "s", uid: str = "uid", order: str = "i", length: str = "length") -> DataFrame:
    """df with advantage by the estimator named; an unknown name is an error. Groups are a prompt's answers."""
    if estimator not in ESTIMATORS:
        raise KeyError(f"no such estimator: {estimator}")
    return ESTIMATORS[estimator](df, s, uid, order, length)


def returns_to_go(df: DataFrame, uid: str, t: str, reward: Column) -> Column:
    """The reverse cumulative sum of rewards."""
    return F.sum(reward).over(Window.partitionBy(uid).orderBy(t).rowsBetween(0, Window.unboundedFollowing))


def discounted(rewards: Column, gamma: float) -> Column:
    """Discounted returns of an array, by one fold from its end."""
    step = lambda acc, r: F.concat(F.array(r + gamma * F.coalesce(F.try_element_at(acc, F.lit(1)), F.lit(0.0))), acc)
    return F.aggregate(F.reverse(rewards), F.cast(F.array(), "array<double>"), step)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of two arrays, by one fold from their end over (advantage, next value)."""
    start = F.struct(F.cast(F.array(), "array<double>").alias("out"), F.lit(0.0).alias("adv"), F.lit(0.0).alias("next"))

    def step(acc, rv):
        adv = rv["r"] + gamma * acc["next"] - rv["v"] + gamma * lam * acc["adv"]
        return F.struct(F.concat(F.array(adv), acc["out"]).alias("out"), adv.alias("adv"), rv["v"].alias("next"))

    pairs = F.reverse(F.zip_with(rewards, values, lambda r, v: F.struct(r.alias("r"), v.alias("v"))))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """k1, abs, k2 (mse) and k3 (low_var_kl, clipped) estimates of a token; a trailing `+` keeps the value."""
    d = logp - ref
    k3 = lambda: F.least(F.greatest(F.exp(F.least(F.greatest(-d, F.lit(-20.0)), F.lit(20.0))) + d - 1, F.lit(-10.0)), F.lit(10.0))
    kinds = {"k1": lambda: d, "kl": lambda: d, "abs": lambda: F.abs(d), "k2": lambda: 0.5 * d * d, "mse": lambda: 0.5 * d * d, "k3": k3, "low_var_kl": k3}
    return kinds[kind.rstrip("+")]()


def clipped_loss(logp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Column:
    """Dual-clipped policy loss of a token."""
    ratio = F.exp(F.least(F.greatest(logp - old, F.lit(-20.0)), F.lit(20.0)))
    worst = F.greatest(-adv * ratio, -adv * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)))
    return F.when(adv < 0, F.least(worst, -adv * c)).otherwise(worst)


def aggregate_loss(tokens: DataFrame, seq: str, loss: str, mask: str, mode: str, width: int = 1) -> DataFrame:
    """token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm (the sum over the padded width) of masked token losses."""
    s = tokens.groupBy(seq).agg(F.sum(F.col(loss) * F.col(mask)).alias("s"), F.sum(mask).alias("m"))
    if mode == "seq-mean-token-sum-norm":
        return s.agg(F.round(F.sum("s") / width, 6).alias("loss"))
    how = {"token-mean": F.sum("s") / F.sum("m"), "seq-mean-token-sum": F.avg("s"), "seq-mean-token-mean": F.avg(F.col("s") / (F.col("m") + 1e-8))}[mode]
    return s.agg(F.round(how, 6).alias("loss"))


def _per_sequence(tokens: DataFrame, seq: str, **sums: Column) -> DataFrame:
    """Masked sums of token columns by sequence: one aggregation with map-side combine."""
    return tokens.groupBy(seq).agg(F.sum("mask").alias("m"), *[F.sum(c * F.col("mask")).alias(k) for k, c in sums.items()])


def sequence_ratio_loss(tokens: DataFrame, seq: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Sequence-ratio (GSPO) loss of tokens (seq, logp, old, adv, mask): all of a sequence's tokens have the
    ratio exp(mean log-ratio), at most exp(10). As the ratio is one for all, the clipped side hangs on
    the advantage's sign only, and sums of positive and negative advantages are enough."""
    adv = F.col("adv")
    s = _per_sequence(tokens, seq, k=F.col("logp") - F.col("old"), gain=F.greatest(adv, F.lit(0.0)), cost=F.least(adv, F.lit(0.0)))
    ratio = F.exp(F.least(F.col("k") / F.greatest("m", F.lit(1)), F.lit(10.0)))
    clip = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    total = -(F.col("gain") * F.least(ratio, clip) + F.col("cost") * F.greatest(ratio, clip))
    return s.agg(F.avg(total / (F.col("m") + 1e-8)).alias("loss"))


def geometric_mean_loss(tokens: DataFrame, seq: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Geometric-mean (GMPO) loss of tokens (seq, logp, old, adv, mask): log-ratios are clipped a token at a
    time on the side that the advantage's sign names; a sequence has their mean and its mean advantage."""
    k, sign = F.col("logp") - F.col("old"), F.signum("adv")
    clip = F.least(F.greatest(k, F.lit(-low)), F.lit(high))
    s = _per_sequence(tokens, seq, k=sign * F.least(sign * k, sign * clip), adv=F.col("adv"))
    return s.agg(F.avg(-F.col("adv") / (F.col("m") + 1e-8) * F.exp(F.col("k") / (F.col("m") + 1e-8))).alias("loss"))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def gpg_loss(tokens: DataFrame, seq: str, mode: str = "token-mean") -> DataFrame:
    """Plain policy-gradient loss of tokens (seq, logp, adv, mask): -logp * adv."""
    return aggregate_loss(tokens.withColumn("loss", -F.col("logp") * F.col("adv")), seq, "loss", "mask", mode)


def _largest(df: DataFrame, value: str, order: list[str], k: int) -> DataFrame:
    """The k rows of the largest values, ties by `order`, without a sort of all in one task: an exact count by ranges of the value
    says in which range the k-th lies, and only its rows are ranked."""
    if not k:
        return df.limit(0)
    cuts = sorted(set(df.approxQuantile(value, [i / 256 for i in range(257)], 0.0005)))
    if not cuts:
        return df.limit(0)
    step = F.lit(0)
    for c in cuts:
        step = step + (F.col(value) > c).cast("int")
    ranged = df.withColumn("__step", step)
    counts, above = sorted(((r["__step"], r["count"]) for r in ranged.groupBy("__step").count().collect()), reverse=True), 0  # 258 rows at most
    for at, n in counts:
        if above + n >= k:
            inner = ranged.where(F.col("__step") == at).orderBy(F.desc(value), *order).limit(k - above)
            return ranged.where(F.col("__step") > at).unionByName(inner).drop("__step")
        above += n
    return df


def kl_cov_loss(tokens: DataFrame, seq: str, order: list[str], share: float = 0.0002, coef: float = 1.0, mode: str = "token-mean") -> DataFrame:
    """Policy loss of tokens (seq, logp, old, adv, mask): the share of unmasked tokens with the largest
    covariance of advantage and logp, one at least, pays coef * |logp - old| on top. `order` names the
    token and decides ties. Two passes over the tokens give count, means and the tokens chosen."""
    valid = tokens.where("mask > 0")
    n, adv, logp = valid.agg(F.count("adv"), F.avg("adv"), F.avg("logp")).first()
    cov = (F.col("adv") - F.lit(adv)) * (F.col("logp") - F.lit(logp))
    top = _largest(valid.select(*order, cov.alias("cov")), "cov", order, max(1, int(n * share)) if n else 0)
    k = F.col("logp") - F.col("old")
    out = tokens.join(top.select(*order, F.lit(1.0).alias("hit")), order, "left")
    out = out.withColumn("loss", -F.col("adv") * F.exp(k) + F.coalesce("hit", F.lit(0.0)) * coef * F.abs(k))
    return aggregate_loss(out, seq, "loss", "mask", mode)


def masked_stats(tokens: DataFrame, value: str, mask: str) -> tuple[float, float, float]:
    """(sum, mean, sample variance) of unmasked values, NaN outside the mask ignored; the mean's denominator is the mask's sum + 1e-8.
    One aggregation, one row to the driver."""
    inside = F.when(F.col(mask) != 0, F.col(value).cast("double"))
    total, n, square = tokens.agg(F.sum(inside), F.sum(F.col(mask).cast("double")), F.var_samp(inside)).first()
    return total or 0.0, (total or 0.0) / ((n or 0.0) + 1e-8), square or 0.0


def whitened(tokens: DataFrame, value: str, mask: str, shift: bool = True) -> Column:
    """(value - mean) / sqrt(variance + 1e-8) by the masked statistics; without shift the mean is added back."""
    _, mean, var = masked_stats(tokens, value, mask)
    out = (F.col(value) - mean) * (var + 1e-8) ** -0.5
    return out if shift else out + mean


def reinforce_baseline(df: DataFrame, s: str, uid: str, length: str) -> DataFrame:
    """df with advantage: score less its group's mean, tiled over `length` tokens and whitened over all of them. As a row's tokens are
    equal, sums weighted by length stand for the tokens."""
    w, n = _group(uid)
    rows = df.withColumn("__c", F.col(s) - F.when(n == 1, 0.0).otherwise(F.avg(s).over(w)))
    k = F.col(length)
    count, total, square = rows.agg(F.sum(k), F.sum(F.col("__c") * k), F.sum(F.col("__c") ** 2 * k)).first()
    mean = (total or 0.0) / ((count or 0) + 1e-8)
    var = ((square or 0.0) - (total or 0.0) ** 2 / max(count or 1, 1)) / max((count or 2) - 1, 1)
    return rows.withColumn("advantage", (F.col("__c") - mean) * (var + 1e-8) ** -0.5).drop("__c")


def kl_reward(reward: Column, kl_value: Column, mask: Column, beta: float) -> Column:
    """A token's reward less beta times its divergence."""
    return reward - beta * kl_value * mask


def next_beta(beta: float, current: float, target: float, steps: int, horizon: int) -> float:
    """The adaptive controller's next coefficient: the error current / target - 1 counts 0.2 at most either way."""
    return beta * (1 + max(-0.2, min(0.2, current / target - 1)) * steps / horizon)


def value_loss(value: Column, old: Column, ret: Column, clip: float) -> Column:
    """Half the larger of the squared errors with and without the value held near the old one."""
    held = F.least(F.greatest(value, old - clip), old + clip)
    return 0.5 * F.greatest((value - ret) ** 2, (held - ret) ** 2)


def entropy(logits: Column) -> Column:
    """logsumexp - sum of p * logit, shifted by the largest logit."""
    top = F.array_max(logits)
    mass = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(mass) + top - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x) / mass


def clip_cov_loss(tokens: DataFrame, seq: str, order: list[str], share: float, low: float, high: float, bounds: tuple[float, float], seed: int = 7, mode: str = "token-mean") -> DataFrame:
    """Clipped policy loss of tokens (seq, logp, old, adv, mask), where of the unmasked tokens whose covariance lies in `bounds` and whose ratio is
    not clipped already a share of all, one at least, drawn by a hash of `order`, count nothing."""
    k = F.col("logp") - F.col("old")
    ratio = F.exp(k)
    plain, held = -F.col("adv") * ratio, -F.col("adv") * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    n, adv, logp = tokens.where("mask > 0").agg(F.count("adv"), F.avg("adv"), F.avg("logp")).first()
    cov = (F.col("adv") - F.lit(adv)) * (F.col("logp") - F.lit(logp))
    may = tokens.where((F.col("mask") > 0) & (held <= plain) & cov.between(*bounds)).select(*order, F.xxhash64(F.lit(seed), *order).cast("double").alias("h"))
    out = tokens.join(_largest(may, "h", order, max(1, int((n or 0) * share))).select(*order, F.lit(0.0).alias("hit")), order, "left")
    out = out.withColumn("loss", F.greatest(plain, held) * F.coalesce("hit", F.lit(1.0)))
    return aggregate_loss(out, seq, "loss", "mask", mode)


def resampled(df: DataFrame, id_col: str, weight: Column, n: int, seed: int = 3) -> DataFrame:
    """n rows drawn with replacement in proportion to weight (PF-PPO), as (draw, id): a seeded uniform for each draw falls into a row's stretch of the
    cumulated weights. Both are cut into n stretches of equal width and meet by these, so no row is compared with every draw: a row lies in as
    many as its weight spans, n and a row each in all. Null ids and weights that are null or not above 0 are never drawn; without any weight there are no rows."""
    held = df.select(id_col, weight.cast("double").alias("__w")).where(F.col(id_col).isNotNull() & (F.col("__w") > 0))
    cum = cumulated(held, [id_col], "__w", "__hi").withColumn("__lo", F.col("__hi") - F.col("__w"))
    total = cum.agg(F.max("__hi")).first()[0]
    if total is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("draw", T.LongType()), df.schema[id_col]]))
    stretch = lambda x: F.least(F.floor(x / total * n), F.lit(n - 1))
    u = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / (1 << 40) * total).alias("__u"))
    u = u.withColumn("__at", stretch(F.col("__u")))
    spans = cum.withColumn("__at", F.explode(F.sequence(stretch(F.col("__lo")), stretch(F.col("__hi")))))
    met = u.join(spans, "__at").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    # rounding may leave a gap or an overlap where two stretches meet: the first row counts, and a draw that met none takes the next row up
    first = met.groupBy("draw").agg(F.min_by(id_col, "__lo").alias(id_col))
    lost = u.join(first, "draw", "left_anti")
    after = lost.join(spans, "__at").where(F.col("__hi") > F.col("__u")).groupBy("draw").agg(F.min_by(id_col, "__lo").alias(id_col))
    return first.unionByName(after)


def pf_weight(score: Column, least: Column, most: Column, how: str, power: float = 2.0) -> Column:
    """pow: |score|^power; max_min: 1 for the best and the worst, else 0; max_random: 0.4 for the best, else 0.1. None is 0: 1e-8 comes on top."""
    if how not in ("pow", "max_min", "max_random"):
        raise ValueError(f"no way of weighing: {how}")
    extreme = F.when(score == most, 0.4).otherwise(0.1) if how == "max_random" else ((score == least) | (score == most)).cast("double")
    return (F.abs(score) ** power if how == "pow" else extreme) + 1e-8


#: Policy losses by name: (tokens, seq, order, options) -> a row with loss. tokens: seq, order's columns, logp, old, adv, mask. More may be added.
LOSSES: dict[str, Callable[..., DataFrame]] = {
    "vanilla": lambda x, seq, order, mode="token-mean", **how: aggregate_loss(x.withColumn("__loss", clipped_loss(F.col("logp"), F.col("old"), F.col("adv"), **how)), seq, "__loss", "mask", mode),
    "gspo": lambda x, seq, order, **how: sequence_ratio_loss(x, seq, **how),
    "geo_mean": lambda x, seq, order, **how: geometric_mean_loss(x, seq, **how),
    "gpg": lambda x, seq, order, **how: gpg_loss(x, seq, **how),
    "kl_cov": lambda x, seq, order, **how: kl_cov_loss(x, seq, order, **how),
    "clip_cov": lambda x, seq, order, **how: clip_cov_loss(x, seq, order, **how),
}


def policy_loss(tokens: DataFrame, name: str, seq: str, order: list[str], **how) -> DataFrame:
    """The loss named; an unknown name is an error."""
    if name not in LOSSES:
        raise KeyError(f"no such loss: {name}")
    return LOSSES[name](tokens, seq, order, **how)


def adaptive_kl(steps: DataFrame, by: list[str], order: str, kl: str, n: str, init: float, target: float, horizon: float) -> DataFrame:
    """steps with kl_coef after each: the coefficient grows by 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon a step, from init. The table has a
    row a training step of a run."""
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(kl) / target - 1))
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("kl_coef", F.lit(float(init)) * F.product(1 + error * F.col(n) / horizon).over(run))
