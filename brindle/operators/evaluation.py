"""More metrics: masked, by series, by answer; each one aggregation with map-side sums unless it says otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reduced(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """A value a metric: the largest where its name holds `max`, else the least where it holds `min`, else the mean."""
    how = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return metrics.groupBy(name).agg(F.round(how, 6).alias("value"))


def k_grid(target: int, most: int) -> list[int]:
    """1, 2, 4, .. below target, then target; those above most are left out."""
    out, k = [], 1
    while k < target:
        out.append(k)
        k *= 2
    return [x for x in [*out, target] if x <= most]


def kept_ks(ks: list[int], max_rank: int) -> list[int]:
    """Positive ks up to max_rank + 1, and that; all of them where no rank is known (below 0)."""
    if max_rank < 0:
        return sorted({k for k in ks if k > 0})
    return sorted({k for k in ks if 0 < k <= max_rank + 1} | {max_rank + 1})


def token_accuracy(df: DataFrame, predicted: Column, labels: Column, ignore: int = -100) -> DataFrame:
    """The mean over rows of the share of labels that the prediction one place before gives; ignored labels don't count, rows
    without others neither; and the share of rows that are right throughout."""
    pairs = F.filter(F.arrays_zip(F.slice(predicted, F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))).alias("p"), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("l")), lambda x: x["l"] != ignore)
    right = F.size(F.filter(pairs, lambda x: x["p"] == x["l"])) / F.nullif(F.size(pairs), F.lit(0))
    return df.select(right.alias("a")).agg(F.count("a").alias("rows"), F.round(F.avg("a"), 6).alias("token_accuracy"), F.round(F.avg((F.col("a") == 1).cast("int")), 6).alias("sequence_accuracy"))


def ngrams(words: Column, n: int) -> Column:
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, spans).otherwise(F.array().cast("array<string>"))


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """F1 of the n-grams in common, each counted as often as in both, in per cent; nothing in common: 0."""
    a, b = ngrams(pred, n), ngrams(gold, n)
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), _overlap(a, b))
    return F.when(both == 0, 0.0).otherwise(F.round(100 * 2 * both / (F.size(a) + F.size(b)), 4))


def rouge_l(pred: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of words, in per cent: one row of the table at a time, folded over the words."""
    def step(row, x):
        zero = F.struct(F.array(F.lit(0)).alias("out"), F.lit(0).alias("diag"))
        def cell(acc, g):
            up, left = g["up"], F.element_at(acc["out"], -1)
            now = F.when(g["w"] == x, acc["diag"] + 1).otherwise(F.greatest(up, left))
            return F.struct(F.concat(acc["out"], F.array(now)).alias("out"), up.alias("diag"))
        above = F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))
        return F.aggregate(F.arrays_zip(gold.alias("w"), above.alias("up")), zero, cell, lambda a: a["out"])

    last = F.aggregate(pred, F.array_repeat(F.lit(0), F.size(gold) + 1), step)
    common = F.element_at(last, -1)
    return F.when(common == 0, 0.0).otherwise(F.round(100 * 2 * common / (F.size(pred) + F.size(gold)), 4))


def bleu4(pred: Column, gold: Column) -> Column:
    """Geometric mean of the 1- to 4-gram precisions, orders of nothing in common counted as 0.1 in their place, with the brevity
    penalty, in per cent; an empty prediction: 0."""
    total = F.lit(0.0)
    for n in range(1, 5):
        a, b = ngrams(pred, n), ngrams(gold, n)
        both = F.aggregate(F.array_intersect(a, b), F.lit(0), _overlap(a, b))
        total = total + F.log(F.when(both > 0, both.cast("double")).otherwise(0.1) / F.greatest(F.size(a), F.lit(1)))
    brief = F.when(F.size(pred) >= F.size(gold), 1.0).otherwise(F.exp(1 - F.size(gold) / F.greatest(F.size(pred), F.lit(1))))
    return F.when(F.size(F.array_intersect(pred, gold)) == 0, 0.0).otherwise(F.round(100 * brief * F.exp(total / 4), 4))


def _overlap(a: Column, b: Column):
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    return lambda s, x: s + F.least(times(a, x), times(b, x))


#: What a resample of values becomes: mean, best@n, worst@n.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v),
    "best": F.array_max,
    "worst": F.array_min,
}


#: Draws in the table of bootstrap(), 8 bytes each, at most.
DRAWS = 1 << 20


def bootstrap(df: DataFrame, by: list[str], order: str, value: str, rounds: int = 1000, seed: int = 42, size: int | None = None, reducer: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """(mean, std) over rounds of a reducer (of REDUCERS, or a function of an array) of `size` values (null: as many as a group has) drawn with replacement.
    The group's values are an array: groups are a prompt's samples. Rounds are computed in the group's row, so nothing is multiplied by
    them. Draws hash (seed, round, place), so reruns agree; null values are left out, and a group without others has none.
    Reducers by name run over numpy arrays with a table of those draws, made once, for groups of as many as DRAWS draws hold; longer groups, and reducers
    that are functions, as column functions. Either way the same draws are taken, and summed in the same order."""
    one = samples(df, by, order, value)
    if not isinstance(reducer, str) or (size or 1) * rounds > DRAWS:
        return _by_columns(one, by, rounds, seed, size, REDUCERS[reducer] if isinstance(reducer, str) else reducer)
    most = size or min(DRAWS // rounds, 512)
    short = F.lit(True) if size else F.size("v") <= most
    some = one.where(short).select(*by, _resampled(_draws(df.sparkSession, rounds, most, seed), size, reducer)("v").alias("__r"))
    some = some.select(*by, F.round("__r.mean", 6).alias("mean"), F.round("__r.std", 6).alias("std"))
    return some if size else some.unionByName(_by_columns(one.where(~short), by, rounds, seed, size, REDUCERS[reducer]))


def samples(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Groups' values in order, as arrays v; null values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))


def _draws(spark: SparkSession, rounds: int, most: int, seed: int):
    """Broadcast hashes of (seed, round, place), a row a place and a column a round: they are the same for all groups."""
    h = F.xxhash64(F.lit(seed), F.floor(F.col("id") / most).cast("int"), (F.col("id") % most).cast("int"))
    table = spark.range(rounds * most, numPartitions=1).select(h.alias("h")).toArrow()
    return spark.sparkContext.broadcast(table["h"].to_numpy().reshape(rounds, most).T.copy())


def _resampled(table, size: int | None, reducer: str):
    """A function of a column of arrays: mean and std of the reducer over rounds. table: see _draws()."""

    def run(values: pd.Series) -> pd.DataFrame:
        draws, places, out = table.value, {}, []
        for v in values:
            v, n = np.asarray(v, float), len(v)
            if n not in places:
                if len(places) * len(draws) > 4096:
                    places.clear()
                places[n] = np.mod(draws[: size or n], n)  # of the divisor's sign, as pmod's
            at = places[n]
            m = v[at[0]]
            for row in at[1:]:  # in the order of places, as the sum's last digits hang on it
                # a NaN is above all numbers, as it is to Spark
                m = m + v[row] if reducer == "mean" else np.maximum(m, v[row]) if reducer == "best" else np.fmin(m, v[row])
            m = m / len(at) if reducer == "mean" else m
            mean = m.cumsum()[-1] / len(m)
            out.append((mean, math.sqrt(((m - mean) ** 2).cumsum()[-1] / len(m))))
        return pd.DataFrame(out, columns=["mean", "std"])

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, "struct<mean:double,std:double>")
    return lambda v: made(F.col(v).cast("array<double>"))


def _by_columns(one: DataFrame, by: list[str], rounds: int, seed: int, size: int | None, reduce: Callable[[Column], Column]) -> DataFrame:
    """bootstrap() of rows (by, v) by column functions."""
    places = F.sequence(F.lit(0), (F.lit(size) if size else F.size("v")) - 1)
    drawn = lambda r: F.transform(places, lambda i: F.get("v", F.pmod(F.xxhash64(F.lit(seed), r, i), F.size("v")).cast("int")))
    each = one.select(*by, F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.get(F.transform(F.array(drawn(r)), reduce), F.lit(0)).cast("double")).alias("m"))
    mean = each.withColumn("mean", REDUCERS["mean"](F.col("m")))
    std = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("m"))
    return mean.select(*by, F.round("mean", 6).alias("mean"), F.round(std, 6).alias("std"))


def majority_of(drawn: Column) -> Column:
    """Of an array of (vote, value) the value of the first of those with the most frequent vote, ties to the vote met first: a reducer of bootstrap()."""
    votes = F.transform(drawn, lambda x: F.struct(F.size(F.filter(drawn, lambda y: y["vote"] == x["vote"])).alias("n"), x["value"].alias("value")))
    most = F.array_max(F.transform(votes, lambda x: x["n"]))
    return F.get(F.filter(votes, lambda x: x["n"] == most), F.lit(0))["value"]


def imbalance(lengths: DataFrame, part: str, balanced: str, length: str) -> DataFrame:
    """Least, most and difference of the parts' sums, as they lie and balanced, and the mean."""
    a = lengths.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"), F.round(F.avg("s"), 4).alias("mean"))
    b = lengths.groupBy(balanced).agg(F.sum(length).alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return a.crossJoin(b)  # one row each


def smoothed(series: Column) -> Column:
    """Exponential smoothing from the first value, with the weight 1.8 (sigmoid(0.05 n) - 0.5) of a series of n. A series is a curve to plot, in one array; the
    time is in proportion to its length."""

    def run(all_series: pd.Series) -> pd.Series:
        out = []
        for v in all_series:
            w = 1.8 * (1 / (1 + math.exp(-0.05 * len(v))) - 0.5) if v is not None else 0.0
            out.append(None if v is None else pd.Series(v, dtype=float).ewm(alpha=1 - w, adjust=False).mean().tolist())
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(series)


def drift(tokens: DataFrame, by: list[str], rollout: Column, actor: Column, mask: Column) -> DataFrame:
    """Correlation of two probabilities of the same tokens, and the largest, mean and deviation of their absolute difference."""
    x = tokens.where(mask != 0).withColumn("__a", rollout).withColumn("__b", actor).withColumn("__d", F.abs(rollout - actor))
    return x.groupBy(*by).agg(F.round(F.corr("__a", "__b"), 5).alias("pearson"), F.round(F.max("__d"), 6).alias("max"), F.round(F.avg("__d"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("__d"), F.lit(0.0)), 6).alias("std"))


def flops(lengths: DataFrame, by: list[str], length: str, params: float, layers: int, heads: int, head_dim: int) -> DataFrame:
    """6 N tokens and 12 times the squared lengths' sum times layers, heads and their width."""
    n = F.col(length).cast("double")
    return lengths.groupBy(*by).agg((6 * params * F.sum(n) + 12 * F.sum(n * n) * layers * heads * head_dim).alias("flops"))


def slowest(df: DataFrame, by: list[str], order: str, *times: str) -> DataFrame:
    """Least, most and mean of each timing, and the row that took longest in all (ties: the smaller)."""
    total = sum((F.col(c) for c in times[1:]), F.col(times[0]))
    out = [f(F.col(c)).alias(f"{c}_{n}") for c in times for n, f in (("min", F.min), ("max", F.max))] + [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in times]
    return df.groupBy(*by).agg(*out, F.max_by(order, F.struct(total, -F.col(order))).alias("slowest"))


def merged_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (n, mean, least, most) a file: the mean by count, mean and sample deviation of the files' means, extremes."""
    return stats.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 4).alias("mean"), F.round(F.avg("mean"), 4).alias("mean_of_means"), F.round(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)), 4).alias("std_of_means"), F.min("least").alias("least"), F.max("most").alias("most"))


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """sample_rank: the place of a row within its key."""
    return df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def answer_em(df: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """One row (em, n_eval): the share of rows whose extracted answers are equal texts; no rows: 0 and 0."""
    same = (pred.eqNullSafe(gold)).cast("double")
    return df.agg(F.round(F.coalesce(F.avg(same), F.lit(0.0)), 6).alias("em"), F.count(F.lit(1)).alias("n_eval"))


def consistency(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """A row a column (name, rows, filled, typed): rows of the table, values that are not null, and whether the type is the one
    named; a batch is consistent where rows = filled and typed hold for all. One pass."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(kinds) if c in types])
    cells = [F.struct(F.lit(c).alias("name"), F.col("rows"), (F.col(f"n{i}") if c in types else F.lit(0).cast("long")).alias("filled"), F.lit(types.get(c) == k).alias("typed")) for i, (c, k) in enumerate(kinds.items())]
    return one.select(F.inline(F.array(*cells)))


def estimated_pass(rates: DataFrame, by: list[str], rate: str, ks: list[int]) -> DataFrame:
    """pass@k of prompts whose share of right answers is `rate`, as 1 - (1 - rate)^k: its mean by group and k."""
    each = rates.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return each.groupBy(*by, "k").agg(F.round(F.avg(1 - F.pow(1 - F.col(rate), F.col("k"))), 6).alias("pass_at_k"))


def weighted_accuracy(rows: DataFrame, by: list[str], accuracy: str, n: str) -> DataFrame:
    """Accuracies of several runs as one, by their number of examples."""
    return rows.groupBy(*by).agg(F.round(F.sum(F.col(accuracy) * F.col(n)) / F.sum(n), 2).alias("accuracy"))


def throughput(rows: DataFrame, by: list[str], tokens: str, seconds: str, devices: int, samples: int, step_seconds: int) -> DataFrame:
    """Milliseconds a token, tokens a second and device, and effective tokens a second: those of `samples` answers over a step's time."""
    n, s = F.sum(tokens), F.sum(seconds)
    return rows.groupBy(*by).agg(F.round(s / n * 1000, 6).alias("ms_per_token"), F.round(n / (s * devices), 6).alias("tokens_per_second"), F.round(n * samples / step_seconds, 4).alias("effective"))


def pairwise_accuracy(rows: DataFrame, by: list[str], chosen: Column, rejected: Column) -> DataFrame:
    """The share of pairs whose chosen answer scores above the rejected one."""
    return rows.groupBy(*by).agg(F.round(F.avg((chosen > rejected).cast("int")), 6).alias("accuracy"))


def op_histogram(rows: DataFrame, op: Column) -> DataFrame:
    """Rows of each op, as text, in its order."""
    return rows.groupBy(op.cast("string").alias("op")).agg(F.count(F.lit(1)).alias("n")).orderBy("op")


def spread(value: str) -> list[Column]:
    """mean, max, min and std of a value over all rows, wherever they lie."""
    return [F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.round(F.stddev_samp(value), 6).alias("std")]


def valid_ratio(mask: str, rate: float, batch: int) -> list[Column]:
    """The share of unmasked tokens, and a learning rate that grows with the root of their number over `batch`."""
    m = F.sum(mask)
    return [F.round(m / F.count(F.lit(1)), 6).alias("ratio"), F.round(rate * F.sqrt(m / batch), 9).alias("lr")]


def validation_pass(df: DataFrame, source: str, uid: str, order: str, value: str, ns: list[int], rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(source, n, best_mean, best_std, worst_mean, worst_std) of best@n and worst@n, bootstrapped by (source, uid), then their mean by source. Prompts of fewer than n answers
    count for no n above their number."""
    one, cells = samples(df, [source, uid], order, value).where(F.size("v") >= min(ns)), []
    for n in ns:
        table = _draws(df.sparkSession, rounds, n, seed)  # grows with the parameters alone
        one = one.withColumns({f"{how}_{n}": _resampled(table, n, how)("v") for how in ("best", "worst")})
        r = [F.round(F.col(f"{how}_{n}")[c], 6).alias(f"{how}_{c}") for how in ("best", "worst") for c in ("mean", "std")]
        cells.append(F.when(F.size("v") >= n, F.struct(F.lit(n).alias("n"), *r)))
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]
    each = one.select(source, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select(source, "c.*")
    return each.groupBy(source, "n").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])


def vote_value(df: DataFrame, by: list[str], vote: str, value: str, order: str) -> DataFrame:
    """The value of each group's most common vote: that of its first row; of equally common votes the one seen first counts."""
    n = df.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias(value))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
