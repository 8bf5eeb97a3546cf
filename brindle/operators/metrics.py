"""Aggregations: pass@k, rollups, length statistics, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased 1 - C(n - c, k) / C(n, k), as a running product; 0 if k <= 0, n < k or c <= 0."""
    i = F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1)
    miss = F.aggregate(i, F.lit(1.0), lambda a, x: a * F.greatest(F.lit(0.0), F.try_divide((n - c - x).cast("double"), (n - x).cast("double"))))
    return F.when((k <= 0) | (n < k) | (c <= 0), 0.0).when(n - c < k, 1.0).otherwise(1 - miss)


def pass_series(prompts: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Mean pass@k by group over prompts (n, c) with n >= k; a group without such a prompt has 0."""
    long = prompts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    long = long.withColumn("p", F.when(F.col("n") >= F.col("k"), pass_at_k(F.col("n"), F.col("c"), F.col("k"))))
    return long.groupBy(*by, "k").agg(F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 6).alias("pass_at_k"), F.count("p").alias("prompts"))


def earliest_pass(samples: DataFrame, by: list[str], prompt: list[str], ks: list[int]) -> DataFrame:
    """Share of prompts whose least successful sample_rank is below k, for every grouping of `by` in turn."""
    first = samples.groupBy(*by, *prompt).agg(F.min(F.when(F.col("perfect"), F.col("sample_rank"))).alias("first"))
    rates = [F.round(F.avg((F.coalesce(F.col("first") < k, F.lit(False))).cast("double")), 6).alias(f"pass_{k}") for k in ks]
    return first.cube(*by).agg(F.count(F.lit(1)).alias("prompts"), *rates)


def trapezoid(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """100 times the area under y over x; fewer than two points: 0."""
    w = Window.partitionBy(*by).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("__a", area).groupBy(*by).agg(F.round(100 * F.coalesce(F.sum("__a"), F.lit(0.0)), 4).alias("auc"))


def length_stats(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Count, mean, median, sample deviation (one row: 0), least and most of characters and words."""
    out = [F.count(F.lit(1)).alias("n")]
    for name, c in (("chars", F.length(text)), ("words", F.regexp_count(text, F.lit(r"\S+")))):
        out += [F.round(F.avg(c), 4).alias(f"{name}_mean"), F.median(c).alias(f"{name}_median"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return df.groupBy(*by).agg(*out)


def length_cdf(df: DataFrame, length: Column, interval: int) -> DataFrame:
    """Rows by length bucket with running count and percentage. The window runs over buckets only."""
    counts = df.groupBy((F.floor(length / interval) * interval).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("bucket"))
    return counts.withColumn("running", run).withColumn("percent", F.round(100 * F.col("running") / F.sum("n").over(Window.partitionBy()), 4))


def majority(votes: DataFrame, by: list[str], vote: str, order: str) -> DataFrame:
    """The most common vote by group; of equals the first seen."""
    n = votes.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(vote, "n"), F.struct(F.col("n"), -F.col("first"))).alias("best")
    return n.groupBy(*by).agg(best).select(*by, F.col(f"best.{vote}").alias("majority"), F.col("best.n").alias("votes"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """mean@N and population std@N by (source, uid), then their mean by source."""
    one = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return one.groupBy(source).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("std"), F.count(F.lit(1)).alias("uids"))


def solved_views(results: DataFrame, template: str, op: str, prompt: list[str], ks: list[int]) -> DataFrame:
    """Share of prompts first solved below rank k, by (template, op), by either and in all.

    results: (template, op, prompt.., perfect, sample_rank). Prompts are reduced once, before the cube."""
    first = results.groupBy(template, op, *prompt).agg(F.min(F.when(F.col("perfect"), F.col("sample_rank"))).alias("rank"))
    share = [F.round(F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("int")), 6).alias(f"pass_{k}") for k in ks]
    return first.cube(template, op).agg(F.count(F.lit(1)).alias("prompts"), *share)


def counters(df: DataFrame, template: str, **flags: Column) -> DataFrame:
    """Rows and true flags by template and in all (template null); rows without a template count as `__none__`."""
    named = df.withColumn("template", F.coalesce(F.nullif(F.col(template), F.lit("")), F.lit("__none__")))
    return named.rollup("template").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def unused_gold(gold: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Gold keys that nothing used: their number less the distinct used ones, 0 at least."""
    a, b = gold.agg(F.count(F.lit(1)).alias("gold")), used.agg(F.count_distinct(*key).alias("used"))
    return a.crossJoin(b).select("gold", "used", F.greatest(F.col("gold") - F.col("used"), F.lit(0)).alias("unused"))  # one row each


def explained(df: DataFrame, by: list[str], returns: Column, values: Column) -> DataFrame:
    """Explained variance of a value function: 1 - var(returns - values) / (var(returns) + 1e-5)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5), 5).alias("explained"))


def source_reward(df: DataFrame, source: str, row: str, reward: str) -> DataFrame:
    """Mean reward by source: over a row's responses first, then over rows."""
    one = df.groupBy(source, row).agg(F.avg(reward).alias("r"))
    return one.groupBy(source).agg(F.count("r").alias("rows"), F.round(F.avg("r"), 6).alias("reward"))


def split_of_sources(df: DataFrame, source: str, value: str, id_max: int) -> DataFrame:
    """Mean value by whether the whole number that ends a source's name is at most id_max; names without one are left out."""
    op = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return df.withColumn("__op", op).where("__op is not null").groupBy(F.when(F.col("__op") <= id_max, "id").otherwise("ood").alias("split")).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))


def perplexity(tokens: DataFrame, seq: str, nll: str, mask: str) -> DataFrame:
    """Mean over sequences of exp(masked mean loss); sequences without unmasked tokens are left out."""
    one = tokens.groupBy(seq).agg(F.sum(F.col(nll) * F.col(mask)).alias("s"), F.sum(mask).alias("m")).where("m > 0")
    return one.agg(F.count("m").alias("sequences"), F.round(F.avg(F.exp(F.col("s") / F.col("m"))), 5).alias("perplexity"))


def choice_accuracy(df: DataFrame, category: str, scores: dict[str, Column], gold: Column) -> DataFrame:
    """Percentage by category, and of all as `Average`, of rows whose best choice (ties: the first) is gold."""
    best, pick = F.greatest(*scores.values()), F.lit(None).cast("string")
    for name, c in reversed(scores.items()):
        pick = F.when(c == best, name).otherwise(pick)
    out = df.select(F.col(category).alias("category"), F.coalesce(pick == gold, F.lit(False)).cast("int").alias("ok")).where("category is not null")
    return out.rollup("category").agg(F.count("ok").alias("n"), F.round(100 * F.avg("ok"), 2).alias("accuracy")).withColumn("category", F.coalesce("category", F.lit("Average")))


def length_spine(df: DataFrame, group: str, text: str, low: int = 2, high: int = 20) -> DataFrame:
    """Rows and mean characters of each group low..high, groups without rows included."""
    spine = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "group")
    one = df.groupBy(F.col(group).cast("long").alias("group")).agg(F.count(text).alias("n"), F.round(F.avg(F.length(text)), 4).alias("mean"))
    return spine.join(one, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def context_totals(df: DataFrame, context: str, difficulty: str, op: str, text: str) -> DataFrame:
    """Rows, total and mean characters by context, by difficulty within, and by op within (null: all)."""
    n = F.length(text)
    return df.rollup(context, difficulty, op).agg(F.count(n).alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean"))
