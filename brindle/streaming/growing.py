"""Data that changes with the batches served from it: a table that grows by what each batch gives, and a sampler whose weights follow rewards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources import io


def grown(spark: SparkSession, folder: str, schema, more: Callable[[DataFrame], DataFrame], out: str, state: str, files: int = 1, rounds: int = 1000) -> DataFrame:
    """Serves the rows of the Parquet files in `folder` in batches of `files` files until none is left; after each batch the rows more(batch) join the folder and are served
    too. Returns all rows served, with their batch.

    A batch and what it gave are written under its number, so one that broke off and runs again replaces itself, and each row is served once. `state` is
    the stream's checkpoint: a call with the same folders goes on where the last one stopped."""

    def serve(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        new = more(spark.read.schema(batch.schema).parquet(f"{out}/batch={n}"))
        if not new.isEmpty():
            # one file a partition, moved in whole: a stream never sees half of it
            new.write.mode("overwrite").parquet(f"{folder}/grown-{n:08d}")

    names = [f.name for f in schema.fields]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    for _ in range(rounds):
        run = source.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(serve).start()
        run.awaitTermination()
        if not run.recentProgress or not any(p["numInputRows"] for p in run.recentProgress):
            break
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, batch int").parquet(out).select(*names, "batch")


def uniform(seed: int, step: int, key: Column) -> Column:
    """A number above 0 and at most 1 for a step and a row: the first 32 bits of sha256(seed:step:key)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), key.cast("string"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") + 1) / F.lit(float(1 << 32))


def draw(pool: DataFrame, weights: DataFrame, by: str, key: str, n: int, step: int, seed: int = 42) -> DataFrame:
    """n rows of pool without replacement, each class of `by` in proportion to its weight: the n least of -log(u) / weight. Each task keeps n before they meet; classes of no
    weight are not drawn."""
    x = pool.join(weights.where("weight > 0"), by).withColumn("__race", -F.log(uniform(seed, step, F.col(key))) / F.col("weight"))
    return x.orderBy("__race", key).limit(n).select(*pool.columns)


def updated(weights: DataFrame, rewards: DataFrame, by: str, target: float, rate: float) -> DataFrame:
    """Weights after a batch's rewards (by, reward): a class does better than `target` on average and loses weight, or worse and gains: times exp(rate * (target - mean)). Classes
    without a reward keep theirs."""
    mean = rewards.groupBy(by).agg(F.avg("reward").alias("__mean"))
    return weights.join(mean, by, "left").select(by, (F.col("weight") * F.exp(rate * (target - F.coalesce("__mean", F.lit(float(target)))))).alias("weight"))


def curriculum(pool: DataFrame, start: DataFrame, by: str, key: str, rewarded: Callable[[DataFrame], DataFrame], folder: str, steps: int, n: int, target: float = 0.5, rate: float = 1.0, seed: int = 42) -> DataFrame:
    """(step, pool's columns, reward) of `steps` batches of n rows, each drawn by the weights that the batch before has left; start: (by, weight). rewarded: a batch -> the batch with
    reward.

    Each step's batch and weights are tables of the folder, written batch first; a step whose weights are there is done, so a run that broke off goes on, and one that broke off in a step
    draws the same batch again. Weights are a row a class."""
    spark, weights = pool.sparkSession, start.select(by, F.col("weight").cast("double").alias("weight"))
    for step in range(steps):
        batch, after = f"{folder}/batches/step={step}", f"{folder}/weights-{step:06d}"
        if not io.exists(spark, f"{after}/_SUCCESS"):
            rewarded(draw(pool, weights, by, key, n, step, seed)).write.mode("overwrite").parquet(batch)
            updated(weights, spark.read.parquet(batch), by, target, rate).write.mode("overwrite").parquet(after)
        weights = spark.read.parquet(after)
    return spark.read.option("basePath", f"{folder}/batches").parquet(*[f"{folder}/batches/step={i}" for i in range(steps)])


def weights_after(spark: SparkSession, folder: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/weights-{step:06d}")

