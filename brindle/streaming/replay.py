"""Structured Streaming over files: windowed aggregates with late data, incremental deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session within a block; what was there before comes back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def windowed(events: DataFrame, ts: str, length: str, late: str, by: str, value: str, slide: str | None = None) -> DataFrame:
    """Sums and counts by windows of a length, one every `slide` (null: end to end); rows later than `late` go. Works on streams and tables alike."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: str, value: str) -> DataFrame:
    """Sums and counts of each key's sessions: rows less than `gap` apart; a session ends a gap after its last row. Rows later than `late` go. Works on streams and tables alike."""
    one = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return one.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Drops repeats within the watermark, so that state stays bounded."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def replayed(stream_of: DataFrame, out: str, state: str, mode: str = "append") -> DataFrame:
    """Runs a stream over the files that are there, to its end, and returns what it gave. `complete` results replace each other, `append`
    results add up; state is the checkpoint, from which a run that broke off goes on. A batch written twice replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    run = stream_of.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return stream_of.sparkSession.read.schema(stream_of.schema).parquet(out).select(*stream_of.columns)
