"""Steps that spread narrow tables over tasks, and bootstrap over arrays against its column form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluation as V
from brindle.operators import generate as N
from brindle.operators import relational as R
from brindle.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size, how", [(None, "mean"), (4, "best"), (3, "worst")])
def test_bootstrap_as_columns(spark, size, how):
    rows = [(g, i, float((g * 37 + i * 13) % 29) / 7) for g in range(6) for i in range(1 + g)] + [(9, i, float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, i long, v double")
    got = V.bootstrap(df, ["g"], "i", "v", rounds=1000, size=size, reducer=how)
    want = V._by_columns(V.samples(df, ["g"], "i", "v"), ["g"], 1000, 42, size, V.REDUCERS[how])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_generated_in_many_tasks(spark):
    seeds = spark.range(64).coalesce(1).select(F.col("id").alias("seed"), F.lit(3).alias("op"), F.lit(next(iter(N.TEMPLATES))).alias("template"))
    assert N.forward(seeds).select(F.spark_partition_id().alias("p")).distinct().count() > 4


@pytest.mark.parametrize("name", ["math_equality", "graph_scores", "tool_dialects", "band_candidates"])
def test_narrow_tables_in_many_tasks(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_signature_at_once_or_by_turns():
    long = "".join(chr(97 + i * i % 23) for i in range(3000))
    parts = [R.signature(long[i : i + 804], 5, 64) for i in range(0, 2400, 800)]
    assert (R.signature(long[:2404], 5, 64) == np.minimum.reduce(parts)).all()
