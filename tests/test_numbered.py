"""Rows are numbered exactly at any partitioning, and what hangs on it agrees with its SQL on a table of several partitions."""

import duckdb
import pytest
from pyspark.sql import functions as F
from brindle.operators import sampling as S
from brindle.plans.queries import ORACLE, QUERIES
from tests.test_oracle import rows


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_places_are_exact(spark, tmp_path, parts):
    df = spark.range(20_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"), F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 300).alias("wide")
    )
    keep = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = []
        for i in range(3):
            out = S.numbered(df, ["g"], ["k"], "n")
            out.select("g", "k", "n").write.parquet(f"file://{tmp_path}/{i}")  # without the wide column
            got.append(sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{i}").collect()), key=repr))
        whole = sorted((r.k, r.n) for r in S.numbered(df, [], ["k"], "n").collect())
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.k)
    want = sorted(((g, k, i) for g, ks in groups.items() for i, k in enumerate(sorted(ks))), key=repr)
    assert got[0] == want and got[1] == want and got[2] == want
    assert whole == [(k, i) for i, k in enumerate(sorted(k for ks in groups.values() for k in ks))]


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, k long")
    assert S.numbered(df, ["g"], ["k"], "n").columns == ["g", "k", "n"] and S.numbered(df, ["g"], ["k"], "n").count() == 0 and S.numbered(df, [], ["k"], "n").count() == 0


USERS = "mix_materialize exact_counts gold_round_robin mini_batches take_skip_split stratified_limit limited_splits round_robin_shard context_filter context_sample micro_batch_restore buffer_shuffle chunk_rows interleave_first interleave_all merge_two_one_one num_samples"


@pytest.mark.parametrize("name", USERS.split())
def test_at_ten_times_the_rows(spark, name):
    c, d = duckdb.connect(), "/root/testdata/sf0.1"
    for table in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {table} as select * from '{d}/{table}.parquet'")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        found = [r.asDict() for r in QUERIES[name](spark, d).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    want = c.sql(ORACLE[name])
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert found and rows(found, sorted(want.columns)) == rows(expected, sorted(want.columns))
