"""Registered datasets and stored results."""

import pytest
from pyspark.sql import functions as F

from brindle.sources import io, registry


def test_registered_layouts(spark, tmp_path):
    top = f"file://{tmp_path}"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string").write.parquet(f"{top}/x.parquet")
    spark.createDataFrame([("3", "c")], "key string, text string").write.option("header", True).csv(f"{top}/y.csv")
    (tmp_path / "z" / "deep").mkdir(parents=True)
    (tmp_path / "z" / "deep" / "op4.jsonl").write_text('{"problem": "d"}\nnot json\n{"problem": "e", "op": 2}\n')
    table = [
        ("x", "file", f"{top}/x.parquet", '{"id": "k", "text": "t"}', None, None), ("y", "file", f"{top}/y.csv", '{"id": "key", "text": "text"}', '{"header": "true"}', None),
        ("z", "tree", f"{top}/z", '{"id": "op", "text": "problem", "more": "absent"}', None, None), ("h", "halves", f"{top}/z", None, None, None), ("all", None, None, None, None, "x, yz"), ("yz", None, None, None, None, "y,z"),
        ("gone", "file", f"{top}/nothing.parquet", None, None, None), ("odd", "other", "", None, None, None), ("circle", None, None, None, None, "x,circle"),
    ]
    e = registry.entries(spark.createDataFrame(table, "name string, kind string, path string, columns string, options string, parts string"))
    got = sorted((str(r.id), r.text, r.dataset, r.more) for r in registry.load(spark, e, ["all"]).collect())
    assert got == [("1", "a", "x", None), ("2", "b", "x", None), ("2", "e", "z", None), ("3", "c", "y", None), ("None", "d", "z", None)]
    assert {(r.problem, r.op, r.split) for r in registry.load(spark, e, ["h"]).collect()} == {("d", 4, "id"), ("e", 2, "id")}
    for name, error in (("none", KeyError), ("odd", ValueError), ("circle", ValueError)):
        with pytest.raises(error):
            registry.load(spark, e, [name])
    with pytest.raises(ValueError):
        registry.load(spark, e, [])
    with pytest.raises(ValueError):
        registry.entries(spark.createDataFrame([("x", "file", ""), ("x", "tree", "")], "name string, kind string, path string"))


def test_results_are_stored_once(spark, tmp_path):
    top, made = f"file://{tmp_path}/store", []
    prompts = spark.range(50).select("id", F.concat(F.lit("p"), "id").alias("text"))

    def generate(df):
        made.append(1)
        return df.withColumn("answer", F.upper("text"))

    call = lambda df, n=4, **more: sorted(r.answer for r in registry.rollouts(spark, top, df, {"n": n}, generate, **more).collect())
    first = call(prompts)
    assert call(prompts.repartition(7).orderBy(F.desc("id"))) == first and len(made) == 1  # a hit, whatever the order
    call(prompts, n=5)
    call(prompts.where("id > 0"))
    assert len(made) == 3
    call(prompts, refresh=True)
    assert len(made) == 4
    at = tmp_path / "store" / registry.address({"settings": {"n": 4}, "prompts": registry.content(prompts)})
    (at / "_SUCCESS").unlink()  # torn
    assert call(prompts) == first and len(made) == 5 and (at / "_SUCCESS").exists()

    def twice():  # another writer comes first
        registry.reused(spark, top, {"k": 1}, lambda: spark.range(3))
        return spark.range(9)

    assert registry.reused(spark, top, {"k": 1}, twice).count() == 3
    assert not [p for p in (tmp_path / "store").rglob(".new-*") if p.is_dir()]
    with pytest.raises(RuntimeError):
        registry.reused(spark, top, {"k": 2}, lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    assert not io.exists(spark, f"{top}/{registry.address({'k': 2})}")
