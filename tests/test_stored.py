"""Layouts, sinks, plans and streams on small fixtures."""

import itertools
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import answers as N
from brindle.operators import encoding as E
from brindle.operators import evaluation as V
from brindle.operators import packing as B
from brindle.operators import sampling as S
from brindle.sources import io
from brindle.streaming import replay


def test_scan_eval_of_files(spark, tmp_path):
    top = f"file://{tmp_path}"
    (tmp_path / "one.jsonl").write_text('{"problem": "a", "op": 9}\n\nnot json\n{"problem": "b"}\n')
    got = {(r.problem, r.op, r.split) for r in io.scan_eval(spark, f"{top}/one.jsonl").collect()}
    assert got == {("a", 9, "id"), ("b", None, "id")}
    folder = tmp_path / "ops"
    folder.mkdir()
    (folder / "OP12-medium.jsonl").write_text('{"problem": "c"}\n{"problem": "d", "op": 2}\n')
    (folder / "other.jsonl").write_text('{"problem": "e"}\n')
    got = {(r.problem, r.op, r.split) for r in io.scan_eval(spark, f"{top}/ops", 10).collect()}
    assert got == {("c", 12, "ood"), ("d", 2, "id"), ("e", None, "ood")}
    (folder / "test_200_ood.jsonl").write_text('{"problem": "f", "op": 1}\n')
    assert [(r.problem, r.split) for r in io.scan_eval(spark, f"{top}/ops", 10).collect()] == [("f", "ood")]


def test_checkpoints_in_numeric_order(spark, tmp_path):
    for name in ("checkpoint-13042", "checkpoint-403", "checkpoint-x", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "checkpoint-7").write_text("a file")
    assert io.checkpoints(spark, f"file://{tmp_path}") == ["checkpoint-403", "checkpoint-13042"]


def test_write_once_keeps_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    assert io.write_once(spark.range(2), path) and not io.write_once(spark.range(5), path)
    assert spark.read.json(path).count() == 2
    assert io.write_once(spark.range(5), path, overwrite=True) and spark.read.json(path).count() == 5


def test_scalars():
    assert V.kept_ks([8, 1, 2, 0, 64], 9) == [1, 2, 8, 10]
    assert V.kept_ks([64], 3) == [4]
    assert V.kept_ks([2, 1, 0], -1) == [1, 2]
    assert S.rest_budget(1000, 0.25) == 750
    assert S.rest_budget(1000, 0.25, "12.9 # tokens") == 12
    assert S.rest_budget(10, 2.0) == 0
    with pytest.raises(ValueError):
        S.rest_budget(10, 0.5, "# nothing")


def test_plans_that_cannot_be_met_are_errors(spark):
    rows = spark.range(10).withColumn("c", F.lit("a"))
    for shares in ({"a": 1.5}, {"a": 0.0}, {"b": 0.5}):
        with pytest.raises(ValueError):
            S.context_filter(rows, "c", "id", shares)
    with pytest.raises(ValueError):
        S.mini_batches(rows, ["id"], 3)


def test_scanned_answer_of_texts(spark):
    # by hand: the first lead that a whole number follows counts
    cases = {"Answer: 12. Answer: 13.": 12, "Solution: x. Answer: 7": 7, "**Answer:** 5.": 5, r"\text{answer: } 8": 8, r"\text{Answer: } 8x.": 8, r"is 3. It is -4.": -4, "answer: 6\nnext": 6, "answer: 1.5": 1, "": None, "is x": None}
    x = spark.createDataFrame([*cases.items(), (None, None)], "s string, want long")
    for r in x.withColumn("got", N.scanned_answer(F.col("s"))).collect():
        assert r.got == r.want, r


def test_prompt_key(spark):
    x = spark.createDataFrame([('{"b": {"z": 1, "y": [2, null]}, "a": "é"}',), ("{broken",), ("3",), (None,)], "s string")
    assert [r.k for r in x.select(N.prompt_key(F.col("s")).alias("k")).collect()] == ['{"a":"é","b":{"y":[2,null],"z":1}}', "{broken", "3", None]


def test_equal_partitions():
    lengths = [9, 1, 4, 4, 7, 3, 8, 2]
    part = B.karmarkar_karp(lengths, 2, equal=True)
    assert sorted(part).count(0) == 4
    spread = abs(sum(n if p else -n for n, p in zip(lengths, part, strict=True)))
    best = min(abs(2 * sum(c) - sum(lengths)) for c in itertools.combinations(lengths, 4))
    assert best <= spread <= 2
    for bad in ([1, 2, 3],):
        with pytest.raises(ValueError):
            B.karmarkar_karp(bad, 2, equal=True)
    assert B.karmarkar_karp([], 2, equal=True) == []


def test_late_rows_go_and_runs_go_on(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    source, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    source.mkdir()

    def put(n, rows):
        made = tmp_path / f"made{n}"
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.parquet(f"file://{made}")
        part = next(made.glob("*.parquet"))
        part.rename(source / f"{n}.parquet")
        os.utime(source / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    def run():
        rows = replay.stream(spark, f"file://{source}", "ts timestamp, k string, v double")
        got = replay.replayed(replay.windowed(rows, "ts", "1 hour", "1 hour", "k", "v"), out, state)
        return sorted((r.start.hour, r.n, r.total) for r in got.collect())

    put(1, [(at(1), "a", 1.0), (at(1, 30), "a", 2.0), (at(10), "a", 4.0)])
    put(2, [(at(12), "a", 8.0)])
    # a batch drops rows behind the watermark that the one before it began with: here 9:00
    put(3, [(at(1, 45), "a", 16.0), (at(15), "a", 32.0)])
    assert run() == [(1, 2, 3.0), (10, 1, 4.0), (12, 1, 8.0)]
    put(4, [(at(18), "a", 64.0)])
    assert run() == [(1, 2, 3.0), (10, 1, 4.0), (12, 1, 8.0), (15, 1, 32.0)]


def test_samples_do_not_hang_on_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 50).cast("string").alias("text"), "id")
    a, b = (S.logged_samples(rows.repartition(n), "text", 40).collect() for n in (1, 7))
    assert a == b and len({r.id for r in a}) == 40
    assert S.logged_samples(rows.limit(0), "text", 5).count() == 0


def test_buffers_are_permutations(spark):
    got = S.buffer_shuffled(spark.range(100).repartition(5), ["id"], 32).collect()
    assert all(r.buffer == r.id // 32 == r.position // 32 for r in got)
    assert sorted(r.position for r in got) == list(range(100)) and any(r.position != r.id for r in got)
    with pytest.raises(ValueError):
        S.take_skip(spark.range(3), ["id"], 0.5)


def test_short_prompts_as_the_library_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "one two", "a much longer prompt " * 40, "é ü 中文 " * 3, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = {i for i, s in enumerate(texts) if len(library.encode(s or "", add_special_tokens=False).ids) <= 30}
    assert {r.i for r in E.short_prompts(rows, "s", 30, path).collect()} == want and 0 in want and 3 not in want
