"""Streams that keep state, grow or change their draw: restarts in the middle give what an unbroken run gives."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.streaming import episodes as S
from brindle.streaming import growing as W
from brindle.streaming import replay

TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def fold(turns, max_turns, max_size):
    out = {}
    for conv, _, role, text in sorted((t for t in turns if t[2] in S.ROLES and t[0] is not None), key=lambda t: (t[0], t[1], t[2], t[3] or "")):
        state, n, a, u, size = out.get(conv, ("pending", 0, 0, 0, 0))
        if state != "terminated":
            n += 1
            if role == "assistant":
                a, size = a + 1, size + len(text or "")
                state = "terminated" if a >= max_turns or size >= max_size else "processing_tools" if "<tool_call>" in (text or "") else "interacting"
            elif role != "system":
                u, state = u + (role == "user"), "generating"
            out[conv] = (state, n, a, u, size)
    return out


def test_episodes_restart_in_the_middle(spark, tmp_path):
    turns = []
    for c in range(30):
        for k in range(c % 9 + 1):
            role = ["system", "user", "assistant", "tool", "assistant", "user", "assistant", "user", "assistant"][k]
            turns.append((c, k, role, None if c == 5 else "<tool_call> x" if k == 2 and c % 2 else "words " * (c % 7)))
    turns += [(None, 0, "user", "x"), (40, 0, "other", "x"), (41, 0, None, "x"), (42, 1, "assistant", "b"), (42, 1, "assistant", "b")]
    top = f"file://{tmp_path}"
    for k in range(9):  # a file a turn
        rows = [(*t, None) for t in turns if t[1] == k]
        spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{top}/in/turn={k}0")
    schema = spark.createDataFrame([], TURNS).schema
    with replay.configured(spark, {"spark.sql.streaming.stateStore.providerClass": S.STORE}):
        source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{top}/in")
        broken = []

        def put(batch, n):
            if n == 4 and not broken:
                broken.append(n)
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{top}/out/batch={n}")

        for _ in range(2):
            run = S.episodes(source(), 3, 60).writeStream.outputMode("update").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(put).start()
            try:
                run.awaitTermination()
            except Exception as e:
                assert "lost" in str(e)
        assert broken
    got = {r.conv_id: (r.state, r.turns, r.assistant_turns, r.user_turns, r.size) for r in S.latest(spark.read.parquet(f"{top}/out")).collect()}
    assert got == fold(turns, 3, 60) and {s[0] for s in got.values()} == {"pending", "generating", "processing_tools", "interacting", "terminated"}


def test_idle_episodes_end(spark, tmp_path):
    top, base = f"file://{tmp_path}", 1_700_000_000
    for k, rows in enumerate([[(1, 0, "user", "a", 0), (2, 0, "user", "b", 0)], [(2, 1, "assistant", "c", 50)], [(3, 0, "user", "d", 90)], [(3, 1, "assistant", "e", 95)]]):
        x = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, m int")
        x.select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.lit(base) + 60 * F.col("m")).alias("ts")).coalesce(1).write.parquet(f"{top}/in/{k}")
    schema = spark.read.parquet(f"{top}/in/0").schema
    with replay.configured(spark, {"spark.sql.streaming.stateStore.providerClass": S.STORE}):
        for _ in range(2):
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{top}/in")
            rows = replay.replayed(S.episodes(source, ts="ts", idle="60 minutes"), f"{top}/out", f"{top}/state", "update")
            got = {r.conv_id: r.state for r in S.latest(rows).collect()}
    assert got == {1: "terminated", 2: "interacting", 3: "interacting"}


def test_growing_serves_each_row_once(spark, tmp_path):
    top = f"file://{tmp_path}"
    start = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, v int")
    start.repartition(3).write.parquet(f"{top}/pool/start")
    broken = []

    def more(batch):
        if batch.where("v = 2").count() and len(broken) < 2:
            broken.append(1)
            raise RuntimeError("lost")
        return batch.where("v > 0").select((F.col("id") + 100).alias("id"), (F.col("v") - 1).alias("v"))

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            W.grown(spark, f"{top}/pool", start.schema, more, f"{top}/out", f"{top}/state")
    rows = W.grown(spark, f"{top}/pool", start.schema, more, f"{top}/out", f"{top}/state").collect()
    want = sorted((i + 100 * k, i % 5 - k) for i in range(40) for k in range(i % 5 + 1))
    assert sorted((r.id, r.v) for r in rows) == want
    again = W.grown(spark, f"{top}/pool", start.schema, more, f"{top}/out", f"{top}/state").count()
    assert again == len(want)


def test_curriculum_goes_on_where_it_broke_off(spark, tmp_path):
    pool = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("c")).unionByName(spark.createDataFrame([(900, 9)], "k long, c int"))
    start = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0)], "c int, weight double")
    broken = []

    def rewarded(batch):
        if broken == [1]:
            broken.append(2)
            raise RuntimeError("lost")
        broken.append(1)
        return batch.withColumn("reward", (F.col("c") == 0).cast("double"))

    args = (pool, start, "c", "k", rewarded)
    with pytest.raises(RuntimeError):
        W.curriculum(*args, f"file://{tmp_path}/a", 3, 60)
    a = sorted(map(tuple, W.curriculum(*args, f"file://{tmp_path}/a", 3, 60).select("step", "k", "c").collect()))
    b = sorted(map(tuple, W.curriculum(*args, f"file://{tmp_path}/b", 3, 60).select("step", "k", "c").collect()))
    assert a == b and len(a) == 180 and len({(s, k) for s, k, _ in a}) == 180 and not {c for _, _, c in a} & {2, 9}
    share = [sum(c == 1 for s, _, c in a if s == step) for step in range(3)]
    assert share[0] < share[1] < share[2]  # what is never rewarded is drawn more and more
    w = {r.c: r.weight for r in W.weights_after(spark, f"file://{tmp_path}/a", 2).collect()}
    assert abs(w[0] - math.exp(-1.5)) < 1e-9 and abs(w[1] - math.exp(1.5)) < 1e-9 and w[2] == 0.0
