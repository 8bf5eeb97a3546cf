"""Layouts, sinks, look-ups, scans of answers and streams run to their end, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import answers as N
from brindle.functions import text as X
from brindle.operators import advantage as A
from brindle.operators import encoding as E
from brindle.operators import evaluation as V
from brindle.operators import packing as B
from brindle.operators import relational as R
from brindle.operators import sampling as S
from brindle.plans.queries import query, t
from brindle.sources import io, registry
from brindle.streaming import replay

SAID = """select p_partkey, case p_partkey % 5 when 0 then 'So. Answer: ' || p_size || '.' when 1 then 'x \\boxed{1} then \\Boxed{' || p_size || '}' when 2 then '**Answer: ' || p_size || '** ok'
  when 3 then 'It is 4. Its number is ' || p_size else 'Answer: ' || p_name || '.' end as s from part"""


@query(
    "scanned_answer",
    f"""select p_partkey, coalesce(try_cast(regexp_extract(l, 'answer: (-?[0-9]+) *(\\.|$)', 1) as bigint), try_cast(regexp_extract(l, '.*oxed.([^}}]*)', 1) as bigint), try_cast(regexp_extract(l, '\\*\\*answer: ([0-9]+)\\*\\*', 1) as bigint),
  try_cast(regexp_extract(l, '.*is ([0-9]+)', 1) as bigint)) as answer from (select p_partkey, lower(s) as l from ({SAID}))""",
)
def _(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("So. Answer: "), size, F.lit(".")))
        .when(k == 1, F.concat(F.lit("x \\boxed{1} then \\Boxed{"), size, F.lit("}")))
        .when(k == 2, F.concat(F.lit("**Answer: "), size, F.lit("** ok")))
        .when(k == 3, F.concat(F.lit("It is 4. Its number is "), size))
        .otherwise(F.concat(F.lit("Answer: "), "p_name", F.lit(".")))
    )
    return t(spark, d, "part").select("p_partkey", N.scanned_answer(said).alias("answer"))


@query("prompt_keys", "select key, count(*) as n from (select case user_id % 3 when 0 then '{\"a\":' || (event_id % 4) || ',\"b\":[1,\"x\"]}' when 1 then event_type else '[' || (event_id % 2) || ',null]' end as key from events) group by 1")
def _(spark, d):
    i, u = F.col("event_id").cast("long"), F.col("user_id") % 3
    a = F.concat(F.lit('"a": '), (i % 4).cast("string"))
    b = F.lit('"b" : [1, "x"]')
    whole = F.when(i % 2 == 0, F.concat(F.lit("{"), a, F.lit(", "), b, F.lit("}"))).otherwise(F.concat(F.lit(" {"), b, F.lit(","), a, F.lit(" }")))
    key = F.when(u == 0, whole).when(u == 1, F.col("event_type")).otherwise(F.concat(F.lit("[ "), (i % 2).cast("string"), F.lit(", null ]")))
    return t(spark, d, "events").groupBy(N.prompt_key(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_line", "select p_partkey, concat_ws(' ', '[BOS]', '<question>', case when p_partkey % 4 <> 0 then p_name end, '</question>', '<solution>', p_type, '</solution>', case when p_partkey % 3 <> 0 then '<answer> ' || p_brand || ' </answer>' end, '[EOS]') as line from part")
def _(spark, d):
    k = F.col("p_partkey")
    solution = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_type", F.lit("\n"))).when(k % 3 == 1, F.concat("p_type", F.lit(" \nAnswer: "), "p_brand", F.lit(". . \nmore"))).otherwise(F.concat("p_type", F.lit("\nAnswer:"), "p_brand"))
    return t(spark, d, "part").select("p_partkey", X.corpus_line(F.when(k % 4 != 0, F.concat("p_name", F.lit("\n"))), F.when(k % 2 == 0, " "), solution).alias("line"))


@query("strict_compose", "select doc_id from documents where regexp_matches(coalesce(text, ''), '[^\\s]') and regexp_matches(coalesce(lang, ''), '[^\\s]') and regexp_matches(coalesce(source, ''), '[^\\s]')")
def _(spark, d):
    return t(spark, d, "documents").where(X.complete(F.col("text"), F.col("lang"), F.col("source"))).select("doc_id")


@query("answer_em", "select round(avg(case when l_quantity::int % 5 = l_linenumber % 5 then 1 else 0 end), 6) as em, count(*) as n_eval from lineitem")
def _(spark, d):
    tag = lambda c: F.concat(F.lit("work <answer> "), (F.col(c).cast("int") % 5).cast("string"), F.lit("</answer>"))
    return V.answer_em(t(spark, d, "lineitem"), X.extract_answer(tag("l_quantity")), X.extract_answer(tag("l_linenumber")))


@query("consistency", "select 'doc_id' as name, count(*) as rows, count(doc_id) as filled, true as typed from documents union all select 'text', count(*), count(text), true from documents union all select 'lang', count(*), count(lang), false from documents union all select 'mask', count(*), 0, false from documents")
def _(spark, d):
    return V.consistency(t(spark, d, "documents"), {"doc_id": "bigint", "text": "string", "lang": "int", "mask": "int"})


@query("checkpoint_order", "select name, row_number() over (order by case when name like 'checkpoint-%' then 0 else 1 end, coalesce(try_cast(replace(name, 'checkpoint-', '') as bigint), 0), name) as place from (select case when s_suppkey % 4 = 0 then 'final-' || s_suppkey else 'checkpoint-' || (s_suppkey * 37 % 1009) end as name from supplier)")
def _(spark, d):
    from pyspark.sql.window import Window

    k = F.col("s_suppkey")
    names = t(spark, d, "supplier").select(F.when(k % 4 == 0, F.concat(F.lit("final-"), k.cast("string"))).otherwise(F.concat(F.lit("checkpoint-"), (k * 37 % 1009).cast("string"))).alias("name"))
    return names.withColumn("place", F.row_number().over(Window.orderBy(*S.checkpoint_order("name"))))  # a row a checkpoint


@query("first_rows", "select c_custkey, b from (select c_custkey, case when c_custkey % 10 = 0 then null else c_nationkey end as b from customer) order by b asc nulls last, c_custkey limit 40")
def _(spark, d):
    x = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("b"))
    return S.first_rows(x, ["b", "c_custkey"], 40)


@query("mini_batches", "select c_custkey, (r // 6)::bigint as batch, r % 6 as place from (select c_custkey, row_number() over (order by c_mktsegment, c_custkey) - 1 as r from customer)")
def _(spark, d):
    return S.mini_batches(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], 6).drop("c_mktsegment")


@query("context_filter", "select mkt, n - ceil(round((1 - p) * n, 9))::bigint as n, round(p / 1.75, 6) as share from (select c_mktsegment as mkt, count(*) as n, case c_mktsegment when 'BUILDING' then 1.0 when 'MACHINERY' then 0.25 when 'FURNITURE' then 0.5 else 0 end::double as p from customer group by 1) where p > 0")
def _(spark, d):
    rows, shares = S.context_filter(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", {"BUILDING": 1.0, "MACHINERY": 0.25, "FURNITURE": 0.5, "HOUSEHOLD": 0.0})
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("c_mktsegment")]
    return rows.groupBy(F.col("c_mktsegment").alias("mkt"), F.round(share, 6).alias("share")).agg(F.count_distinct("c_custkey").alias("n"))


@query("preset_filter", "select c_custkey, c_nationkey from customer where c_mktsegment not in ('BUILDING', 'MACHINERY') or (c_mktsegment = 'BUILDING' and c_nationkey < 5) or (c_mktsegment = 'MACHINERY' and c_nationkey = 7)")
def _(spark, d):
    presets = spark.createDataFrame([("BUILDING", n) for n in range(5)] + [("MACHINERY", 7)], "c_mktsegment string, c_nationkey int")
    return R.preset_filter(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), presets, ["c_mktsegment"], "c_nationkey").drop("c_mktsegment")


@query("micro_batch_restore", "select s_suppkey as row, round(s_acctbal * 2, 4) as result from supplier")
def _(spark, d):
    x = t(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), "s_acctbal")
    dealt = S.numbered(x, [], ["s_acctbal", "row"], "place")
    results = dealt.select("place", F.round(F.col("s_acctbal") * 2, 4).alias("result"))
    return R.restored(results, dealt, "place", "row").select("row", "result")


@query("digest_backfill", "with s as (select digest, min(doc_id) as doc_id from (select sha256(coalesce(text, '')) as digest, doc_id from documents where doc_id % 3 = 0) group by 1) select * from s union all select digest, min(doc_id) from (select sha256(coalesce(text, '')) as digest, doc_id from documents) where digest not in (select digest from s) group by 1")
def _(spark, d):
    x = t(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "doc_id")
    store = x.where("doc_id % 3 = 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return R.backfilled(store, x, "digest", "doc_id")


@query("used_keys", "select distinct l_linenumber as op, l_suppkey as id from lineitem where l_returnflag <> 'N'")
def _(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("op"), F.col("l_suppkey").alias("id"), "l_returnflag")
    return R.used_keys([x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'")], ["op", "id"])


@query("renamed_columns", "select text as problem, lang as question, null::varchar as tools from documents")
def _(spark, d):
    return R.renamed(t(spark, d, "documents"), {"problem": "text", "question": "lang", "tools": "absent"})


@query("balance_equal")
def _(spark, d):
    x = t(spark, d, "events").select((F.col("event_id") / 64).cast("long").alias("batch"), F.col("event_id").cast("long").alias("row"), (F.col("value") % 512).cast("long").alias("length"))
    # equal parts want a number that divides; other batches are balanced by sums alone
    return B.packed(x, "batch", "row", "length", lambda lengths, k: B.karmarkar_karp(lengths, k, equal=len(lengths) % k == 0), 8)


@query("scan_layouts", "select case when n_regionkey <= 2 then 'id' else 'ood' end as split, n_regionkey::bigint as op, count(*) as n from nation group by 1, 2")
def _(spark, d):
    x = t(spark, d, "nation").select(F.col("n_name").alias("problem"), "n_regionkey")
    top = io.shared_folder(spark, "layout")
    for op in range(5):  # a file an op, without the column
        io.append_jsonl(x.where(F.col("n_regionkey") == op).select("problem"), f"{top}/op{op}-x.jsonl")
    return io.scan_eval(spark, top, 2).groupBy("split", "op").agg(F.count(F.lit(1)).alias("n"))


@query("scan_halves", "select case when n_regionkey <= 2 then 'id' else 'ood' end as split, n_name as problem, n_regionkey::bigint as op from nation")
def _(spark, d):
    x = t(spark, d, "nation").select(F.col("n_name").alias("problem"), F.col("n_regionkey").alias("op"))
    top = io.shared_folder(spark, "halves")
    io.append_jsonl(x.where("op <= 2"), f"{top}/test_id")
    io.append_jsonl(x.where("op > 2"), f"{top}/test_ood")
    return io.scan_eval(spark, top).select("split", "problem", "op")


@query("json_sinks", "select r_name, 2::bigint as appended, 1::bigint as kept from region")
def _(spark, d):
    x = t(spark, d, "region").select("r_name")
    top = io.shared_folder(spark, "sinks")
    for _i in range(2):
        io.append_jsonl(x, f"{top}/lines")
    io.write_once(x, f"{top}/once")
    io.write_once(x.unionByName(x), f"{top}/once")  # is there already
    count = lambda name, c: spark.read.schema("r_name string").json(f"{top}/{name}").groupBy("r_name").agg(F.count(F.lit(1)).alias(c))
    return count("lines", "appended").join(count("once", "kept"), "r_name")


@query("summary_sink", "select 'checkpoint-' || s_nationkey as checkpoint, avg_ as total_acc, n::varchar as count_total from (select s_nationkey, round(avg(s_acctbal), 2)::varchar as avg_, count(*) as n from supplier group by 1)")
def _(spark, d):
    x = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 2).alias("total_acc"), F.count(F.lit(1)).alias("count_total"))
    top = io.shared_folder(spark, "summary")
    io.write_summary(x.withColumn("checkpoint", F.concat(F.lit("checkpoint-"), F.col("s_nationkey").cast("string"))), top)
    return spark.read.option("header", True).csv(top).select("checkpoint", "total_acc", "count_total")


@query("generation_sink", "select l_suppkey, string_agg(l_linenumber::varchar, ',' order by l_orderkey, l_linenumber) as responses from lineitem group by 1")
def _(spark, d):
    top = io.shared_folder(spark, "generations")
    io.write_generations(t(spark, d, "lineitem").withColumn("text", F.col("l_linenumber").cast("string")), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "text", top)
    return spark.read.parquet(top).select("l_suppkey", F.array_join("responses", ",").alias("responses"))


@query("step_sink", "select r_regionkey as step, count(*) as n from region, nation where n_regionkey = r_regionkey group by 1")
def _(spark, d):
    x = t(spark, d, "nation").select(F.col("n_regionkey").alias("step"), F.col("n_name").alias("output"))
    top = io.shared_folder(spark, "steps")
    io.write_steps(x, top)
    io.write_steps(x.where("step = 1"), top)  # written again: replaced
    return spark.read.json(top).groupBy(F.col("step").cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"))


def events(spark, d):
    # watermarks want a time with a zone
    return replay.stream(spark, f"{d}/events*.parquet", t(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(spark, d):
    top = io.shared_folder(spark, "windows")
    out = replay.replayed(replay.windowed(events(spark, d), "ts", "1 hour", "1 day", "event_type", "value"), f"{top}/out", f"{top}/state", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_seen", "select distinct user_id, event_type from events")
def _(spark, d):
    top = io.shared_folder(spark, "seen")
    found = replay.first_seen(events(spark, d), "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    return replay.replayed(found, f"{top}/out", f"{top}/state")


@query(
    "exact_counts",
    """with q as (select *, case l_linenumber when 1 then 40 when 2 then 25 when 3 then 100000 end - case l_linenumber when 1 then 15 else 0 end as want from lineitem where l_linenumber <= 3),
  r as (select *, row_number() over (partition by l_linenumber, l_returnflag, l_linestatus order by l_orderkey) as turn from q), p as (select *, row_number() over (partition by l_linenumber order by turn, l_returnflag, l_linestatus, l_orderkey) as place from r)
  select l_orderkey, l_linenumber, l_returnflag, l_linestatus from p where place <= want""",
)
def _(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    done = spark.createDataFrame([(1, 9), (1, 6)], "l_linenumber int, n long")
    return S.exact_counts(x, "l_linenumber", ["l_returnflag", "l_linestatus"], ["l_orderkey"], {1: 40, 2: 25, 3: 100_000}, done)


@query("limited_splits", "select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_linenumber order by l_orderkey) as r from lineitem where l_linenumber between 2 and 5) where r <= 30")
def _(spark, d):
    return S.limited_splits(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", ["l_orderkey"], 2, 5, 30)


@query("take_skip_split", "select event_id, case when row_number() over (order by ts, event_id) <= 100 then 'validation' else 'train' end as split from events")
def _(spark, d):
    return S.take_skip(t(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 100).drop("ts")


@query("buffer_shuffle", "select event_id, ((row_number() over (order by ts, event_id) - 1) // 128)::bigint as buffer from events")
def _(spark, d):
    return S.buffer_shuffled(t(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 128).drop("ts", "position")


@query("validation_log")
def _(spark, d):
    return S.logged_samples(t(spark, d, "conversations").select("text", "conv_id", "turn"), "text", 20)


@query("adaptive_kl", "select event_id, round(0.2 * product(1 + greatest(-0.2, least(0.2, (value % 3) / 1.5 - 1)) * 64 / 1000.0::double) over (partition by user_id order by event_id), 8) as kl_coef from events")
def _(spark, d):
    x = t(spark, d, "events").select("event_id", "user_id", (F.col("value") % 3).alias("kl"), F.lit(64).alias("n"))
    return A.adaptive_kl(x, ["user_id"], "event_id", "kl", "n", 0.2, 1.5, 1000.0).select("event_id", F.round("kl_coef", 8).alias("kl_coef"))


@query("exact_dedup_short", "select lang, min(doc_id) as doc_id, count(*) as copies from documents group by lang, coalesce(text, ''), coalesce(source, '')")
def _(spark, d):
    return R.exact_dedup(t(spark, d, "documents"), ["lang"], ["text", "source"], "doc_id", short=True).drop("digest")


@query("short_prompts")
def _(spark, d):
    import public_tokenizers

    return E.short_prompts(t(spark, d, "conversations").select("conv_id", "turn", "text"), "text", 64, public_tokenizers.path("word_bpe_49k.json")).select("conv_id", "turn")


@query("registry_scan", "select 'nations' as dataset, n_nationkey::bigint as id, n_name as text from nation union all select 'regions', r_regionkey, r_name from region union all select 'parts', p_partkey, p_name from part")
def _(spark, d):
    top = io.shared_folder(spark, "registry")
    t(spark, d, "nation").write.parquet(f"{top}/nations.parquet")
    t(spark, d, "region").write.option("header", True).csv(f"{top}/regions.csv")
    t(spark, d, "part").select(F.col("p_partkey").alias("op"), F.col("p_name").alias("problem")).write.json(f"{top}/parts")
    rows = [("nations", "file", f"{top}/nations.parquet", '{"id": "n_nationkey", "text": "n_name"}', None, None), ("regions", "file", f"{top}/regions.csv", '{"id": "r_regionkey", "text": "r_name"}', '{"header": "true"}', None), ("parts", "tree", f"{top}/parts", '{"id": "op", "text": "problem"}', None, None), ("small", None, None, None, None, "nations,regions")]
    e = registry.entries(spark.createDataFrame(rows, "name string, kind string, path string, columns string, options string, parts string"))
    return registry.load(spark, e, ["small", "parts"]).select("dataset", F.col("id").cast("long").alias("id"), "text")


@query("rollout_cache", "select p_partkey, upper(p_name) as answer from part")
def _(spark, d):
    top = io.shared_folder(spark, "rollouts")
    p = t(spark, d, "part").select("p_partkey", "p_name")
    made = registry.rollouts(spark, top, p, {"n": 1}, lambda x: x.select("p_partkey", F.upper("p_name").alias("answer")))
    hit = registry.rollouts(spark, top, p.repartition(5), {"n": 1}, lambda x: x.select("p_partkey", F.raise_error(F.lit("made twice")).cast("string").alias("answer")))
    return hit.select(made.columns)
