"""The operators over the driver's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import text as X
from brindle.operators import advantage as A
from brindle.operators import evaluation as V
from brindle.operators import metrics as M
from brindle.operators import packing as B
from brindle.operators import relational as R
from brindle.streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PROMPTS = "select l_linenumber as op, l_suppkey as prompt, count(*) as n, sum(case when l_returnflag='R' then 1 else 0 end) as c from lineitem group by 1, 2"
KS = [1, 2, 4, 8, 16, 32, 64]
PASS = "case when n - c < k then 1.0 else 1 - list_reduce(list_prepend(1.0, list_transform(range(0, k), lambda i: (n - c - i)::double / (n - i))), lambda a, b: a * b) end"


@query("passk_by_op", f"with p as ({PROMPTS}), q as (select op, n, c, unnest([1,2,4,8,16,32,64]) as k from p) select op, k, round(coalesce(avg(case when n < k then null when c <= 0 then 0.0 else {PASS} end), 0), 6) as pass_at_k, count(*) filter (n >= k) as prompts from q group by op, k")
def _(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("op"), F.col("l_suppkey").alias("prompt")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("c"))
    return M.pass_series(rows, ["op"], KS)


@query("accuracy_rollup", "select case when l_linenumber <= 4 then 'id' else 'ood' end as split, l_linenumber as op, count(*) as total, sum(case when l_returnflag='R' then 1 else 0 end) as correct, round(avg(case when l_returnflag='R' then 1.0 else 0.0 end), 6) as accuracy from lineitem group by grouping sets ((1, 2), (1), ())")
def _(spark, d):
    x = t(spark, d, "lineitem").select(X.categorize(F.col("l_linenumber"), 4).alias("split"), F.col("l_linenumber").alias("op"), (F.col("l_returnflag") == "R").cast("int").alias("ok"))
    return x.rollup("split", "op").agg(F.count("ok").alias("total"), F.sum("ok").alias("correct"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("earliest_pass", "with s as (select l_linenumber as op, l_linestatus as template, l_suppkey as prompt, l_returnflag='R' as perfect, row_number() over (partition by l_linenumber, l_linestatus, l_suppkey order by l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 as sample_rank from lineitem), f as (select op, template, prompt, min(case when perfect then sample_rank end) as first from s group by 1, 2, 3) select template, op, count(*) as prompts, round(avg(case when first < 1 then 1.0 else 0.0 end), 6) as pass_1, round(avg(case when first < 4 then 1.0 else 0.0 end), 6) as pass_4, round(avg(case when first < 16 then 1.0 else 0.0 end), 6) as pass_16 from f group by cube (template, op)")
def _(spark, d):
    keys = ["op", "template", "prompt"]
    x = t(spark, d, "lineitem").withColumnsRenamed({"l_linenumber": "op", "l_linestatus": "template", "l_suppkey": "prompt"})
    order = Window.partitionBy(*keys).orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    x = x.select(*keys, (F.col("l_returnflag") == "R").alias("perfect"), (F.row_number().over(order) - 1).alias("sample_rank"))
    return M.earliest_pass(x, ["template", "op"], ["prompt"], [1, 4, 16])


@query("estimated_pass", "with p as (select l_linenumber as op, l_suppkey, avg(case when l_returnflag='R' then 1.0 else 0.0 end) as p from lineitem group by 1, 2) select op, k, round(avg(1 - pow(1 - p, k)), 6) as pass_at_k from (select op, p, unnest([1,2,4,8]) as k from p) group by 1, 2")
def _(spark, d):
    p = t(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("op"), "l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p"))
    return V.estimated_pass(p, ["op"], "p", [1, 2, 4, 8])


@query("weighted_accuracy", "select o_orderpriority as model, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 2) as accuracy from orders group by 1")
def _(spark, d):
    return V.weighted_accuracy(t(spark, d, "orders").withColumn("model", F.col("o_orderpriority")), ["model"], "o_totalprice", "o_custkey")


@query("trapezoid_auc", "with p as (select event_type, user_id % 20 as x, avg(value) as y from events group by 1, 2), w as (select event_type, (x - lag(x) over q) * (y + lag(y) over q) / 2 as a from p window q as (partition by event_type order by x)) select event_type, round(100 * coalesce(sum(a), 0), 4) as auc from w group by 1")
def _(spark, d):
    p = t(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).alias("x")).agg(F.avg("value").alias("y"))
    return M.trapezoid(p, ["event_type"], "x", "y")


@query("length_stats", "select lang, source, count(*) as n, round(avg(length(text)), 4) as chars_mean, median(length(text)) as chars_median, round(coalesce(stddev_samp(length(text)), 0), 4) as chars_std, min(length(text)) as chars_min, max(length(text)) as chars_max, round(avg(w), 4) as words_mean, median(w) as words_median, round(coalesce(stddev_samp(w), 0), 4) as words_std, min(w) as words_min, max(w) as words_max from (select *, len(regexp_extract_all(text, '\\S+')) as w from documents) group by 1, 2")
def _(spark, d):
    return M.length_stats(t(spark, d, "documents"), ["lang", "source"], "text")


@query("length_cdf", "with b as (select length(text) // 500 * 500 as bucket, count(*) as n from documents group by 1) select bucket, n, sum(n) over (order by bucket) as running, round(100 * sum(n) over (order by bucket) / sum(n) over (), 4) as percent from b")
def _(spark, d):
    return M.length_cdf(t(spark, d, "documents"), F.length("text"), 500)


@query("majority_vote", "with v as (select o_custkey, o_orderpriority as vote, count(*) as n, min(o_orderkey) as first from orders group by 1, 2) select o_custkey, vote as majority, n as votes from v qualify row_number() over (partition by o_custkey order by n desc, first) = 1")
def _(spark, d):
    return M.majority(t(spark, d, "orders").withColumn("vote", F.col("o_orderpriority")), ["o_custkey"], "vote", "o_orderkey")


@query("validation_metrics", "with u as (select l_linenumber as source, l_orderkey as uid, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1, 2) select source, round(avg(m), 6) as mean, round(avg(s), 6) as std, count(*) as uids from u group by 1")
def _(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("uid"), "l_quantity")
    return M.validation(x, "source", "uid", "l_quantity")


SCORES = "select l_orderkey as uid, l_linenumber as i, l_partkey as p, l_suppkey as q, l_quantity as s, l_extendedprice as x, l_discount as dd, l_tax as tt, l_shipdate as sd from lineitem"


def scores(spark, d) -> DataFrame:
    names = {"l_orderkey": "uid", "l_linenumber": "i", "l_partkey": "p", "l_suppkey": "q", "l_quantity": "s", "l_extendedprice": "x", "l_discount": "dd", "l_tax": "tt", "l_shipdate": "sd"}
    return t(spark, d, "lineitem").select(*[F.col(k).alias(v) for k, v in names.items()])


@query("advantage_grpo", f"with s as ({SCORES}) select uid, i, p, x, round(case when count(*) over w = 1 then s / (1 + 1e-6) else (s - avg(s) over w) / (stddev_samp(s) over w + 1e-6) end, 5) as grpo, round(case when count(*) over w = 1 then s else s - avg(s) over w end, 6) as dr_grpo from s window w as (partition by uid)")
def _(spark, d):
    s = F.col("s")
    return scores(spark, d).select("uid", "i", "p", "x", F.round(A.grpo(s, "uid"), 5).alias("grpo"), F.round(A.grpo(s, "uid", by_std=False), 6).alias("dr_grpo"))


@query("advantage_rloo_opo", f"with s as ({SCORES}) select uid, i, p, x, round(case when count(*) over w > 1 then (s - avg(s) over w) * count(*) over w / (count(*) over w - 1) else s end, 6) as rloo, round(case when count(*) over w = 1 then s else s - sum(x * s) over w / sum(x) over w end, 6) as opo from s window w as (partition by uid)")
def _(spark, d):
    s = F.col("s")
    return scores(spark, d).select("uid", "i", "p", "x", F.round(A.rloo(s, "uid"), 6).alias("rloo"), F.round(A.opo(s, F.col("x"), "uid"), 6).alias("opo"))


@query(
    "advantage_by_name",
    f"""with s as ({SCORES}), g as (select uid, i, s, x, count(*) over w as n, avg(s) over w as m, stddev_samp(s) over w as sd, sum(x * s) over w / sum(x) over w as b, row_number() over (partition by uid order by s desc, i, p, q, x) as r from s window w as (partition by uid)), a as (select (select count(*) from s) / greatest(1, (select count(*) from s where s <> 0)) as alpha)
  select name, count(*) as n, round(sum(case name when 'grpo' then case when n = 1 then s / (1 + 1e-6) else (s - m) / (sd + 1e-6) end when 'dr_grpo' then case when n = 1 then s else s - m end when 'rloo' then case when n > 1 then (s - m) * n / (n - 1) else s end when 'opo' then case when n = 1 then s else s - b end else alpha * case when n = 1 then s else s - m end end * x / 1e5), 3) as total
  from g, a, (select unnest(['grpo', 'dr_grpo', 'rloo', 'opo', 'gpg']) as name) group by 1""",
)
def _(spark, d):
    x = scores(spark, d).withColumn("length", F.col("x"))
    parts = [A.advantages(x, name).select(F.lit(name).alias("name"), (F.col("advantage") * F.col("x") / 1e5).alias("v")) for name in ("grpo", "dr_grpo", "rloo", "opo", "gpg")]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query("advantage_pass_k", "with s as (select o_custkey as uid, o_orderkey as i, o_totalprice as s from orders), r as (select *, row_number() over (partition by uid order by s desc, i) as r, stddev_samp(s) over (partition by uid) as sd, lead(s) over (partition by uid order by s desc, i) as s2 from s) select uid, i, round(case when r = 1 then (s - s2) / (sd + 1e-6) else 0.0 end, 5) as advantage from r")
def _(spark, d):
    s = t(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("s"))
    return A.grpo_pass_k(s, "s", "uid", "i").select("uid", "i", F.round("advantage", 5).alias("advantage"))


@query("returns_to_go", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between current row and unbounded following), 2) as ret from orders")
def _(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", F.round(A.returns_to_go(o, "o_custkey", "o_orderkey", F.col("o_totalprice")), 2).alias("ret"))


@query("kl_estimates", "select event_id, round(a - b, 6) as k1, round(abs(a - b), 6) as k_abs, round(0.5 * (a - b) * (a - b), 6) as k2, round(least(greatest(exp(b - a) + (a - b) - 1, -10), 10), 6) as k3 from (select event_id, -(value % 3) / 4 as a, -(value % 5) / 4 as b from events)")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", (-(F.col("value") % 3) / 4).alias("a"), (-(F.col("value") % 5) / 4).alias("b"))
    k = lambda kind: F.round(A.kl(F.col("a"), F.col("b"), kind), 6)
    return e.select("event_id", k("k1").alias("k1"), k("abs").alias("k_abs"), k("k2").alias("k2"), k("k3").alias("k3"))


@query("policy_loss", "with r as (select user_id, exp((value % 3 - value % 5) / 8) as ratio, user_id % 7 - 3.0 as adv from events), l as (select user_id, greatest(-adv * ratio, -adv * least(greatest(ratio, 0.8), 1.2)) as w, adv from r), s as (select user_id, sum(case when adv < 0 then least(w, -adv * 3) else w end) as s, count(*) as m from l group by 1) select round(avg(s), 4) as seq_mean_token_sum, round(sum(s) / sum(m), 5) as token_mean from s")
def _(spark, d):
    v = F.col("value")
    e = t(spark, d, "events").select("user_id", A.clipped_loss((v % 3 - v % 5) / 8, F.lit(0.0), F.col("user_id") % 7 - F.lit(3.0)).alias("loss"), F.lit(1).alias("mask"))
    one = A.aggregate_loss(e, "user_id", "loss", "mask", "seq-mean-token-sum").select(F.round("loss", 4).alias("seq_mean_token_sum"))
    return one.crossJoin(A.aggregate_loss(e, "user_id", "loss", "mask", "token-mean").select(F.round("loss", 5).alias("token_mean")))  # one row each


TOKENS = "select user_id, value % 3 / 8 as logp, value % 5 / 8 as old, event_id % 7 - 3.0 as adv, case when event_id % 4 = 0 then 0 else 1 end as mask from events"


def _tokens(spark, d):
    v, i = F.col("value"), F.col("event_id")
    return t(spark, d, "events").select("user_id", (v % 3 / 8).alias("logp"), (v % 5 / 8).alias("old"), (i % 7 - F.lit(3.0)).alias("adv"), F.when(i % 4 == 0, 0).otherwise(1).alias("mask"))


@query("policy_loss_gspo", f"with t as ({TOKENS}), s as (select user_id, exp(least(sum((logp - old) * mask) / greatest(sum(mask), 1), 10)) as r, sum(mask) as m from t group by 1), l as (select t.user_id, m, sum(greatest(-adv * r, -adv * least(greatest(r, 0.8), 1.2)) * mask) as w from t join s using (user_id) group by 1, 2) select round(avg(w / (m + 1e-8)), 5) as loss from l")
def _(spark, d):
    return A.sequence_ratio_loss(_tokens(spark, d), "user_id").select(F.round("loss", 5).alias("loss"))


@query("policy_loss_geo_mean", f"with t as ({TOKENS}), k as (select user_id, mask, adv, case when adv > 0 then least(logp - old, 0.2) when adv < 0 then greatest(logp - old, -0.2) else 0 end as k from t), s as (select user_id, sum(mask) + 1e-8 as m, sum(k * mask) as k, sum(adv * mask) as adv from k group by 1) select round(avg(-adv / m * exp(k / m)), 5) as loss from s")
def _(spark, d):
    return A.geometric_mean_loss(_tokens(spark, d), "user_id").select(F.round("loss", 5).alias("loss"))


@query("compose_text", "with s as (select doc_id, trim(source) as p, trim(lang) as q, 'Work in ' || lang || '.' as b, n_chars::varchar as a from documents) select doc_id, '<question> ' || p || ' ' || q || ' </question> <solution> ' || b || ' </solution> <answer> ' || a || ' </answer>' as composed from s")
def _(spark, d):
    s = F.concat(F.lit("Work in "), "lang", F.lit(". Answer: "), F.col("n_chars").cast("string"), F.lit(".\nend"))
    return t(spark, d, "documents").select("doc_id", X.compose_text(F.col("source"), F.col("lang"), s).alias("composed"))


@query("answer_match", "select doc_id, case when n_chars % 3 = 2 then lang else n_chars::varchar end as answer, case when n_chars % 3 = 2 then 0 else 1 end as em from documents")
def _(spark, d):
    n = F.col("n_chars").cast("string")
    gen = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("x <answer> "), n, F.lit(" </answer> y"))).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("x <ANSWER>"), n, F.lit("\nmore"))).otherwise(F.concat(F.lit("<answer>"), "lang", F.lit("</answer>")))
    a = X.extract_answer(gen)
    return t(spark, d, "documents").select("doc_id", a.alias("answer"), X.exact_match(F.concat(n, F.lit(".0")), a).alias("em"))


@query("qa_normal", "select item_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w not in ('a', 'an', 'the')), ' ') as norm from benchmark")
def _(spark, d):
    return t(spark, d, "benchmark").select("item_id", X.qa_normal(F.col("text")).alias("norm"))


@query("infer_lengths", "select l_orderkey, l_partkey, s, tt, least(m, tt) as new_target, least(greatest(1000 - least(m, tt), 0), s) as new_source from (select *, case when tt * 2 < 1000 then 1000 when s * 2 < 1000 then 1000 - s else floor(1000 * (tt / (s + tt)))::bigint end as m from (select l_orderkey, l_partkey, l_partkey % 2000 + 1 as s, l_orderkey % 1500 + 1 as tt from lineitem))")
def _(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 2000 + 1).alias("s"), (F.col("l_orderkey") % 1500 + 1).alias("tt"))
    source, target = X.infer_lengths(F.col("s"), F.col("tt"), F.lit(1000))
    return x.select("*", target.alias("new_target"), source.alias("new_source"))


@query("gold_round_robin", "with l as (select *, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as n from orders), g as (select *, row_number() over (partition by k order by s_suppkey) - 1 as i, count(*) over (partition by k) as c from (select s_suppkey, case s_nationkey % 4 when 0 then 'F' when 1 then 'O' else 'none' end as k from supplier)) select o_orderkey, o_orderstatus, s_suppkey from l left join g on o_orderstatus = k and n % c = i")
def _(spark, d):
    gold = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 4 == 0, "F").when(F.col("s_nationkey") % 4 == 1, "O").otherwise("none").alias("o_orderstatus"))
    return R.round_robin_lookup(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), gold, ["o_orderstatus"], ["o_orderkey"], ["s_suppkey"])


@query("missing_gold", "select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)")
def _(spark, d):
    gold = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.missing(t(spark, d, "orders").select("o_orderkey", "o_custkey"), gold, ["o_custkey"])


@query("kto_shift", "select o_orderkey, b, case when row_number() over w = 1 then last_value(o_custkey) over (w rows between unbounded preceding and unbounded following) else lag(o_custkey) over w end as kl from (select *, o_orderkey // 64 as b from orders) window w as (partition by b order by o_orderkey)")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 64).alias("b"), "o_custkey")
    return o.select("o_orderkey", "b", R.shifted(o, "b", "o_orderkey", "o_custkey").alias("kl"))


@query("exact_dedup", "select source, sha256(text || chr(10) || '--FIELD--' || chr(10) || lang) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1, 2")
def _(spark, d):
    return R.exact_dedup(t(spark, d, "documents"), ["source"], ["text", "lang"], "doc_id")


@query("dedup_summary", "with g as (select source, sha256(text) as h, count(*) as n from documents group by 1, 2) select source, sum(n)::bigint as seen, count(*) as accepted, (sum(n) - count(*))::bigint as duplicates from g group by 1")
def _(spark, d):
    g = R.exact_dedup(t(spark, d, "documents"), ["source"], ["text"], "doc_id")
    return g.groupBy("source").agg(F.sum("copies").alias("seen"), F.count("digest").alias("accepted"), (F.sum("copies") - F.count("digest")).alias("duplicates"))


@query("minhash_bands")
def _(spark, d):
    return R.band_keys(R.minhash(t(spark, d, "documents").select("doc_id", "text"), "text", 5, 64), 8, 8).select("doc_id", "band", "band_key")


@query("op_budget", "with p as (select o_orderpriority as op, count(*) as w from orders group by 1), s as (select op, w, round(w / sum(w) over () * 1001, 9) as s from p), r as (select *, floor(s) as f, row_number() over (order by round(s - floor(s), 9) desc, op) as r from s) select op, w, (f + case when r <= 1001 - sum(f) over () then 1 else 0 end)::bigint as budget from r")
def _(spark, d):
    return R.op_budget(t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("op")).agg(F.count(F.lit(1)).alias("w")), "w", "op", 1001)


@query("mix_plan", "with r as (select n_nationkey as shard, round(1000000.0 * ((n_nationkey % 5 + 1) / 15) * 0.2 / (n_nationkey * 7000 + 9000), 9) as r from nation) select shard, floor(r)::bigint as repeats, round(case when r - floor(r) < 1e-6 then 0 else r - floor(r) end, 6) as residual from r")
def _(spark, d):
    n = F.col("n_nationkey")
    plan = t(spark, d, "nation").select(n.alias("shard"), ((n % 5 + 1) / 15).alias("p_context"), F.lit(0.2).alias("p_op"), (n * 7000 + 9000).alias("tokens"))
    return R.mix_plan(plan, 1e6).select("shard", "repeats", "residual")


@query("stratified_limit", "select o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_orderpriority order by o_orderkey) <= floor(count(*) over (partition by o_orderpriority) * 0.1)")
def _(spark, d):
    return R.first_share(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 0.1)


@query("repeat_rows", "select n_nationkey as row_id, rep, (n_nationkey * 3 + rep)::bigint as position from nation, range(3) as r(rep)")
def _(spark, d):
    return R.repeated(t(spark, d, "nation").select(F.col("n_nationkey").alias("row_id")), 3).select("row_id", "rep", F.col("position").cast("long").alias("position"))


@query("pad_rows", "select n_nationkey as row_id, n_nationkey::bigint as position from nation union all select n_nationkey, n_nationkey + 25 from nation where n_nationkey < 7")
def _(spark, d):
    return R.padded(t(spark, d, "nation").select(F.col("n_nationkey").alias("row_id")), 8, 25).select("row_id", "position")


@query("chat_filter", "select conv_id, count(*) as turns, bool_and(case when (turn - s) % 2 = 0 then role = 'user' else role = 'assistant' end) and (count(*) filter (role <> 'system')) % 2 = 0 as fine from (select *, max(case when turn = 0 and role = 'system' then 1 else 0 end) over (partition by conv_id) as s from conversations) where not (turn = 0 and role = 'system') group by conv_id")
def _(spark, d):
    c = t(spark, d, "conversations").withColumn("s", F.max(((F.col("turn") == 0) & (F.col("role") == "system")).cast("int")).over(Window.partitionBy("conv_id")))
    c = c.where(~((F.col("turn") == 0) & (F.col("role") == "system")))
    right = F.when((F.col("turn") - F.col("s")) % 2 == 0, F.col("role") == "user").otherwise(F.col("role") == "assistant")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), (F.bool_and(right) & (F.count_if(F.col("role") != "system") % 2 == 0)).alias("fine"))


@query("word_counts", "select w, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark) group by 1")
def _(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return t(spark, d, "benchmark").select(F.explode(w).alias("w")).groupBy("w").agg(F.count("w").alias("n"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(spark, d):
    return replay.windowed(t(spark, d, "events"), "ts", "1 hour", "1 day", "event_type", "value")


@query("pack_first_fit")
def _(spark, d):
    x = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 1000).alias("batch"), F.col("doc_id").alias("row"), F.length("text").cast("long").alias("length"))
    return B.packed_whole(x, "batch", "row", "length", 4096)


@query("balance_karmarkar_karp")
def _(spark, d):
    x = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 256).alias("batch"), F.col("doc_id").alias("row"), F.length("text").cast("long").alias("length"))
    return B.packed(x, "batch", "row", "length", B.karmarkar_karp, 8)


RESULTS = "select l_linestatus as template, l_linenumber as op, l_suppkey as prompt, l_returnflag = 'R' as perfect, l_partkey % 8 as sample_rank from lineitem"


@query("solved_views", f"with f as (select template, op, prompt, min(case when perfect then sample_rank end) as r from ({RESULTS}) group by 1, 2, 3) select template, op, count(*) as prompts, round(avg(case when r < 1 then 1 else 0 end), 6) as pass_1, round(avg(case when r < 4 then 1 else 0 end), 6) as pass_4 from f group by cube (template, op)")
def _(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_linestatus").alias("template"), F.col("l_linenumber").alias("op"), F.col("l_suppkey").alias("prompt"), (F.col("l_returnflag") == "R").alias("perfect"), (F.col("l_partkey") % 8).alias("sample_rank"))
    return M.solved_views(x, "template", "op", ["prompt"], [1, 4])


@query("scoring_counters", "select template, count(*) as total, count(*) filter (l_quantity > 25) as big, count(*) filter (l_discount = 0) as plain from (select *, case when l_returnflag = 'N' then '__none__' else l_returnflag end as template from lineitem) group by rollup (template)")
def _(spark, d):
    x = t(spark, d, "lineitem").withColumn("tpl", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(""))
    return M.counters(x, "tpl", big=F.col("l_quantity") > 25, plain=F.col("l_discount") == 0)


@query("unused_gold", "select gold, used, greatest(gold - used, 0) as unused from (select count(*) as gold from customer), (select count(distinct o_custkey) as used from orders)")
def _(spark, d):
    return M.unused_gold(t(spark, d, "customer"), t(spark, d, "orders"), ["o_custkey"])


@query("explained_variance", "select l_linenumber, count(*) as n, round(1 - var_samp(l_quantity - l_tax * 100) / (var_samp(l_quantity) + 1e-5), 5) as explained from lineitem group by 1")
def _(spark, d):
    return M.explained(t(spark, d, "lineitem"), ["l_linenumber"], F.col("l_quantity"), F.col("l_tax") * 100)


@query("source_reward", "select event_type, count(*) as rows, round(avg(r), 6) as reward from (select event_type, user_id, avg(value) as r from events group by 1, 2) group by 1")
def _(spark, d):
    return M.source_reward(t(spark, d, "events"), "event_type", "user_id", "value")


@query("split_of_sources", "select case when s_suppkey <= 5 then 'id' else 'ood' end as split, count(*) as n, round(avg(s_acctbal), 6) as mean from supplier group by 1")
def _(spark, d):
    x = t(spark, d, "supplier").select(F.concat(F.lit("op"), "s_suppkey").alias("source"), "s_acctbal")
    return M.split_of_sources(x, "source", "s_acctbal", 5)


@query("perplexity", "with s as (select user_id, sum(value % 3 * m) as s, sum(m) as m from (select *, case when event_id % 4 = 0 then 0 else 1 end as m from events) group by 1 having sum(m) > 0) select count(*) as sequences, round(avg(exp(s / m)), 5) as perplexity from s")
def _(spark, d):
    x = t(spark, d, "events").select("user_id", (F.col("value") % 3).alias("nll"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("m"))
    return M.perplexity(x, "user_id", "nll", "m")


@query("choice_accuracy", "with p as (select event_type, case when user_id % 7 >= event_id % 5 and user_id % 7 >= event_id % 3 then 'A' when event_id % 5 >= event_id % 3 then 'B' else 'C' end as pick from events) select coalesce(event_type, 'Average') as category, count(*) as n, round(100 * avg(case when pick = 'A' then 1 else 0 end), 2) as accuracy from p where event_type is not null group by rollup (event_type)")
def _(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    return M.choice_accuracy(t(spark, d, "events"), "event_type", {"A": u % 7, "B": e % 5, "C": e % 3}, F.lit("A"))


@query("length_spine", "with g as (select doc_id % 25 as g, count(text) as n, round(avg(length(text)), 4) as mean from documents group by 1) select s.s as \"group\", coalesce(n, 0) as n, coalesce(mean, 0) as mean from range(2, 21) as s(s) left join g on g = s")
def _(spark, d):
    return M.length_spine(t(spark, d, "documents").withColumn("g", F.col("doc_id") % 25), "g", "text")


@query("context_totals", "select source, lang, k, count(length(text)) as n, sum(length(text))::bigint as chars, round(avg(length(text)), 4) as mean from (select *, doc_id % 3 as k from documents) group by rollup (source, lang, k)")
def _(spark, d):
    return M.context_totals(t(spark, d, "documents").withColumn("k", F.col("doc_id") % 3), "source", "lang", "k", "text")


@query("policy_loss_gpg", f"select round(sum(-logp * adv * mask) / sum(mask), 5) as loss from ({TOKENS})")
def _(spark, d):
    return A.gpg_loss(_tokens(spark, d), "user_id").select(F.round("loss", 5).alias("loss"))


@query("policy_loss_kl_cov", "with t as (select event_id, user_id, value % 3 / 8 as logp, value % 5 / 8 as old, event_id % 7 - 3.0::double as adv, case when event_id % 4 = 0 then 0 else 1 end as mask from events), v as (select *, (adv - avg(adv) over ()) * (logp - avg(logp) over ()) as cov, count(*) over () as n from t where mask > 0), h as (select event_id from v qualify row_number() over (order by cov desc, event_id) <= greatest(1, floor(n * 0.05))) select round(sum(mask * (-adv * exp(logp - old) + case when event_id in (select event_id from h) then abs(logp - old) else 0 end)) / sum(mask), 5) as loss from t")
def _(spark, d):
    v, i = F.col("value"), F.col("event_id")
    x = t(spark, d, "events").select("event_id", "user_id", (v % 3 / 8).alias("logp"), (v % 5 / 8).alias("old"), (i % 7 - F.lit(3.0)).alias("adv"), F.when(i % 4 == 0, 0).otherwise(1).alias("mask"))
    return A.kl_cov_loss(x, "user_id", ["event_id"], 0.05).select(F.round("loss", 5).alias("loss"))


@query("result_lines", "select o_orderkey, (o_custkey % 9)::int as length, (o_orderkey % 20)::int as n, 0.25::double as accuracy, o_orderstatus as template, null::varchar as mode, 128 as num_examples from orders")
def _(spark, d):
    line = F.format_string("length: %d, op: %d, acc: 0.25, template: %s, num_examples: 128", F.col("o_custkey") % 9, F.col("o_orderkey") % 20, F.col("o_orderstatus"))
    return t(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in X.result_line(line).items()])


@query("chat_render", "select conv_id, string_agg(case role when 'user' then '<u>' || text || '</u>' when 'assistant' then '<a>' || text || '</a>' end, '' order by turn, role, text) as rendered from conversations where role in ('user', 'assistant') and text is not null group by 1")
def _(spark, d):
    x = t(spark, d, "conversations").where("role in ('user', 'assistant') and text is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return x.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", X.render_chat(F.col("turns"), {"user": "<u>{}</u>", "assistant": "<a>{}</a>"}).alias("rendered"))


@query("few_shot", "select p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer: B' as example from part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", X.few_shot(F.col("p_name"), {"A": F.col("p_brand"), "B": F.col("p_type")}, F.lit("B")).alias("example"))


from brindle.plans import aligned, generated, graded, graphs, measured, mixtures, stored, streamed  # noqa: E402, F401  they register theirs
