"""Metrics and advantages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import advantage as A
from brindle.operators import evaluation as V
from brindle.plans.queries import query, t


@query("reduce_metrics", "select k as name, round(case when k like '%max%' then max(v) when k like '%min%' then min(v) else avg(v) end, 6) as value from (select case user_id % 3 when 0 then 'max_' when 1 then 'min_' else '' end || event_type as k, value as v from events) group by 1")
def _(spark, d):
    name = F.concat(F.when(F.col("user_id") % 3 == 0, "max_").when(F.col("user_id") % 3 == 1, "min_").otherwise(""), "event_type")
    return V.reduced(t(spark, d, "events").select(name.alias("name"), "value"), "name", "value")


TOK = "select event_id, user_id, value % 3 / 8 as logp, value % 5 / 8 as old, event_id % 7 - 3.0 as adv, case when event_id % 4 = 0 then 0 else 1 end as mask from events"


def tokens(spark, d):
    v, i = F.col("value"), F.col("event_id")
    return t(spark, d, "events").select("event_id", "user_id", (v % 3 / 8).alias("logp"), (v % 5 / 8).alias("old"), (i % 7 - F.lit(3.0)).alias("adv"), F.when(i % 4 == 0, 0).otherwise(1).alias("mask"))


@query("whiten", f"with s as (select sum(logp) / (count(*) + 1e-8) as m, var_samp(logp) as v from ({TOK}) where mask = 1) select event_id, round((logp - m) / sqrt(v + 1e-8), 5) as shifted, round((logp - m) / sqrt(v + 1e-8) + m, 5) as kept from ({TOK}), s")
def _(spark, d):
    x = tokens(spark, d)
    return x.select("event_id", F.round(A.whitened(x, "logp", "mask"), 5).alias("shifted"), F.round(A.whitened(x, "logp", "mask", shift=False), 5).alias("kept"))


@query(
    "advantage_reinforce_baseline",
    """with s as (select event_id, user_id as uid, value as s, event_id % 5 + 1 as len from events), c as (select *, s - case when count(*) over w = 1 then 0 else avg(s) over w end as c from s window w as (partition by uid)),
  m as (select sum(c * len) / (sum(len) + 1e-8) as m, (sum(c * c * len) - sum(c * len) ** 2 / sum(len)) / (sum(len) - 1) as v from c) select event_id, round((c - m) / sqrt(v + 1e-8), 5) as advantage from c, m""",
)
def _(spark, d):
    x = t(spark, d, "events").select("event_id", F.col("user_id").alias("uid"), "value", (F.col("event_id") % 5 + 1).alias("len"))
    return A.reinforce_baseline(x, "value", "uid", "len").select("event_id", F.round("advantage", 5).alias("advantage"))


@query("advantage_gpg", "with s as (select o_orderkey, o_custkey as uid, (o_orderkey % 3)::double as s from orders), a as (select count(*) / greatest(1, count(*) filter (s <> 0)) as alpha from s) select o_orderkey, round(alpha * (s - case when count(*) over w = 1 then 0 else avg(s) over w end) / 2, 6) as advantage from s, a window w as (partition by uid)")
def _(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), (F.col("o_orderkey") % 3).cast("double").alias("s"))
    return x.select("o_orderkey", F.round(A.gpg(F.col("s"), "uid", A.gpg_alpha(x, "s"), 2.0), 6).alias("advantage"))


@query("kl_in_reward", f"select event_id, round(adv - 0.1 * (logp - old) * mask, 6) as reward, round(0.1 * (1 + greatest(-0.2, least(0.2, (select avg(logp - old) from ({TOK}) where mask = 1) / 0.05 - 1)) * 64 / 1000), 6) as next_beta from ({TOK})")
def _(spark, d):
    x = tokens(spark, d)
    _, mean, _ = A.masked_stats(x.withColumn("kl", F.col("logp") - F.col("old")), "kl", "mask")
    return x.select("event_id", F.round(A.kl_reward(F.col("adv"), A.kl(F.col("logp"), F.col("old"), "k1"), F.col("mask"), 0.1), 6).alias("reward"), F.round(F.lit(A.next_beta(0.1, mean, 0.05, 64, 1000)), 6).alias("next_beta"))


@query("value_loss", f"select event_id, round(0.5 * greatest((logp - adv) ** 2, (least(greatest(logp, old - 0.05), old + 0.05) - adv) ** 2), 6) as loss, round(ln(exp(logp) + exp(old) + exp(adv)) - (exp(logp) * logp + exp(old) * old + exp(adv) * adv) / (exp(logp) + exp(old) + exp(adv)), 5) as entropy from ({TOK})")
def _(spark, d):
    return tokens(spark, d).select("event_id", F.round(A.value_loss(F.col("logp"), F.col("old"), F.col("adv"), 0.05), 6).alias("loss"), F.round(A.entropy(F.array("logp", "old", "adv")), 5).alias("entropy"))


@query("policy_loss_clip_cov")
def _(spark, d):
    return A.clip_cov_loss(tokens(spark, d), "user_id", ["event_id"], 0.02, 0.2, 0.2, (0.05, 5.0)).select(F.round("loss", 5).alias("loss"))


@query("loss_sum_norm", f"select round(sum(logp * mask) / 128, 5) as loss from ({TOK})")
def _(spark, d):
    return A.aggregate_loss(tokens(spark, d), "user_id", "logp", "mask", "seq-mean-token-sum-norm", 128).select(F.round("loss", 5).alias("loss"))


@query("pf_resample")
def _(spark, d):
    c = t(spark, d, "supplier")
    return A.resampled(c, "s_suppkey", A.pf_weight(F.col("s_acctbal"), F.lit(0), F.lit(0), "pow"), c.count())


@query("overlong_penalty", "select p_partkey, round(least(-(p_size - 20) / 10 * 0.5, 0), 6) as penalty from part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(A.overlong_penalty(F.col("p_size"), 30, 10, 0.5), 6).alias("penalty"))


@query("eos_mask", "select p_partkey, case p_partkey % 3 when 0 then '1,1,0,0' when 1 then '1,1,1,1' else '1,0,0,0' end as mask from part")
def _(spark, d):
    k = F.col("p_partkey") % 3
    ids = F.when(k == 0, F.array(*map(F.lit, (5, 1, 7, 1)))).when(k == 1, F.array(*map(F.lit, (5, 6, 7, 8)))).otherwise(F.array(*map(F.lit, (1, 1, 1, 0))))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(A.eos_mask(ids, 1), lambda x: x.cast("string")), ",").alias("mask"))


@query(
    "token_accuracy",
    """with x as (select p_partkey as k, list_transform(range(1, 7), lambda i: (k + i) % 3) as p, list_transform(range(1, 7), lambda i: case when (k + i) % 4 = 0 then -100 else (k * i) % 3 end) as l from part),
  a as (select list_avg(list_transform(list_filter(range(2, 7), lambda i: l[i] <> -100), lambda i: case when p[i - 1] = l[i] then 1 else 0 end)) as a from x) select count(a) as rows, round(avg(a), 6) as token_accuracy, round(avg(case when a = 1 then 1 else 0 end), 6) as sequence_accuracy from a where a is not null""",
)
def _(spark, d):
    k, six = F.col("p_partkey"), F.sequence(F.lit(1), F.lit(6))
    return V.token_accuracy(t(spark, d, "part"), F.transform(six, lambda i: (k + i) % 3), F.transform(six, lambda i: F.when((k + i) % 4 == 0, -100).otherwise((k * i) % 3)))


@query("pairwise_accuracy", "select c_mktsegment, round(avg(case when c_acctbal > c_custkey * 3 then 1 else 0 end), 6) as accuracy from customer group by 1")
def _(spark, d):
    return V.pairwise_accuracy(t(spark, d, "customer"), ["c_mktsegment"], F.col("c_acctbal"), F.col("c_custkey") * 3)


WORDS = "select item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as g from benchmark"


def words(spark, d):
    g = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    x = t(spark, d, "benchmark").select("item_id", g.alias("g"))
    return x.withColumn("p", F.filter("g", lambda w, i: (F.col("item_id") + i) % 4 != 0))


def _rouge(n):
    grams = lambda c: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"
    count = lambda c: f"select item_id, w, count(*) as n from (select item_id, unnest({grams(c)}) as w from x) group by 1, 2"
    return f"""with x as (select *, list_filter(g, lambda w, i: (item_id + i - 1) % 4 <> 0) as p from ({WORDS})), a as ({count('p')}), b as ({count('g')}), c as (select item_id, sum(least(a.n, b.n)) as hits from a join b using (item_id, w) group by 1)
  select item_id, coalesce(round(100 * 2 * hits / (greatest(len(p) - {n - 1}, 0) + greatest(len(g) - {n - 1}, 0)), 4), 0) as f1 from x left join c using (item_id)"""


@query("rouge_1", _rouge(1))
def _(spark, d):
    return words(spark, d).select("item_id", V.rouge_n(F.col("p"), F.col("g"), 1).alias("f1"))


@query("rouge_2", _rouge(2))
def _(spark, d):
    return words(spark, d).select("item_id", V.rouge_n(F.col("p"), F.col("g"), 2).alias("f1"))


# what is left out of a text is a subsequence of it
@query("rouge_l", f"select item_id, round(100 * 2 * len(p) / (len(p) + len(g)), 4) as f1 from (select *, list_filter(g, lambda w, i: (item_id + i - 1) % 4 <> 0) as p from ({WORDS}))")
def _(spark, d):
    return words(spark, d).select("item_id", V.rouge_l(F.col("p"), F.col("g")).alias("f1"))


@query("bleu_4")
def _(spark, d):
    return words(spark, d).select("item_id", V.bleu4(F.col("p"), F.col("g")).alias("bleu"))


@query("bootstrap_metric")
def _(spark, d):
    return V.bootstrap(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("bootstrap_best")
def _(spark, d):
    return V.bootstrap(t(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", size=4, reducer="best")


@query(
    "ema_users",
    """with recursive s as (select user_id, list(value order by event_id) as v from events group by 1), w as (select *, 1.8 * (1 / (1 + exp(-0.05 * len(v))) - 0.5) as w from s),
  f as (select user_id, 1 as i, v[1] as y from w union all select w.user_id, i + 1, y * w + (1 - w) * v[i + 1] from f join w using (user_id) where i < len(v)) select user_id, count(*) as n, round(sum(y), 3) as total from f group by 1""",
)
def _(spark, d):
    s = t(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    s = s.withColumn("y", V.smoothed(F.col("v")))
    return s.select("user_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("length_imbalance", "with l as (select o_orderkey // 1000 as p, o_orderkey % 4 as b, o_custkey as n from orders), a as (select sum(n) as s from l group by p), c as (select sum(n) as s from l group by b) select (select min(s) from a)::bigint as min, (select max(s) from a)::bigint as max, (select max(s) - min(s) from a)::bigint as minmax_diff, (select round(avg(s), 4) from a) as mean, (select min(s) from c)::bigint as balanced_min, (select max(s) from c)::bigint as balanced_max")
def _(spark, d):
    k = F.col("o_orderkey")
    return V.imbalance(t(spark, d, "orders").select(F.floor(k / 1000).alias("p"), (k % 4).alias("b"), "o_custkey"), "p", "b", "o_custkey")


@query(
    "ema_smoothing",
    """with recursive s as (select event_type, list(value order by event_id) as v from events where event_id % 40 = 0 group by 1), w as (select *, 1.8 * (1 / (1 + exp(-0.05 * len(v))) - 0.5) as w from s),
  f as (select event_type, 1 as i, v[1] as y from w union all select w.event_type, i + 1, y * w + (1 - w) * v[i + 1] from f join w using (event_type) where i < len(v)) select event_type, count(*) as n, round(sum(y), 4) as total from f group by 1""",
)
def _(spark, d):
    # a thinned series is the operator's input here: smoothing is for plotted curves of some hundred points
    s = t(spark, d, "events").where("event_id % 40 = 0").groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    y = V.smoothed(F.col("v"))
    return s.select("event_type", F.size(y).cast("long").alias("n"), F.round(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("rollout_drift", f"select user_id % 7 as g, round(corr(exp(logp), exp(old)), 5) as pearson, round(max(abs(exp(logp) - exp(old))), 6) as max, round(avg(abs(exp(logp) - exp(old))), 6) as mean, round(stddev_samp(abs(exp(logp) - exp(old))), 6) as std from ({TOK}) where mask = 1 group by 1")
def _(spark, d):
    return V.drift(tokens(spark, d).withColumn("g", F.col("user_id") % 7), ["g"], F.exp("logp"), F.exp("old"), F.col("mask"))


@query("flops_estimate", "select lang, 6 * 1e9 * sum(length(text)) + 12 * sum(length(text)::double * length(text)) * 24 * 16 * 64 as flops from documents group by 1")
def _(spark, d):
    return V.flops(t(spark, d, "documents").select("lang", F.length("text").alias("n")), ["lang"], "n", 1e9, 24, 16, 64)


@query("agent_loop_perf", "select l_linenumber, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, min(l_tax) as l_tax_min, max(l_tax) as l_tax_max, round(avg(l_quantity), 6) as l_quantity_mean, round(avg(l_tax), 6) as l_tax_mean, min(l_orderkey) filter (s = m) as slowest from (select *, l_quantity + l_tax as s, max(l_quantity + l_tax) over (partition by l_linenumber) as m from lineitem) group by 1")
def _(spark, d):
    return V.slowest(t(spark, d, "lineitem"), ["l_linenumber"], "l_orderkey", "l_quantity", "l_tax")


@query("merged_length_stats", "with f as (select lang, source, count(*) as n, avg(length(text)) as mean, min(length(text)) as least, max(length(text)) as most from documents group by 1, 2) select lang, sum(n)::bigint as n, round(sum(mean * n) / sum(n), 4) as mean, round(avg(mean), 4) as mean_of_means, round(coalesce(stddev_samp(mean), 0), 4) as std_of_means, min(least) as least, max(most) as most from f group by 1")
def _(spark, d):
    n = F.length("text")
    f = t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
    return V.merged_stats(f, ["lang"])


@query("throughput", "select event_type, round(sum(value) / sum(user_id) * 1000, 6) as ms_per_token, round(sum(user_id) / (sum(value) * 8), 6) as tokens_per_second, round(sum(user_id) * 3 / 60, 4) as effective from events group by 1")
def _(spark, d):
    return V.throughput(t(spark, d, "events"), ["event_type"], "user_id", "value", 8, 3, 60)


@query("valid_token_ratio", f"select user_id % 5 as g, round(sum(mask) / count(*), 6) as ratio, round(1e-4 * sqrt(sum(mask) / 1000), 9) as lr, round(avg(logp), 6) as mean, max(logp) as max, min(logp) as min, round(stddev_samp(logp), 6) as std from ({TOK}) group by 1")
def _(spark, d):
    return tokens(spark, d).groupBy((F.col("user_id") % 5).alias("g")).agg(*V.valid_ratio("mask", 1e-4, 1000), *V.spread("logp"))


@query("kl_sequence_mean", f"select round(avg(k), 6) as kl from (select sum((logp - old) * mask) / (sum(mask) + 1e-8) as k from ({TOK}) group by user_id)")
def _(spark, d):
    one = A._per_sequence(tokens(spark, d), "user_id", k=F.col("logp") - F.col("old"))
    return one.agg(F.round(F.avg(F.col("k") / (F.col("m") + 1e-8)), 6).alias("kl"))


@query("sample_rank", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as sample_rank from orders where o_orderstatus <> 'P'")
def _(spark, d):
    return V.ranked(t(spark, d, "orders").where("o_orderstatus <> 'P'"), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "sample_rank")


@query("op_histogram", "select l_linenumber::varchar as op, count(*) as n from lineitem group by 1")
def _(spark, d):
    return V.op_histogram(t(spark, d, "lineitem"), F.col("l_linenumber"))


@query("vote_value", "with v as (select o_custkey, o_orderpriority as vote, count(*) as n, min(o_orderkey) as first, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by 1, 2) select o_custkey, o_totalprice from v qualify row_number() over (partition by o_custkey order by n desc, first) = 1")
def _(spark, d):
    return V.vote_value(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey")


@query("validation_pass")
def _(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("uid"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), "l_quantity")
    return V.validation_pass(x, "source", "uid", "row", "l_quantity", [2, 4, 8])
