"""Mixtures, samples, orders, splits and packing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import packing as B
from brindle.operators import relational as R
from brindle.operators import sampling as S
from brindle.plans.queries import query, t


@query("size_parse", "select n_nationkey, case n_nationkey % 4 when 0 then n_nationkey::bigint * 1000 when 1 then n_nationkey::bigint * 1000000 when 2 then n_nationkey::bigint * 1000000000 + 500000000 else n_nationkey::bigint end as size from nation")
def _(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(k.cast("string"), F.when(k % 4 == 0, "K").when(k % 4 == 1, "m").when(k % 4 == 2, ".5B").otherwise(""))
    return t(spark, d, "nation").select("n_nationkey", X.size_of(text).alias("size"))


@query("compose_plan", "select n_nationkey, floor(round((n_nationkey + 1) / 325 * 1e6 / (n_nationkey * 300 + 700), 9))::bigint as files, round(round((n_nationkey + 1) / 325 * 1e6 / (n_nationkey * 300 + 700), 9) % 1, 6) as rest from nation")
def _(spark, d):
    k = F.col("n_nationkey")
    return S.compose_plan(t(spark, d, "nation").select("n_nationkey", ((k + 1) / 325).alias("p"), (k * 300 + 700).alias("file_tokens")), 1e6).select("n_nationkey", "files", "rest")


SHARES = {"1-URGENT": (2, 0.25), "2-HIGH": (0, 0.1), "3-MEDIUM": (1, 0.0), "5-LOW": (0, 1.0)}


@query("mix_materialize", "select o_orderpriority, case o_orderpriority when '1-URGENT' then 2 * n + ceil(round(0.25 * n, 6)) when '2-HIGH' then ceil(round(0.1 * n, 6)) else n end::bigint as rows, case o_orderpriority when '2-HIGH' then ceil(round(0.1 * n, 6)) else n end::bigint as ids from (select o_orderpriority, count(*) as n from orders group by 1) where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')")
def _(spark, d):
    plan = spark.createDataFrame([(k, *v) for k, v in SHARES.items()], "o_orderpriority string, repeats int, residual double")
    out = S.materialized(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", plan, "o_orderkey")
    return out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("ids"))


@query("context_sample", "select mkt, want as rows, least(want, n) as ids from (select c_mktsegment as mkt, count(*) as n, case c_mktsegment when 'BUILDING' then 10 when 'MACHINERY' then 5 else 0 end::bigint as want from customer group by 1) where want > 0")
def _(spark, d):
    out = S.drawn(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", {("BUILDING",): 10, ("MACHINERY",): 5})
    return out.groupBy(F.col("c_mktsegment").alias("mkt")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_custkey").alias("ids"))


@query(
    "balanced_allocation",
    """with c as (select c_mktsegment as context, count(*) as n from customer group by 1), o as (select distinct c_nationkey % 4 as op from customer), z as (select sum(n) as rows, floor(sum(n) * 0.37)::bigint as total, (select count(*) from o) as k, count(*) as contexts from c),
  e as (select context, n / rows * total / k as exact, total, k, contexts from c, z), f as (select *, floor(exact + 1e-9)::bigint as each, row_number() over (order by exact - floor(exact + 1e-9) desc, context) as r from e),
  l as (select *, total - sum(each) over () * k as rest from f), g as (select *, each + case when r <= rest // k then 1 else 0 end as per, rest - least(rest // k, contexts) * k as last from l),
  p as (select context, op, (per + case when r = 1 and row_number() over (partition by context order by op desc) <= last then 1 else 0 end)::bigint as n from g, o), h as (select c_mktsegment as context, c_nationkey % 4 as op, count(*) as have from customer group by 1, 2)
  select context, op, n, case when have > 0 then n else 0 end::bigint as drawn, least(n, coalesce(have, 0))::bigint as ids from p left join h using (context, op)""",
)
def _(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("context"), (F.col("c_nationkey") % 4).alias("op"))
    held = rows.groupBy("context").count().orderBy("context").collect()  # a row a context
    ops, n = sorted(r.op for r in rows.select("op").distinct().collect()), sum(r["count"] for r in held)
    plan = S.balanced([(r.context, r["count"] / n) for r in held], ops, int(n * 0.37))
    out = S.drawn(rows, ["context", "op"], "c_custkey", plan).groupBy("context", "op").agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("c_custkey").alias("ids"))
    asked = spark.createDataFrame([(c, o, k) for (c, o), k in plan.items()], "context string, op int, n long")
    return asked.join(out, ["context", "op"], "left").na.fill(0, ["drawn", "ids"])


@query(
    "mix_allocation",
    """with h as (select o_orderstatus as c, o_orderpriority as o from orders group by 1, 2), p as (select c, o, (case c when 'F' then 0.5 when 'O' then 0.3 else 0.2 end) * (1 + (substr(o, 1, 1)::int % 3)) as m from h),
  s as (select c, o, round(m / sum(m) over () * 1003, 9) as e from p), r as (select *, row_number() over (order by round(e - floor(e), 9) desc, c, o) as r from s) select c, o, (floor(e) + case when r <= 1003 - sum(floor(e)) over () then 1 else 0 end)::bigint as n from r""",
)
def _(spark, d):
    held = {(r.o_orderstatus, r.o_orderpriority): r["count"] for r in t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").count().collect()}  # a row a cell
    ops = {o: 1 + int(o[0]) % 3 for _, o in held}
    plan = S.allocation({"F": 0.5, "O": 0.3, "P": 0.2}, ops, held, 1003)
    return spark.createDataFrame([(c, o, n) for (c, o), n in plan.items()], "c string, o string, n long")


@query("natural_order", "select op, row_number() over (order by case when regexp_full_match(op, '\\d+') then 0 when regexp_matches(op, '^\\d') then 1 else 2 end, coalesce(try_cast(regexp_extract(op, '^(\\d+)', 1) as bigint), 0), op) as place from (select distinct case p_size % 3 when 0 then p_size::varchar when 1 then p_size || 'b' else 'x' || p_size end as op from part)")
def _(spark, d):
    s = F.col("p_size").cast("string")
    ops = t(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, s).when(F.col("p_size") % 3 == 1, F.concat(s, F.lit("b"))).otherwise(F.concat(F.lit("x"), s)).alias("op")).distinct()
    from pyspark.sql.window import Window

    return ops.withColumn("place", F.row_number().over(Window.orderBy(*S.natural("op"))))  # a row an op


@query("interleave_first", "with a as (select s_suppkey as k, row_number() over (order by s_suppkey) - 1 as p from supplier), b as (select n_nationkey as k, row_number() over (order by n_nationkey) - 1 as p from nation), n as (select least((select count(*) from a), (select count(*) from b)) as n) select k, p * 2 as position from a, n where p < n union all select k, p * 2 + 1 from b, n where p < n")
def _(spark, d):
    return S.interleaved([t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))], "k")


@query("interleave_all", "with a as (select s_suppkey as k, row_number() over (order by s_suppkey) - 1 as p, count(*) over () as c from supplier), b as (select n_nationkey as k, row_number() over (order by n_nationkey) - 1 as p, count(*) over () as c from nation), n as (select greatest((select max(c) from a), (select max(c) from b)) as n), u as (select unnest(range(n)) as i from n) select k, i * 2 as position from u join a on i % c = p union all select k, i * 2 + 1 from u join b on i % c = p")
def _(spark, d):
    return S.interleaved([t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))], "k", "all")


# the keys of region are 0 .. 4, those of nation 0 .. 24: they are their rows' places
@query("merge_two_one_one", "select n_nationkey::bigint as k, case when n_nationkey < 10 then n_nationkey // 2 * 4 + n_nationkey % 2 else 10 + n_nationkey end::bigint as position from nation union all select r_regionkey + 100, r_regionkey * 4 + 2 from region union all select r_regionkey + 200, r_regionkey * 4 + 3 from region")
def _(spark, d):
    r = F.col("r_regionkey").cast("long")
    return S.merged_lines(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")), t(spark, d, "region").select((r + 100).alias("k")), t(spark, d, "region").select((r + 200).alias("k")), "k")


@query("chunk_rows", "select p_partkey, (row_number() over (order by p_partkey) - 1) // 7 as chunk from part qualify row_number() over (order by p_partkey) <= (select count(*) // 7 * 7 from part)")
def _(spark, d):
    return S.chunked(t(spark, d, "part").select("p_partkey"), "p_partkey", 7, whole=True)


@query("row_gather", "select position, n_name from (values (0, 7), (1, 3), (2, 7), (3, 24)) v(position, n_nationkey) join nation using (n_nationkey)")
def _(spark, d):
    return S.gathered(t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), "n_nationkey", [7, 3, 7, 24]).select("position", "n_name")


@query("aligned_union", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def _(spark, d):
    c = t(spark, d, "customer")
    return S.aligned_union(c.select("c_custkey", "c_name", "c_nationkey"), c.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")


@query("train_validation_split")
def _(spark, d):
    return S.split(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("num_samples", "select count(*) as ids, 60 as rows, max(n)::bigint as most from (select n_nationkey, 2 as a from nation), (select ceil(60 / 25) as n)")
def _(spark, d):
    out = S.resampled(t(spark, d, "nation").select("n_nationkey"), "n_nationkey", 60)
    per = out.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("ids"), F.sum("n").cast("int").alias("rows"), F.max("n").alias("most"))


@query("round_robin_shard", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) % 8 as shard from orders")
def _(spark, d):
    x = S.numbered(t(spark, d, "orders").select("o_orderkey", F.lit(0).alias("g")), ["g"], ["o_orderkey"], "i")
    return x.select("o_orderkey", F.pmod("i", F.lit(8)).alias("shard"))


@query("gold_fallback", "with g as (select r_regionkey as op, n_nationkey % 3 as idx, max_by(n_name, n_nationkey) as name from nation join region on n_regionkey = r_regionkey group by 1, 2), c as (select op, count(*) as c from g group by 1) select s_suppkey, name from (select s_suppkey, s_nationkey % 5 as op, s_suppkey as i from supplier) s left join c using (op) left join g on g.op = s.op and g.idx = i % c")
def _(spark, d):
    gold = t(spark, d, "nation").select(F.col("n_regionkey").alias("op"), (F.col("n_nationkey") % 3).cast("long").alias("idx"), F.col("n_name").alias("name"), "n_nationkey")
    rows = t(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("op"), F.col("s_suppkey").alias("idx"))
    return R.fallback_lookup(rows, gold, "op", "idx", "name", "n_nationkey").select("s_suppkey", "name")


@query("band_candidates")
def _(spark, d):
    return R.candidate_pairs(R.band_keys(R.minhash(R.spread(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey"), "p_name", 5, 64), 8, 8).select("p_partkey", "band", "band_key"), "p_partkey")


def lengths(spark, d, batch: int):
    return t(spark, d, "documents").select(F.floor(F.col("doc_id") / batch).alias("batch"), F.col("doc_id").alias("row"), F.length("text").cast("long").alias("length"))


@query("pack_next_fit")
def _(spark, d):
    return B.packed(lengths(spark, d, 1000), "batch", "row", "length", B.next_fit, 4096)


@query("pack_knapsack")
def _(spark, d):
    return B.packed(lengths(spark, d, 1000), "batch", "row", "length", B.knapsack, 4096)


@query("greedy_partition")
def _(spark, d):
    return B.packed(lengths(spark, d, 256), "batch", "row", "length", B.greedy_partition, 8)


@query("micro_batches")
def _(spark, d):
    return B.packed(lengths(spark, d, 64), "batch", "row", "length", B.micro_batches, 16384)


@query("pack_supervised", "select count(*) as ids, sum(x)::bigint as total from (select unnest(range(1, p_size + 1)) as x from part where p_size <= 40)")
def _(spark, d):
    p = t(spark, d, "part").select(F.floor(F.col("p_partkey") / 1000).alias("batch"), F.col("p_partkey").alias("row"), F.sequence(F.lit(1), F.col("p_size")).alias("ids"))
    out = B.packed_rows(p, "batch", "row", "ids", 40)
    used = F.filter(F.arrays_zip("input_ids", "attention_mask"), lambda x: x["attention_mask"] > 0)
    return out.select(F.explode(used).alias("x")).agg(F.count(F.lit(1)).alias("ids"), F.sum("x.input_ids").alias("total"))


PICKED = """with u as (select i as position, ('0x' || substr(sha256('42:' || i), 1, 8))::bigint / 4294967296.0 as u from range({}) r(i)), s as (select position, case when u < 0.25 then 0 else 1 end as source from u), n as (select *, row_number() over (partition by source order by position) - 1 as turn from s),
  a as (select s_suppkey as k, 0 as source, row_number() over (order by s_suppkey) - 1 as place, count(*) over () as size from supplier union all select c_custkey, 1, row_number() over (order by c_custkey) - 1, count(*) over () from customer), z as (select distinct source, size from a)"""


@query("interleave_by_shares", PICKED.format(20000) + ", e as (select min(position) as last from n join z using (source) where turn = size) select k, position from n join a on a.source = n.source and a.place = n.turn, e where position < last")
def _(spark, d):
    frames = [t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k"))]
    return S.interleaved_by(frames, "k", [0.25, 0.75])


@query("interleave_by_shares_all", PICKED.format(60000) + ", e as (select max(position) as last from n join z using (source) where turn = size - 1) select k, position from n join z using (source) join a on a.source = n.source and a.place = n.turn % z.size, e where position <= last")
def _(spark, d):
    frames = [t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), t(spark, d, "customer").select(F.col("c_custkey").alias("k"))]
    return S.interleaved_by(frames, "k", [0.25, 0.75], "all")


@query("mask_gather", "select o_orderkey, row_number() over (order by o_orderkey) - 1 as position from orders where o_orderstatus = 'F'")
def _(spark, d):
    o = t(spark, d, "orders")
    return S.gathered_by(o.select("o_orderkey"), "o_orderkey", o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("keep")))


@query("repeat_ragged", "select p_partkey, rep::int as rep, row_number() over (order by p_partkey, rep) - 1 as position from (select p_partkey, unnest(range(p_size % 4)) as rep from part)")
def _(spark, d):
    return S.repeated_by(t(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("n")), "p_partkey", "n").drop("n")


@query("filter_equal", "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def _(spark, d):
    return R.where_equal(t(spark, d, "customer"), "c_mktsegment=BUILDING, c_nationkey=7").select("c_custkey")
