"""Episodes, growing tables and the curriculum over the driver's tables; the SQL folds, recurses or draws again."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans.queries import query, t
from brindle.sources import io
from brindle.streaming import episodes as S
from brindle.streaming import growing as W
from brindle.streaming import replay


@query(
    "agent_episodes",
    """with e as (select conv_id, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) as i from conversations where role in ('system', 'user', 'assistant', 'tool') and conv_id is not null),
  c as (select *, count(*) filter (role = 'assistant') over w as a, count(*) filter (role = 'user') over w as u, coalesce(sum(length(text)) filter (role = 'assistant') over w, 0) as size from e window w as (partition by conv_id order by i)),
  s as (select *, role = 'assistant' and (a >= 3 or size >= 600) as ends from c), f as (select conv_id, min(i) filter (ends) as last, max(i) as top from s group by 1)
  select conv_id, case when ends then 'terminated' when role = 'assistant' and contains(text, '<tool_call>') then 'processing_tools' when role = 'assistant' then 'interacting' when u = 0 and role = 'system' then 'pending' when role = 'system' then 'pending' else 'generating' end as state,
    i::int as turns, a::int as assistant_turns, u::int as user_turns, size::bigint as size from s join f using (conv_id) where i = coalesce(last, top) and not (role = 'system' and i > 1)
  union all select s.conv_id, case when p.role = 'assistant' then 'interacting' else 'generating' end, s.i::int, s.a::int, s.u::int, s.size::bigint from s join f using (conv_id) join s p on p.conv_id = s.conv_id and p.i = (select max(q.i) from s q where q.conv_id = s.conv_id and q.i < s.i and q.role <> 'system') where s.i = coalesce(last, top) and s.role = 'system' and s.i > 1""",
)
def _(spark, d):
    top = io.shared_folder(spark, "episodes")
    turns = replay.stream(spark, f"{d}/conversations*.parquet", t(spark, d, "conversations").schema)
    with replay.configured(spark, {"spark.sql.streaming.stateStore.providerClass": S.STORE}):
        out = replay.replayed(S.episodes(turns, max_turns=3, max_size=600), f"{top}/out", f"{top}/state", "update")
    return S.latest(out)


@query("growing_rows", "with recursive g as (select s_suppkey as id, (s_nationkey + 1)::bigint as v, 0 as generation from supplier union all select id + 1000000, v // 2, generation + 1 from g where v > 1) select id, v, generation from g")
def _(spark, d):
    top = io.shared_folder(spark, "growing")
    t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1).cast("long").alias("v"), F.lit(0).alias("generation")).write.parquet(f"{top}/pool/start")
    schema = spark.read.parquet(f"{top}/pool/start").schema
    half = lambda b: b.where("v > 1").select((F.col("id") + 1_000_000).alias("id"), F.floor(F.col("v") / 2).alias("v"), (F.col("generation") + 1).alias("generation"))
    return W.grown(spark, f"{top}/pool", schema, half, f"{top}/out", f"{top}/state", files=16).drop("batch")


STEP = """s{0} as (select {0} as step, p_partkey, op, (p_partkey % (op + 2) = 0)::int::double as reward from p join w{0} using (op) order by -ln((('0x' || substr(sha256('42:{0}:' || p_partkey), 1, 8))::bigint + 1) / 4294967296.0) / weight, p_partkey limit 100),
  w{1} as (select op, weight * exp(2.0 * (0.4 - coalesce(m, 0.4))) as weight from w{0} left join (select op, avg(reward) as m from s{0} group by 1) using (op))"""


@query("curriculum_batches", f"with p as (select p_partkey, (p_size % 5)::int as op from part), w0 as (select distinct op, 1.0::double as weight from p), {STEP.format(0, 1)}, {STEP.format(1, 2)}, {STEP.format(2, 3)} select * from s0 union all select * from s1 union all select * from s2")
def _(spark, d):
    pool = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).cast("int").alias("op"))
    start = pool.select("op").distinct().withColumn("weight", F.lit(1.0))
    reward = lambda b: b.withColumn("reward", (F.col("p_partkey") % (F.col("op") + 2) == 0).cast("double"))
    return W.curriculum(pool, start, "op", "p_partkey", reward, io.shared_folder(spark, "curriculum"), 3, 100, target=0.4, rate=2.0)


def events(spark, d):
    # watermarks want a time with a zone
    return replay.stream(spark, f"{d}/events*.parquet", t(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_sliding",
    "select time_bucket(interval '20 minutes', ts) - k * interval '20 minutes' as start, event_type, count(*) as n, round(sum(value), 4) as total from events, range(3) r(k) group by 1, 2",
)
def _(spark, d):
    top = io.shared_folder(spark, "sliding")
    out = replay.replayed(replay.windowed(events(spark, d), "ts", "1 hour", "1 day", "event_type", "value", "20 minutes"), f"{top}/out", f"{top}/state", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_sessions",
    """with g as (select *, case when ts >= lag(ts) over w + interval '8 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g)
  select min(ts) as start, max(ts) + interval '8 hours' as "end", user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""",
)
def _(spark, d):
    top = io.shared_folder(spark, "sessions")
    out = replay.replayed(replay.sessions(events(spark, d), "ts", "8 hours", "1 day", "user_id", "value"), f"{top}/out", f"{top}/state", "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
