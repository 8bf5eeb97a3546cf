"""Alignment, encoding and masks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import chat as C
from brindle.operators import encoding as E
from brindle.operators.relational import spread
from brindle.plans.queries import query, t


def flat(turns, sep=";"):
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit("")))), sep)


ROWS = "select p_partkey, p_name as a, case when p_partkey % 3 = 0 then '' else p_brand end as q, p_type as r, p_partkey % 2 = 0 as tag, p_partkey % 4 = 0 as old from part"


def alpaca_rows(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("q"), F.col("p_type").alias("r"), (k % 2 == 0).alias("tag"), F.when(k % 4 == 0, F.array(F.struct(F.lit("hi").alias("q"), F.lit("yo").alias("a")))).alias("h"))


PROMPT = "case when old then 'user:hi;assistant:yo;' else '' end || 'user:' || a || case when q <> '' then chr(10) || q else '' end"


@query("align_alpaca", f"select p_partkey, {PROMPT} as prompt, 'assistant:' || r as plain, case when tag then 'assistant:' || r || ';assistant:' else 'assistant:;assistant:' || r end as kto, 'assistant:' || r || ';assistant:' || a as pair, 1 as odd from ({ROWS})")
def _(spark, d):
    c = F.col
    args = c("a"), c("q"), c("r"), c("h")
    plain, kto, pair = E.alpaca(*args), E.alpaca(*args, tag=c("tag")), E.alpaca(*args, chosen=c("r"), rejected=c("a"))
    return alpaca_rows(spark, d).select("p_partkey", flat(plain["_prompt"]).alias("prompt"), flat(plain["_response"]).alias("plain"), flat(kto["_response"]).alias("kto"), flat(pair["_response"]).alias("pair"), E.valid_example(plain["_prompt"], plain["_response"]).cast("int").alias("odd"))


TURNS = "select conv_id, list(struct_pack(turn := turn, role := role, content := text) order by turn, role, text) as t from conversations group by 1"


@query(
    "align_sharegpt",
    f"""with x as (select conv_id, t[1].role = 'system' as s, case when t[1].role = 'system' then t[1].content else '' end as system, case when t[1].role = 'system' then t[2:] else t end as r from ({TURNS})),
  y as (select *, len(r) > 0 and len(r) % 2 = 0 and len(list_filter(range(1, len(r) + 1), lambda i: case when i % 2 = 1 then r[i].role not in ('user', 'observation') else r[i].role not in ('assistant', 'function') end)) = 0 as fine from x)
  select conv_id, coalesce(system, '') as system, fine as valid, case when fine then len(r) - 1 else 0 end as prompt_turns, case when fine then coalesce(r[len(r)].content, '') else '' end as response from y""",
)
def _(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    p = E.sharegpt(F.col("t"))
    x = x.select("conv_id", *[c.alias(k) for k, c in p.items()])
    return x.select("conv_id", F.coalesce("_system", F.lit("")).alias("system"), E.valid_example(F.col("_prompt"), F.col("_response")).alias("valid"), F.size("_prompt").alias("prompt_turns"), F.coalesce(F.get("_response", F.lit(0))["content"], F.lit("")).alias("response"))


def ids(n, base):
    """1, 2, .. n, each plus base."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda x: (x + base).cast("int"))


def numbered(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", ids((k % 13).cast("int"), 0).alias("a"), ids((k % 17 + 1).cast("int"), 100).alias("b"), ids((k % 5 + 1).cast("int"), 200).alias("c"))


NUMBERED = "select p_partkey, list_transform(range(1, p_partkey % 13 + 1), lambda x: x) as a, list_transform(range(1, p_partkey % 17 + 2), lambda x: x + 100) as b, list_transform(range(1, p_partkey % 5 + 2), lambda x: x + 200) as c from part"
TEXT = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(
    "truncate_pad",
    f"""with x as (select p_partkey, b, len(b) as n, list_transform(range(greatest(8 - len(b), 0)), lambda i: 0) as z from ({NUMBERED}))
  select p_partkey, array_to_string(case when n > 8 then b[n - 7:] else z || b end, ',') as "left", array_to_string(case when n > 8 then b[:8] else b || z end, ',') as "right", array_to_string(case when n > 8 then b[:4] || b[n - 3:] else z || b end, ',') as middle from x""",
)
def _(spark, d):
    b = F.col("b")
    return numbered(spark, d).select("p_partkey", TEXT(E.truncate_pad(b, 8, 0, "left")).alias("left"), TEXT(E.truncate_pad(b, 8, 0, "right", left_pad=False)).alias("right"), TEXT(E.truncate_pad(b, 8, 0, "middle")).alias("middle"))


CUT = "case when m * 2 < 12 then 12 when s * 2 < 12 then 12 - s else floor(12 * (m / (s + m)))::bigint end"


@query(
    "encode_supervised",
    f"""with x as (select p_partkey, a, b, len(a) as s, len(b) as m from ({NUMBERED})), y as (select *, least({CUT}, m) as nt from x), z as (select *, least(greatest(12 - nt, 0), s) as ns from y)
  select p_partkey, array_to_string(a[:ns] || b[:nt], ',') as input_ids, array_to_string(list_transform(range(ns), lambda i: -100) || b[:nt], ',') as labels, ns + nt as length, ns + nt - 1 as last_position from z""",
)
def _(spark, d):
    s = E.supervised(F.col("a"), F.col("b"), 12)
    return numbered(spark, d).select("p_partkey", TEXT(s["input_ids"]).alias("input_ids"), TEXT(s["labels"]).alias("labels"), F.size(s["attention_mask"]).alias("length"), F.array_max(s["position_ids"]).alias("last_position"))


@query(
    "encode_pairwise",
    f"""with x as (select p_partkey, a, b, c, len(a) as s, greatest(len(b), len(c)) as m from ({NUMBERED})), y as (select *, least({CUT}, m) as nt from x), z as (select *, least(greatest(12 - nt, 0), s) as ns from y)
  select p_partkey, array_to_string(a[:ns] || b[:nt], ',') as chosen_input_ids, array_to_string(list_transform(range(ns), lambda i: -100) || b[:nt], ',') as chosen_labels, array_to_string(a[:ns] || c[:nt], ',') as rejected_input_ids, array_to_string(list_transform(range(ns), lambda i: -100) || c[:nt], ',') as rejected_labels from z""",
)
def _(spark, d):
    p = E.pairwise(F.col("a"), F.col("b"), F.col("c"), 12)
    return numbered(spark, d).select("p_partkey", *[TEXT(c).alias(k) for k, c in p.items()])


@query("turn_mask", f"select conv_id, array_to_string(flatten(list_transform(t, lambda x: list_transform(range(coalesce(length(x.content), 0) % 5), lambda i: case when x.role = 'assistant' then 1 else 0 end))), '') as mask from ({TURNS})")
def _(spark, d):
    x = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda y: F.struct(y["role"].alias("role"), F.array_repeat(F.lit(7), F.coalesce(F.length(y["text"]), F.lit(0)) % 5).alias("ids")))
    return x.select("conv_id", F.array_join(F.transform(E.turn_mask(turns), lambda m: m.cast("string")), "").alias("mask"))


@query("segment_lengths", "select p_partkey, case when n > 0 then n::varchar || ',' else '' end || m::varchar as lengths, case when n > 0 then '0,' || n || ',' || n + m else '0,' || m end as bounds from (select p_partkey, p_partkey % 4 as n, p_partkey % 3 + 1 as m from part)")
def _(spark, d):
    n, m = (F.col("p_partkey") % 4).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int")
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.when(n > 0, 2).otherwise(1), m), F.array_repeat(F.lit(0), 2))
    lengths = E.segment_lengths(mask)
    return t(spark, d, "part").select("p_partkey", TEXT(lengths).alias("lengths"), TEXT(E.cumulative(lengths)).alias("bounds"))


STEPS = "select o_custkey as uid, list((o_orderkey % 5)::double order by o_orderkey) as r, list((o_orderkey % 3)::double order by o_orderkey) as v, list((case when o_orderkey % 7 = 0 then 0 else 1 end)::double order by o_orderkey) as m from orders group by 1"


def steps(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 5).alias("r"), (F.col("o_orderkey") % 3).alias("v"), F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(1).alias("m")))).alias("s"))
    return o.select("uid", *[F.col(f"s.{c}").alias(c) for c in "rvm"])


@query(
    "returns_masked",
    f"""with recursive s as ({STEPS}), f as (select uid, len(r) as i, r[len(r)] as now, r[len(r)] * m[len(r)] as run from s union all select s.uid, i - 1, r[i - 1] + 0.9 * run, (r[i - 1] + 0.9 * run) * m[i - 1] from f join s using (uid) where i > 1)
  select uid, round(sum(now), 5) as total, round(max(case when i = 1 then now end), 5) as first from f group by 1""",
)
def _(spark, d):
    out = E.discounted_masked(F.col("r"), F.col("m"), 0.9)
    return steps(spark, d).select("uid", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(out[0], 5).alias("first"))


@query(
    "gae_masked",
    f"""with recursive s as ({STEPS}), f as (select uid, len(r) + 1 as i, 0.0::double as adv, 0.0::double as nxt from s union all select s.uid, i - 1, m[i - 1] * (r[i - 1] + 0.9 * nxt - v[i - 1] + 0.9 * 0.8 * adv) + (1 - m[i - 1]) * adv, m[i - 1] * v[i - 1] + (1 - m[i - 1]) * nxt from f join s using (uid) where i > 1)
  select uid, round(sum(case when i <= len(r) then adv else 0 end), 5) as total, round(max(case when i = 1 then adv end), 5) as first from f join s using (uid) group by 1""",
)
def _(spark, d):
    out = E.gae_masked(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8)
    return steps(spark, d).select("uid", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(out[0], 5).alias("first"))


@query("media_parts", "select p_partkey, case when p_partkey % 3 = 0 then 'image|text' when p_partkey % 3 = 1 then 'text|video|text' else 'text' end as types, case when p_partkey % 3 = 1 then 2 else 1 end * length(p_name) as chars from part")
def _(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    parts = E.media_parts(F.when(k == 0, F.concat(F.lit("<image>"), n)).when(k == 1, F.concat(n, F.lit("<video>"), n)).otherwise(n))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(parts, lambda p: p["type"]), "|").alias("types"), F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0))).cast("long").alias("chars"))


@query("slot_format", "select p_partkey, p_name || ' by ' || p_brand || ' and {{name}}' as text from part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", E.slot(F.lit("{{name}} by {{brand}} and {{name}}"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("passages", "select o_custkey, string_agg('Doc ' || i || ' (Title: ' || o_orderkey || ') ' || o_orderpriority, chr(10) order by i) as text from (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) group by 1")
def _(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderpriority").alias("text")))).alias("docs"))
    return o.select("o_custkey", E.passages(F.col("docs")).alias("text"))


@query("tool_calls", "select p_partkey, case when p_partkey % 3 = 2 then 0 else 1 end as calls, case when p_partkey % 3 = 2 then null else p_brand end as name, case when p_partkey % 3 = 2 then null else p_size::varchar end as size, p_name as content from part")
def _(spark, d):
    call = F.concat(F.lit("<tool_call>"), F.when(F.col("p_partkey") % 3 == 2, F.lit("{broken")).otherwise(F.concat(F.lit('{"name": "'), F.col("p_brand"), F.lit('", "arguments": {"size": '), F.col("p_size").cast("string"), F.lit("}}"))), F.lit("</tool_call>"))
    c = E.tool_calls(F.concat(F.col("p_name"), F.lit("\n"), call))
    first = F.get(c["calls"], F.lit(0))
    return t(spark, d, "part").select("p_partkey", F.size(c["calls"]).alias("calls"), first["name"].alias("name"), F.get_json_object(first["arguments"], "$.size").alias("size"), c["content"].alias("content"))


@query("fold_rows", "select n_nationkey // 4 as fold, array_to_string(list(n_name order by n_nationkey), ',') as names from nation group by 1")
def _(spark, d):
    return E.folded(t(spark, d, "nation"), "n_nationkey", 4, "n_name").select("fold", F.array_join("values", ",").alias("names"))


@query(
    "encode_feedback",
    """with p as (select p_partkey, p_size as s, p_partkey % 6 + 1 as k, p_partkey % 5 + 2 as a from part)
  select p_partkey, s + k <= 24 as whole, p_size_ids as n_ids, n_kl from (select p_partkey, s, k, a, least(s + k, 24) as p_size_ids, least(s + a, 24) as n_kl from p)""",
)
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").alias("s"), (F.col("p_partkey") % 6 + 1).cast("int").alias("k"), (F.col("p_partkey") % 5 + 2).cast("int").alias("a"))
    ids = lambda n: F.sequence(F.lit(1), n)
    e = E.feedback(ids(F.col("s")), ids(F.col("k")), ids(F.col("s")), ids(F.col("a")), F.col("s") + F.col("k") <= 24, 24)
    return p.select("p_partkey", e["kto_tags"].alias("whole"), F.size(e["input_ids"]).cast("long").alias("n_ids"), F.size(e["kl_labels"]).cast("long").alias("n_kl"))


@query("block_masks", "with p as (select p_partkey, p_size % 5 + 1 as a, p_partkey % 4 as b, p_partkey % 3 as z from part) select p_partkey, a + b + z as width, (a * (a + 1) // 2 + b * (b + 1) // 2)::bigint as ones from p")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).cast("int").alias("a"), (F.col("p_partkey") % 4).cast("int").alias("b"), (F.col("p_partkey") % 3).cast("int").alias("z"))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("a")), F.array_repeat(F.lit(2), F.col("b")), F.array_repeat(F.lit(0), F.col("z")))
    m = p.select("p_partkey", E.block_mask(mask).alias("m"))
    ones = F.aggregate(F.flatten("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("p_partkey", F.size("m").cast("long").alias("width"), ones.alias("ones"))


@query(
    "chat_templates",
    "select conv_id, string_agg(case role when 'user' then '<|im_start|>user' || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) else coalesce(text, '') || '<|im_end|>' || chr(10) end, '' order by turn, role, coalesce(text, '')) as rendered, count(*) as turns from conversations where role in ('user', 'assistant') group by 1",
)
def _(spark, d):
    x = t(spark, d, "conversations").where("role in ('user', 'assistant')")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    parts = C.rendered(F.col("turns"), C.TEMPLATES["chatml"])
    return x.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(parts, "").alias("rendered"), F.size(parts).cast("long").alias("turns"))


@query("tool_dialects", "select p_partkey, d as dialect, true as same from part, (select unnest(['default', 'glm4', 'llama3', 'mistral', 'qwen', 'glm4_moe', 'seed_oss']) as d)")
def _(spark, d):
    one = F.struct(F.concat(F.lit("tool_"), F.col("p_size").cast("string")).alias("name"), F.format_string('{"name": "%s", "size": %d}', F.col("p_name"), F.col("p_size")).alias("arguments"))
    p = spread(t(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select("p_partkey", F.array(one).alias("calls"))
    back = [F.struct(F.lit(name).alias("dialect"), (C.read_calls(C.written_calls(F.col("calls"), name), name) == F.col("calls")).alias("same")) for name in C.DIALECTS]
    return p.select("p_partkey", F.explode(F.array(*back)).alias("x")).select("p_partkey", "x.dialect", "x.same")


TOOL = """'{"name": "find_' || p_size || '", "description": "' || p_name || '", "parameters": {"type": "object", "properties": {"brand": {"type": "string", "enum": ["' || p_brand || '", "any"]}, "size": {"type": "integer", "description": "at most"}}, "required": ["size"]}}'"""


@query(
    "tool_descriptions",
    f"""with p as (select p_partkey, p_name, p_size, p_brand, {TOOL} as tool from part)
  select p_partkey, 'default' as dialect, 'You have access to the following tools:' || chr(10) || '> Tool Name: find_' || p_size || chr(10) || 'Tool Description: ' || p_name || chr(10) || 'Tool Args:' || chr(10)
    || '  - brand (string): , should be one of [' || p_brand || ', any]' || chr(10) || '  - size (integer, required): at most' || chr(10) || chr(10) || 'Use the following format if using a tool:' || chr(10) || '```' || chr(10)
    || 'Action: tool name (one of [find_' || p_size || '])' || chr(10) || 'Action Input: the input to the tool, in a JSON format representing the kwargs (e.g. ```{{"input": "hello world", "num_beams": 5}}```)' || chr(10) || '```' || chr(10) as said from p
  union all select p_partkey, 'mistral', '[AVAILABLE_TOOLS] [{{"type": "function", "function": ' || tool || '}}][/AVAILABLE_TOOLS]' from p
  union all select p_partkey, 'qwen', replace('||# Tools||You may call one or more functions to assist with the user query.||You are provided with function signatures within <tools></tools> XML tags:|<tools>|', '|', chr(10)) || '{{"type": "function", "function": ' || tool || '}}'
    || replace('|</tools>||For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:|<tool_call>|{{"name": <function-name>, "arguments": <args-json-object>}}|</tool_call>', '|', chr(10)) from p""",
)
def _(spark, d):
    tool = F.format_string('[{"name": "find_%d", "description": "%s", "parameters": {"type": "object", "properties": {"brand": {"type": "string", "enum": ["%s", "any"]}, "size": {"type": "integer", "description": "at most"}}, "required": ["size"]}}]', "p_size", "p_name", "p_brand")
    p = spread(t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "p_partkey").select("p_partkey", tool.alias("tools"))
    said = [F.struct(F.lit(name).alias("dialect"), C.described_tools(F.col("tools"), name).alias("said")) for name in ("default", "mistral", "qwen")]
    return p.select("p_partkey", F.explode(F.array(*said)).alias("x")).select("p_partkey", "x.dialect", "x.said")
