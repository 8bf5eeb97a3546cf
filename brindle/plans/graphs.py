"""Dependency graphs over texts made from the driver's tables; the SQL computes from the numbers, not from the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators.relational import spread
from brindle.plans.queries import query, t


def problems(spark, d) -> DataFrame:
    """Texts of six kinds by p_partkey: symbols only; an intermediate; written out and tagged; a value that later steps show; no
    value but a number in words; a cycle. s: p_size; k: a number of the key."""
    p = spread(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.col("p_size").cast("long").alias("s"), (F.col("p_partkey") % 7 + 1).alias("k"), (F.col("p_partkey") % 6).alias("kind"))
    text = lambda form, *c: F.format_string(form, *c)
    s, k = F.col("s"), F.col("k")
    first = "Define red fox in Oak as X; so X = %d. "
    kinds = [
        text(first + "Define old  owl as Y; so Y = X + %d. Define all as Z; so Z = X * Y. Answer: none of 5", s, k),
        text(first + "Define old owl a Y; W = X + %d; so Y = W - 2. Answer: %d.", s, k, s),
        text("<p>" + first + "Define old owl as the Y; so Y = %d * X = %d * %d = %d.</p> <answer> %d </answer>", s, k, k, s, k * s, k * s),
        text(first + "Define old owl as Y; so Y = X - Z. Define all as Z; so Z = 9. Define red fox in Oak as X; so X = Z + %d. Answer: 1", s, k),
        text(first + "Define old owl as Y; it has %d of them, so Y = q. Answer: -%d", s, k, k),
        text(first + "Define old owl as Y; so Y = (X + 1) * %d. Define red fox in Oak as X; so X = X + Y. Answer: 2.5", s, k),
    ]
    out: Column = F.lit(None).cast("string")
    for i, c in enumerate(kinds):
        out = F.when(F.col("kind") == i, c).otherwise(out)
    return p.withColumn("solution", F.when(F.col("p_partkey") % 11 != 0, out))


BASE = "select p_partkey, p_size::bigint as s, p_partkey % 7 + 1 as k, p_partkey % 6 as kind, p_partkey % 11 = 0 as none from part"
OWL = "case kind when 0 then s + k when 1 then s + k - 2 when 2 then k * s when 3 then 9 when 4 then k else (s + 1) * k end"
# in kind 3 Y = X - Z has no value when it is read and no number, and gets X - Z from what later steps show
PARSED = f"""select p_partkey, s, k, kind, none, case when kind = 3 then k else {OWL} end::double as owl,
  case kind when 3 then 9 + k when 5 then s + (s + 1) * k else s end::double as fox,
  case kind when 0 then s * (s + k) when 3 then 9 end::double as total,
  case kind when 0 then null when 1 then s when 2 then k * s when 3 then 1 when 4 then -k else 2.5 end::double as answer,
  case kind when 0 then 'red fox in Oak|old owl|all' when 3 then 'all|red fox in Oak|old owl' when 5 then '' else 'red fox in Oak|old owl' end as ord from ({BASE})"""


@query(
    "graph_parse",
    f"""select p_partkey, case when none then 'missing-solution' end as error, case when none then null else fox end as fox, case when none then null else owl end as owl,
  case when none then null else total end as total, case when none then null else answer end as answer,
  case when none or kind = 5 then null else ord end as topological, case when none then null when kind = 0 then 3 when kind = 1 or kind = 2 then 1 when kind = 3 then 2 when kind = 4 then 0 else 3 end as op_count from ({PARSED})""",
)
def _(spark, d):
    x = G.gold_graphs(problems(spark, d), "solution", "p_partkey")
    value = lambda name: F.get(F.filter(F.col("graph.nodes"), lambda n: n["name"] == name), F.lit(0))["value"]
    count = F.when(F.col("error").isNull(), G.op_count(F.col("graph")))
    return x.select("p_partkey", "error", value("red fox in Oak").alias("fox"), value("old owl").alias("owl"), value("all").alias("total"), F.col("graph.answer").alias("answer"), F.array_join("graph.order", "|").alias("topological"), count.alias("op_count"))


def predictions(spark, d) -> DataFrame:
    """Gold: fox s, owl fox + k. Predicted, by the key: equal, another value, another dependency, a node more, a node less, another answer."""
    p = spread(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.col("p_size").cast("long").alias("s"), (F.col("p_partkey") % 7 + 1).alias("k"), (F.col("p_partkey") % 6).alias("kind"))
    s, k, kind = F.col("s"), F.col("k"), F.col("kind")
    gold = F.format_string("Define fox as X; so X = %d. Define owl as Y; so Y = X + %d. Answer: %d.", s, k, s + k)
    fox, owl = F.format_string("Define fox as A; so A = %d. ", s), F.format_string("Define owl as B; so B = A + %d. ", F.when(kind == 1, k + 1).otherwise(k))
    owl = F.when(kind == 2, F.format_string("Define owl as B; so B = %d. ", s + k)).when(kind == 4, F.lit("")).otherwise(owl)
    more = F.when(kind == 3, F.lit("Define bat as C; so C = B. ")).otherwise("")
    pred = F.concat(fox, owl, more, F.format_string("Answer: %d.", F.when(kind == 5, s + k + 1).otherwise(s + k)))
    return p.select("p_partkey", G.parse_graph(gold).alias("gold"), G.parse_graph(pred).alias("pred"))


WRONG = "select p_partkey, p_partkey % 6 as kind from part"


@query(
    "graph_scores",
    f"""select p_partkey, (kind = 4)::int as missing, (kind = 3)::int as extra, (kind = 1)::int as "values", (kind = 2)::int as deps, kind = 5 as answer,
  kind in (0, 3) as perfect, kind = 3 as perfect_with_extra, case when kind = 4 then 'owl' else '' end as missing_names, case when kind = 3 then 'bat' else '' end as extra_names,
  case when kind = 4 then 'fox' else 'fox|owl' end as shared_names,
  case kind when 0 then 1.0 when 5 then 0.0 else 0.9 end as reward, case kind when 0 then 1.0 when 5 then 0.0 else 0.8 end as strict from ({WRONG})""",
)
def _(spark, d):
    gold, pred = F.col("gold"), F.col("pred")
    c = G.compare(gold, pred)
    outcome, n = (~c["answer"]).cast("int"), F.size("gold.nodes")
    named = c | G.score(c) | G.names_apart(gold, pred) | {"reward": F.round(G.process_reward(c, n, outcome), 6), "strict": F.round(G.process_reward(c, n, outcome, strict=True), 6)}
    return predictions(spark, d).select("p_partkey", *[v.alias(k) for k, v in named.items()])


@query("graph_order", f"select p_partkey, kind <> 5 as acyclic, kind <> 5 as given, false as reversed, case kind when 0 then 'all' when 3 then 'all|old owl' else 'old owl' end as frontier from ({PARSED}) where not none")
def _(spark, d):
    x = G.gold_graphs(problems(spark, d), "solution", "p_partkey").where("error is null")
    g, order = F.col("graph"), F.col("graph.order")
    done = F.when(F.col("kind") == 0, F.array(F.lit("red fox in Oak"), F.lit("old owl"))).otherwise(F.array(F.lit("red fox in Oak")))
    ok = lambda o: F.coalesce(G.is_order(g, o), F.lit(False))
    reverse = F.when(F.col("kind") == 4, F.array(F.lit("old owl"))).otherwise(F.reverse(order))
    return x.select("p_partkey", order.isNotNull().alias("acyclic"), ok(order).alias("given"), ok(reverse).alias("reversed"), F.array_join(G.frontier(g, done), "|").alias("frontier"))
