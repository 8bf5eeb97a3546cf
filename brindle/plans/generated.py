"""Generated problems with the rows of a table as seeds; the SQL computes what must hold of them, or draws them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.operators import encoding as E
from brindle.operators import equations as Q
from brindle.operators import generate as N
from brindle.operators import graph as G
from brindle.operators import symbolic as Y
from brindle.operators.relational import spread
from brindle.plans.queries import query, t

def template() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in N.TEMPLATES]), (F.col("seed") % len(N.TEMPLATES) + 1).cast("int"))


def seeds(spark, d, table: str = "part", key: str = "p_partkey", ops: int = 16):
    """Seeds, op counts of 2 and more, and templates from a table's keys."""
    return t(spark, d, table).select(F.col(key).cast("long").alias("seed")).withColumn("op", (F.col("seed") % ops + 2).cast("int")).withColumn("template", template())


def needed() -> Column:
    return F.filter("graph", lambda n: n["needed"])


def recomputed(n: Column) -> Column:
    """A node's value from its operands', as the problem tells it."""
    v = F.transform(n["deps"], lambda i: F.get("graph", i)["v"])
    both = F.when(n["how"] == "-", v[0] - v[1]).when(n["how"] == "*", v[0] * v[1]).otherwise(F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.when(F.size(v) == 0, n["v"]).when(n["mode"] == "+", both + n["c"]).when(n["mode"] == "*", both * n["c"]).otherwise(both)


@query("forward_problems", "select p_partkey as seed, (p_partkey % 16 + 2)::int as op, (p_partkey % 16 + 2)::int as read_ops, true as same_nodes, true as same_answer, true as sorted, true as sums from part")
def _(spark, d):
    x = N.forward(seeds(spark, d)).withColumn("read", G.parse_graph(F.col("solution"))).withColumn("own", needed())
    told = F.transform("own", lambda n: F.struct(n["name"].alias("name"), n["v"].alias("v"), F.array_sort(F.transform(n["deps"], lambda i: F.get("own", i)["name"])).alias("deps")))
    read = F.transform("read.nodes", lambda n: F.struct(n["name"].alias("name"), n["value"].cast("long").alias("v"), F.array_sort(n["deps"]).alias("deps")))
    return x.select("seed", "op", G.op_count(F.col("read")).alias("read_ops"), (read == told).alias("same_nodes"), (F.col("read.answer") == F.col("answer")).alias("same_answer"), F.col("read.order").isNotNull().alias("sorted"), F.forall("graph", lambda n: recomputed(n) == n["v"]).alias("sums"))


@query("reverse_problems", "select p_partkey as seed, (p_partkey % 16 + 2)::int as op, (p_partkey % 16 + 2)::int as edges, true as solved, true as satisfies, true as hidden from part")
def _(spark, d):
    x = N.reverse(seeds(spark, d)).withColumn("own", needed())
    equation = F.regexp_extract("solution", r"So ([^=]+ = \d+)\.", 1)
    edges = F.aggregate("own", F.lit(0), lambda s, n: s + F.size(n["deps"]))
    asked = F.get("graph", F.col("asked"))
    says = F.concat(F.lit("The number of "), asked["name"], F.lit(" equals "))
    x = x.withColumn("answers", Q.solved(equation)["solutions"])
    return x.select("seed", "op", edges.alias("edges"), (F.col("answers") == F.array("answer")).alias("solved"), (F.forall("graph", lambda n: recomputed(n) == n["v"]) & (asked["v"] == F.col("answer"))).alias("satisfies"), (~F.contains("problem", says)).alias("hidden"))


@query(
    "equation_solutions",
    """select p_partkey, case p_partkey % 4 when 0 then 1 when 3 then 0 else 2 end::int as "order", case p_partkey % 4 when 0 then p_size::varchar when 1 then case when p_size = p_partkey % 7 + 1 then p_size::varchar else least(p_size, p_partkey % 7 + 1) || ',' || greatest(p_size, p_partkey % 7 + 1) end when 2 then '' end as solutions from part
  where p_partkey % 4 <> 3 union all select p_partkey, null, null from part where p_partkey % 4 = 3""",
)
def _(spark, d):
    p = spread(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.col("p_size").cast("long").alias("s"), (F.col("p_partkey") % 7 + 1).alias("k"), (F.col("p_partkey") % 4).alias("kind"))
    s, k = F.col("s"), F.col("k")
    text = F.when(F.col("kind") == 0, F.format_string("%d * (x - %d) + 4 = 4 + x - %d", k + 1, s, s)).when(F.col("kind") == 1, F.format_string("x**2 = %d*x - %d", s + k, s * k))
    text = text.when(F.col("kind") == 2, F.format_string("x^2 + %d = x*0", s)).otherwise(F.format_string("x**3 + %d = y", s))
    return p.withColumn("solved", Q.solved(text)).select("p_partkey", F.col("solved.order").alias("order"), F.array_join("solved.solutions", ",").alias("solutions"))


DRAW = "('0x' || substr(sha256(seed::varchar || ':{}:' || {}), 1, 8))::bigint"


@query(
    "symbolic_tasks",
    f"""with recursive s as (select p_partkey as seed, (p_size % 12 + 1)::int as op, (p_size % 12 + 1 + p_partkey % 9)::int as n from part),
  k as (select *, {DRAW.format("name", "0")} % 1000000 as a, {DRAW.format("step", "0")} % 100000 * 10 + 7 as b from s),
  i as (select seed, op, n, a, b, unnest(range(op)) as i from k),
  e as (select seed, op, n, i, 'V' || lpad(((a + b * i) % 1000000)::varchar, 6, '0') as name, case when i > 0 then {DRAW.format("parent", "i")} % i else -1 end as parent, {DRAW.format("delta", "i")} % 3 as kind from i),
  v as (select seed, i, ({DRAW.format("root", "0")} % 11)::int as value from e where i = 0 union all select e.seed, e.i, v.value + case e.kind when 1 then 1 when 2 then -1 else 0 end from v join e on e.seed = v.seed and e.parent = v.i),
  w as (select s.seed, v.value as wanted from s join v on v.seed = s.seed and v.i = ('0x' || substr(sha256(s.seed::varchar || ':wanted:0'), 1, 8))::bigint % s.op)
  select e.seed, e.op, e.n, (e.n - case when e.n > e.op then 1 else 0 end)::int as n_lines, w.wanted, string_agg(e.name, ', ' order by e.i) filter (v.value = w.wanted) as answer from e join v using (seed, i) join w using (seed) group by all""",
)
def _(spark, d):
    s = t(spark, d, "part").select(F.col("p_partkey").alias("seed"), (F.col("p_size") % 12 + 1).alias("op"), (F.col("p_size") % 12 + 1 + F.col("p_partkey") % 9).alias("n"))
    return Y.tasks(s).select("seed", "op", "n", F.size("lines").alias("n_lines"), "wanted", F.array_join("answer", ", ").alias("answer"))


@query("padded_problems", "select s_suppkey as seed, true as counted, true as filled, true as kept, true as answerable from supplier")
def _(spark, d):
    import public_tokenizers

    tokens = lambda c: E.token_count(c, public_tokenizers.path("word_bpe_49k.json"))
    p = N.forward(seeds(spark, d, "supplier", "s_suppkey", 9)).withColumn("before", F.col("problem"))
    x = N.in_context(p, 900, tokens).withColumn("again", tokens(F.col("problem"))).withColumn("asked", tokens(F.col("question")))
    lines = lambda c: F.split(F.rtrim(c, F.lit(".")), r"\. ")
    own = F.array_intersect(lines("problem"), lines("before"))
    return x.select("seed", (F.col("again") + F.col("asked") == F.col("n_tokens")).alias("counted"), F.col("n_tokens").between(900 - 40, 900).alias("filled"), (own == lines("before")).alias("kept"), (G.parse_graph(F.col("solution"))["answer"] == F.col("answer")).alias("answerable"))
