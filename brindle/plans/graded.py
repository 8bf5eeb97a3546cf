"""Prompts, answers and scores over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import answers as N
from brindle.functions import equality as Q
from brindle.operators import rewards as W
from brindle.operators.relational import spread
from brindle.plans.queries import query, t


def keys():
    """p_partkey, and p_size as text."""
    return F.col("p_partkey"), F.col("p_size").cast("string")


def part(spark, d):
    return t(spark, d, "part")


@query("answer_fallback", "select p_partkey, case p_partkey % 3 when 0 then p_size::varchar when 1 then p_name else '' end as answer, case p_partkey % 3 when 0 then p_size when 1 then 12345.5 else null end::double as number from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 3 == 0, F.concat(F.lit("so Answer: "), S, F.lit("\nAnswer: no"))).when(K % 3 == 1, F.concat(F.lit("Answer: x <answer> "), "p_name", F.lit(" </answer>"))).otherwise("none")
    number = F.when(K % 3 == 0, S).when(K % 3 == 1, "3 and then 12,345.5 or so").otherwise("none")
    return part(spark, d).select("p_partkey", N.answer_or_label(text).alias("answer"), N.loose_number(number).alias("number"))


@query("whole_number", "select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then 1 when 2 then null else p_size end::bigint as n, case when p_partkey % 2 = 0 then p_size::varchar else (p_size + 0.5)::double::varchar end as plain from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 4 == 0, S).when(K % 4 == 1, "True").when(K % 4 == 2, F.concat(S, F.lit(".5"))).otherwise(F.concat(S, F.lit(".0")))
    return part(spark, d).select("p_partkey", N.whole_number(text).alias("n"), N.plain_number(F.col("p_size") + F.when(K % 2 == 0, 1e-11).otherwise(0.5)).alias("plain"))


@query("gsm8k_scores", "select p_partkey, case when p_partkey % 3 = 2 then null else p_size::varchar end as found, case when p_partkey % 3 = 1 then 1.0 else 0.0 end as score from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 3 == 0, F.concat(F.lit("it is 3 and "), S, F.lit(" . "))).when(K % 3 == 1, F.concat(F.lit("#### "), S)).otherwise("none .")
    gold = F.when(K % 3 == 0, F.concat(S, F.lit("1"))).otherwise(S)
    return part(spark, d).select("p_partkey", N.gsm8k_flexible(text).alias("found"), N.score_by_source(F.lit("gsm8k"), text, gold).alias("score"))


@query("math_boxed", "select p_partkey, case p_partkey % 3 when 0 then '\\frac{' || p_size || '}{7}' when 1 then p_size::varchar else null end as box, case p_partkey % 3 when 2 then 0.0 else 1.0 end as score, case p_partkey % 3 when 1 then 1.0 else 0.0 end as thought from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 3 == 0, F.concat(F.lit(r"\boxed{1} then \boxed{\frac{"), S, F.lit("}{7}} end"))).when(K % 3 == 1, F.concat(F.lit(r"<think>a</think> \boxed{"), S, F.lit("}"))).otherwise(r"\boxed{no end")
    gold = F.when(K % 3 == 0, F.concat(S, F.lit("/7"))).otherwise(F.concat(F.lit("$"), S, F.lit(r"$\%")))
    return part(spark, d).select("p_partkey", N.boxed(text).alias("box"), N.math_score(text, gold).alias("score"), F.round(N.thought_score(text, S), 4).alias("thought"))


@query("minerva_scores", "select p_partkey, case when p_partkey % 3 = 0 then -1.0 else 1.0 end as score from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 3 == 0, F.concat(S, F.lit(" it is"))).when(K % 3 == 1, F.concat(F.lit("Answer: 5\nAnswer: x = "), S, F.lit(" dollars"))).otherwise(F.concat(F.lit("answer : $"), S, F.lit("$")))
    return part(spark, d).select("p_partkey", N.minerva_score(text, S).alias("score"))


@query("qa_scores", "select p_partkey, case p_partkey % 3 when 0 then 1.0 when 1 then 0.25 else 0.0 end as exact, case p_partkey % 3 when 0 then 1.0 when 1 then 0.25 else 1.0 end as inside from part")
def _(spark, d):
    K, S = keys()
    one = F.concat(F.lit("<answer>The "), "p_name", F.lit("!</answer>"))
    text = F.when(K % 3 == 0, F.concat(F.lit("<answer>x</answer>"), one)).when(K % 3 == 1, F.repeat(one, F.lit(11))).otherwise(F.concat(F.lit("<answer>so "), "p_name", F.lit(" then</answer>")))
    golds = F.array(F.lit("no such"), F.col("p_name"))
    return part(spark, d).select("p_partkey", N.qa_score(text, golds).alias("exact"), N.qa_score(text, golds, inside=True).alias("inside"))


@query("code_tests", "select p_partkey, case p_partkey % 3 when 0 then 'print(' || p_size || ')' || chr(10) when 1 then 'x' || chr(10) else 'no code' end as code, round((p_size % 4) / 4, 4) as rate, case when p_size % 4 >= 2 then 1.0 else (p_size % 4) / 2 end as first from part")
def _(spark, d):
    K, S = keys()
    text = F.when(K % 3 == 0, F.concat(F.lit("```\ny\n``` ```python\nprint("), S, F.lit(")\n``` z"))).when(K % 3 == 1, "a ```cpp\nx\n```").otherwise("no code")
    results = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= F.col("p_size") % 4)
    return part(spark, d).select("p_partkey", N.code_block(text).alias("code"), F.round(N.pass_rate(results), 4).alias("rate"), N.pass_rate(results, 2).alias("first"))


@query("symbolic_sets", "select p_partkey, p_partkey % 2 = 0 as same, 'V1,V' || (p_size + 1) as found from part where p_size > 0")
def _(spark, d):
    K, S = keys()
    a = F.concat(F.lit("V"), (F.col("p_size") + 1).cast("string"), F.lit(" V1 and V1; xV3 V4x"))
    b = F.concat(F.lit("V1, V"), (F.col("p_size") + F.when(K % 2 == 0, 1).otherwise(2)).cast("string"))
    x, y = N.symbolic_variables(a), N.symbolic_variables(b)
    return part(spark, d).where("p_size > 0").select("p_partkey", (x == y).alias("same"), F.array_join(x, ",").alias("found"))


@query("compose_prompt", "select p_partkey, '<question> ' || p_name || case when p_partkey % 2 = 0 then ' ' || p_brand else '' end || ' </question> <solution>' as prompt, case when p_partkey % 3 = 0 then p_size::varchar else p_type end as gold, p_name || case when p_partkey % 2 = 0 then ' ' || p_brand else '' end as problem from part")
def _(spark, d):
    K, S = keys()
    solution = F.when(K % 3 == 0, F.concat(F.lit("work. Answer: 1\nAnswer: "), S, F.lit("..\nx"))).otherwise("work only")
    prompt, gold = N.compose_prompt(F.concat(F.lit(" "), "p_name"), F.when(K % 2 == 0, F.col("p_brand")), solution, F.concat("p_type", F.lit(".")))
    whole = N.prompt_of(F.concat(prompt, F.lit(" a </solution> <solution> b")))
    return part(spark, d).select("p_partkey", whole.alias("prompt"), gold.alias("gold"), N.problem_of(whole).alias("problem"))


@query("text_pick", "select p_partkey, case when p_partkey % 3 = 0 then p_name else p_brand end as text, 'ctx' || p_size as context, p_type as difficulty, p_size as op from part")
def _(spark, d):
    K, S = keys()
    p = N.path_parts(F.concat(F.lit("root/ctx"), S, F.lit("/"), "p_type", F.lit("/op"), S, F.lit(".jsonl")))
    return part(spark, d).select("p_partkey", N.pick_text(F.when(K % 3 == 0, F.col("p_name")).when(K % 3 == 1, " \n"), F.col("p_brand")).alias("text"), *[c.alias(k) for k, c in p.items()])


PAIR = "select p_partkey, p_size::bigint as s, p_partkey % 7 + 1 as k, p_partkey % 9 as kind from part"


@query("math_equality", f"""select p_partkey, kind not in (1, 3, 5, 8) as strict, kind not in (5, 8) as loose from ({PAIR})""")
def _(spark, d):
    p = spread(t(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.col("p_size").cast("long").alias("s"), (F.col("p_partkey") % 7 + 1).alias("k"), (F.col("p_partkey") % 9).alias("kind"))
    s, k = F.col("s"), F.col("k")
    text = lambda form, *c: F.format_string(form, *c)
    pairs = [  # equal: reordered, a fraction not reduced (loosely), expanded, a hundredth (loosely), a root, other intervals (never), elements, a mixed number, another number (never)
        (text("x + %d", s), text("%d+x", s)),
        (text("%d/%d", s * 2, k * 2 + 2), text("%d/%d", s, k + 1)),
        (text("(x+%d)(x-%d)", s, k), text("x^2 + %d*x - %d*x - %d", s, k, s * k)),
        (text("0.%02d5", s), text("%d.5", s)),
        (text("\\sqrt{%d}", s * k * k * 2), text("%d\\sqrt{%d}", k, s * 2)),
        (text("[%d, %d)", s, s + k), text("(%d, %d)", s, s + k)),
        (text("(%d, x/%d)", s, k), text("(%d,\\frac{x}{%d})", s, k)),
        (text("%d 1/2", s), text("%d/2", s * 2 + 1)),
        (text("%d", s), text("%d", s + k)),
    ]
    given, gold = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (a, b) in enumerate(pairs):
        given, gold = F.when(F.col("kind") == i, a).otherwise(given), F.when(F.col("kind") == i, b).otherwise(gold)
    p = p.withColumn("given", given).withColumn("gold", gold)
    return p.select("p_partkey", Q.math_equal(F.col("given"), F.col("gold"), strict=True).alias("strict"), Q.math_equal(F.col("given"), F.col("gold")).alias("loose"))


@query("strict_box", "select p_partkey, case p_partkey % 3 when 0 then 1.0 else -1.0 end::double as score from part")
def _(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.when(k % 3 == 1, ".0").otherwise(""), F.lit("}"), F.when(k % 3 == 2, F.repeat(F.lit("."), 100)).otherwise("."))
    return t(spark, d, "part").select("p_partkey", N.strict_box_score(text, F.col("p_size").cast("string")).alias("score"))


@query(
    "managed_rewards",
    """with p as (select p_partkey, p_size::double as s, p_partkey % 3 as kind, p_partkey % 2 as good from part), r as (select p_partkey, s, case when kind = 1 then case when good = 1 then 1.0 else -1.0 end else good end::double as score from p)
  select p_partkey, score as naive, round(score + least(0, -(s - 30) / 20 * 0.5), 6) as overlong, round(case when score > 0 then 0.25 * (s / 50) + 0.75 * score else 0 end, 6) as blend from r""",
)
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").alias("length"), (F.col("p_size") / 50.0).alias("process"), (F.col("p_partkey") % 3).alias("kind"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_size")).otherwise(F.col("p_size") + 1).cast("string").alias("said"), F.col("p_size").cast("string").alias("gold"))
    p = p.withColumn("source", F.element_at(F.array(*map(F.lit, ("words", "contest", "sums"))), (F.col("kind") + 1).cast("int")))
    p = p.withColumn("text", F.when(F.col("kind") == 1, F.concat(F.lit("Answer: "), "said")).when(F.col("kind") == 2, F.concat(F.lit("so \\boxed{"), "said", F.lit("}"))).otherwise(F.concat(F.lit("<answer>"), "said", F.lit("</answer>"))))
    rules = {"words": "qa", "contest": "dapo", "sums": "math"}
    one = W.rewarded(p, "naive", rules).withColumnRenamed("reward", "naive")
    two = W.rewarded(one, "overlong", rules, most=50, buffer=20, factor=0.5).withColumnRenamed("reward", "overlong").drop("score")
    three = W.rewarded(two, "blend", rules, process="process", share=0.25)
    return three.select("p_partkey", "naive", F.round("overlong", 6).alias("overlong"), F.round("reward", 6).alias("blend"))
