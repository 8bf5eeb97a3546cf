"""Generated problems are solved again from their texts alone; equations against small whole numbers; symbolic tasks line by line."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from brindle.operators import equations as Q
from brindle.operators import generate as N
from brindle.operators import symbolic as Y


def seeds(spark, n, parts):
    names = F.array(*[F.lit(x) for x in N.TEMPLATES])
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("seed"), (F.col("id") % 18 + 1).cast("int").alias("op"), F.element_at(names, (F.col("id") % 3 + 1).cast("int")).alias("template"))


def lines_of(problem):
    return problem.rstrip(".").split(". ")


def value_of(problem, name, known=None, seen=()):
    """A number by the statements: `the number of ..` by its own, a total from all things told of at its place (or in known)."""
    told = dict(x.split(" equals ", 1) for x in lines_of(problem))
    known = known or {}

    def worth(what):
        if what in known:
            return known[what]
        if what.isdigit():
            return int(what)
        if what.startswith("the total"):
            place = what.split(" in ", 1)[1]
            of = {"the number of " + k[len("The number of "):] for k in told if k.startswith("The number") and k.endswith(" in " + place)} | {k for k in known if k.startswith("the number") and k.endswith(" in " + place)}
            return sum(worth(x) for x in sorted(of))
        right = told["T" + what[1:]]
        m = re.fullmatch(r"(\d+) (plus|times) (.*)", right)
        c, how, rest = (int(m[1]), m[2], m[3]) if m else (0, "plus", right)
        m = re.fullmatch(r"the (sum of|difference between|product of) (.*)", rest)
        if not m:
            v = worth(rest)
        else:
            parts = re.split(r", and |, | and ", m[2])
            vs = [worth(x) for x in parts]
            v = sum(vs) if m[1] == "sum of" else vs[0] - vs[1] if m[1] == "difference between" else vs[0] * vs[1]
        return c * v if how == "times" else c + v

    return worth(name)


def asked(question):
    m = re.fullmatch(r"How many (.*) does (.*) have\?", question)
    return f"the number of {m[1]} in {m[2]}" if m else f"the {question[len('What is the '):-1]}"


def test_forward_problems_are_solved_from_their_texts(spark):
    rows = N.forward(seeds(spark, 400, 1)).collect()
    assert len(rows) == 400 and rows == sorted(N.forward(seeds(spark, 400, 8)).collect(), key=lambda r: r.seed)
    for r in rows:
        assert value_of(r.problem, asked(r.question)) == r.answer, r
        need = [x for x in r.graph if x.needed]
        assert sum(len(x.deps) for x in need) == r.op and all(1 <= x.v <= N.LARGEST for x in r.graph) and len({x.name for x in r.graph}) == len(r.graph)
        used = {i for x in need for i in x.deps}
        assert used == set(range(len(need) - 1))  # all but the last are needed
        assert all(i < j for j, x in enumerate(r.graph) for i in x.deps)
        for total in (x for x in r.graph if x.total):  # no thing of its place is left out
            assert {r.graph[i].name for i in total.deps} == {x.name for x in r.graph if not x.total and x.name.endswith(total.name[total.name.index(" in "):])}
    assert any(x.total for r in rows for x in r.graph) and any(not x.needed for r in rows for x in r.graph) and {x.how for r in rows for x in r.graph} == {"", "+", "-"}


def test_reverse_problems_have_one_answer(spark):
    rows = N.reverse(seeds(spark, 400, 8).where("op >= 2")).collect()
    assert len(rows) > 370 and {r.degree for r in rows} == {1, 2}
    for r in rows:
        name, given = asked(r.question), [x for x in lines_of(r.problem) if x.startswith(("The total", "The number"))]
        told = [x.split(" equals ")[0] for x in given]
        last = [x for x in r.graph if x.needed][-1]
        target = last.called if hasattr(last, "called") else ("the " if last.total else "the number of ") + last.name
        assert f"{target[0].upper()}{target[1:]} equals {last.v}" in given and name[0].upper() + name[1:] not in told
        without = ". ".join(x for x in given if x != f"{target[0].upper()}{target[1:]} equals {last.v}") + "."
        good = [v for v in range(1, 61) if value_of(without, target, {name: v}) == last.v]
        assert r.answer in good and (good == [r.answer] or r.degree == 0), (r, good)


def test_rows_that_give_none(spark):
    x = spark.createDataFrame([(None, 3, "zoo"), (1, None, "zoo"), (2, 0, "zoo"), (3, 4, "other"), (4, 4, None), (5, 3, "zoo"), (5, 3, "zoo")], "seed long, op int, template string")
    got = N.forward(x).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].op == 3
    assert N.forward(x.limit(0)).count() == 0 and N.reverse(x.limit(0)).count() == 0 and N.reverse(x.where("op = 3")).count() == 2


def test_context_is_filled(spark):
    tokens = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("long")
    p = N.forward(seeds(spark, 40, 4))
    before = {r.seed: r for r in p.collect()}
    for target in (10, 600):
        rows = N.in_context(p, target, tokens).collect()
        assert len(rows) == 40
        for r in rows:
            old, new = lines_of(before[r.seed].problem), lines_of(r.problem)
            assert [x for x in new if x in old] == old and r.n_tokens == len(r.problem.split()) + len(r.question.split())
            assert new == old if target == 10 else 600 - 26 < r.n_tokens <= 600 and len(set(new)) == len(new)
            assert value_of(r.problem, asked(r.question)) == r.answer
    again = N.in_context(N.forward(seeds(spark, 40, 1)), 600, tokens).collect()
    assert {r.seed: r.problem for r in again} == {r.seed: r.problem for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_equations_by_trying(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a, b, c, r = (rng.randint(-6, 6) for _ in range(4))
        text = rng.choice(["{a}*x + {b} = {c}", "{a}*x**2 + {b}*x = {c}", "(x - {r}) * ({a}*x + {b}) = 0", "{a}*(x + {b}) - {c} = x / 2", "-(x^2) + {b} = {c}*x"]).format(a=a, b=b, c=c, r=r)
        left, right = text.split("=")
        f = lambda x: eval(left.replace("^", "**"), {"x": x}) - eval(right.replace("^", "**"), {"x": x})  # noqa: E731, B023, S307
        got = Q.solve(Q.polynomial(left), Q.polynomial(right))
        if got["order"]:
            assert got["solutions"] == [x for x in range(1, 200) if f(Fraction(x)) == 0], text
            assert all(abs(f(x)) < 1e-6 * (1 + x * x) for x in got["roots"]) and len(got["roots"]) <= got["order"]
        else:
            assert f(1) == f(2) == f(3)


def test_equations_that_cannot_be_solved(spark):
    x = spark.createDataFrame([("2*x + 3 = 7",), ("x**2 - 5*x + 6 = 0",), ("x**3 = 8",), ("2*x + 3",), ("y = 2",), ("x + = 3",), ("1/x = 2",), ("(x = 2",), ("",), (None,), ("0.5*x = 2",)], "text string")
    got = [r.s for r in x.select(Q.solved(F.col("text")).alias("s")).collect()]
    assert [s and s.solutions for s in got] == [[2], [2, 3], None, None, None, None, None, None, None, None, [4]] and got[9] is None
    assert all(s.error for s in got[2:9]) and got[1].order == 2 and "two real roots" in " ".join(got[1].steps)


def test_symbolic_tasks_line_by_line(spark):
    x = spark.createDataFrame([(i, i % 9 + 1, i % 9 + 1 + i % 4 * 5) for i in range(200)] + [(None, 1, 1), (7, 0, 3), (8, 4, 3), (9, None, 3)], "seed long, op int, n int")
    rows = Y.tasks(x).collect()
    assert len(rows) == 200 and Y.tasks(x.limit(0)).count() == 0
    for r in rows:
        left = dict(re.fullmatch(r"assign (V\d{6}) = (.*)", s).groups() for s in r.lines)
        assert len(left) == len(r.lines) == r.n - (r.n > r.op) and r.context == " ".join(s + "." for s in r.lines)
        known, grown = {}, True
        while grown:
            grown = False
            for name, right in left.items():
                parts = right.split()
                if name not in known and (parts[0].isdigit() or parts[0] in known):
                    known[name] = (int(parts[0]) if parts[0].isdigit() else known[parts[0]]) + (int(parts[1] + parts[2]) if len(parts) == 3 else 0)
                    grown = True
        assert len(known) == r.op and sorted(r.answer) == sorted(k for k, v in known.items() if v == r.wanted) and r.answer
        assert r.solution.endswith("ANSWER:\n" + ", ".join(r.answer)) and r.solution.count(";") == r.op
