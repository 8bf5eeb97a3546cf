"""Generated problems: layered random graphs with an exact number of operations, told as statements, a question and a worked solution,
forward (find the last value) or in reverse (find a number that was left out).

A table of seeds is dealt out by Spark; each row draws its graph from (seed, attempt) alone, so rows come out alike on any partitioning
and a lost task draws the same again. Nodes come in layers: the things counted in one place, then (where drawn) their total,
which no statement defines, then the next place. Each node but the last is used by a later one, so all are needed; the operations are
the edges: nodes less one, and as many more as the op count asks for."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.equations import Poly, solve
from brindle.operators.relational import spread

#: Words of each template: kinds, things (a counted thing is a kind and a thing), places, and what a total counts.
TEMPLATES = {
    "zoo": ("adult young grey red".split(), "wolf bear eagle fox otter crow lynx hare".split(), "Oak Hill,Mirror Lake,Pine Ridge,South Meadow,Cedar Valley,Long Beach,High Moor,Reed Island,Stone Gorge".split(","), "animals"),
    "school": ("new senior visiting retired".split(), "painter chemist pianist coach linguist historian potter botanist".split(), "Riverton,Northgate,Lakeside,Fairview,Brookdale,Elmwood,Westport,Ashford,Kingsley".split(","), "teachers"),
    "film": ("silent short animated restored".split(), "drama comedy western thriller musical romance satire mystery".split(), "Arden,Bellmont,Corvale,Dunmere,Estoril,Farrow,Glenhaven,Harmony,Ironbridge".split(","), "films"),
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Values of nodes lie in 1 .. LARGEST.
LARGEST = 1000


class Rejected(Exception):
    """An attempt that can't be told or leaves the values' range."""


class Node:
    """A thing counted or a place's total: its operands in the order in which they are named, how they combine, and a constant added or multiplied."""

    __slots__ = ("name", "total", "deps", "how", "mode", "c", "base", "v")

    def __init__(self, name: str, total: bool):
        self.name, self.total, self.deps, self.how, self.mode, self.c, self.base, self.v = name, total, [], "", "", 0, 0, 0

    def called(self) -> str:
        return f"the {self.name}" if self.total else f"the number of {self.name}"

    def statement(self, nodes: list[Node]) -> str:
        names = [nodes[i].called() for i in self.deps]
        if not names:
            rest = str(self.v)
        elif len(names) == 1:
            rest = names[0]
        elif len(names) == 2:
            rest = {"+": "the sum of", "-": "the difference between", "*": "the product of"}[self.how] + f" {names[0]} and {names[1]}"
        else:
            rest = f"the sum of {', '.join(names[:-1])}, and {names[-1]}"
        constant = {"": "", "+": f"{self.c} plus ", "*": f"{self.c} times "}[self.mode]
        return f"The number of {self.name} equals {constant}{rest}"

    def folded(self, start: Callable[[int], object]):
        """Its value from its operands' (numbers or polynomials)."""
        if not self.deps:
            return self.v
        parts = [start(i) for i in self.deps]
        out = parts[0]
        for p in parts[1:]:
            out = out - p if self.how == "-" else out * p if self.how == "*" else out + p
        return out + self.c if self.mode == "+" else out * self.c if self.mode == "*" else out


def drawn(rng: random.Random, op: int, template: str, most: int, product: bool) -> tuple[list[Node], int]:
    """Nodes in an order of evaluation and how many of them the last of these needs; up to three more may follow."""
    n = op + 1 - rng.randrange(op // 3 + 1)
    kinds, things, places, counted = TEMPLATES[template]
    nodes, members, here, thing = [], [], 0, rng.randrange(32)
    place0 = rng.randrange(len(places))
    users = [-1] * n
    for i in range(n + rng.randrange(4)):
        if here >= len(places) or len(members) > 31:
            raise Rejected
        place = places[(place0 + here) % len(places)]
        if 1 < len(members) and i < n and not rng.randrange(4):
            nodes.append(Node(f"total number of {counted} in {place}", True))
            for j in members:
                users[j] = i
            members, here = [], here + 1
        else:
            k = (thing + len(members)) % 32
            nodes.append(Node(f"{kinds[k // 8]} {things[k % 8]} in {place}", False))
            members.append(i)
    edges = set()
    for i in range(n - 1):
        later = [j for j in range(i + 1, n) if not nodes[j].total]
        j = users[i] if users[i] >= 0 else rng.choice(later)
        edges.add((i, j))
    free = [(i, j) for j in range(n) if not nodes[j].total for i in range(j) if (i, j) not in edges]
    if len(free) < op - len(edges):
        raise Rejected
    edges.update(rng.sample(free, op - len(edges)))
    for i, j in sorted(edges):
        nodes[j].deps.append(i)
    for j in range(n, len(nodes)):
        nodes[j].deps = sorted({rng.randrange(j), rng.randrange(j)})
    for x in nodes:
        settle(rng, x, nodes, most, product)
    return nodes, n


def settle(rng: random.Random, x: Node, nodes: list[Node], most: int, product: bool) -> None:
    """Draws how a node's operands combine, its constant, and so its value."""
    v = [nodes[i].v for i in x.deps]
    if not v:
        x.v = x.base = rng.randint(1, most)
        return
    if len(v) > 1:
        x.how = "+"
    if len(v) == 2 and not x.total:
        if product and not rng.randrange(3) and v[0] * v[1] <= LARGEST:
            x.how = "*"
        elif v[0] != v[1] and rng.randrange(2):
            x.how, x.deps = "-", sorted(x.deps, key=lambda i: -nodes[i].v)
    x.base = x.folded(lambda i: nodes[i].v)
    if not x.total and rng.randrange(2):
        times = rng.randint(2, 5)
        x.mode, x.c = ("*", times) if not rng.randrange(3) and x.base * times <= LARGEST else ("+", rng.randint(1, most))
    x.v = x.folded(lambda i: nodes[i].v)
    if not 1 <= x.v <= LARGEST:
        raise Rejected


def told(rng: random.Random, lines: list[str]) -> str:
    rng.shuffle(lines)
    return ". ".join(lines) + "."


def question(x: Node) -> str:
    thing, _, place = x.name.partition(" in ")
    return f"What is the {x.name}?" if x.total else f"How many {thing} does {place} have?"


def worked(rng: random.Random, nodes: list[Node], n: int) -> str:
    """The needed nodes one by one: operands combined in turn, then the constant, each step a letter of its own."""
    free, own, out = rng.sample(LETTERS, len(LETTERS)), {}, []
    for i in range(n):
        x, steps = nodes[i], []

        def step(text: str, value: int) -> str:
            if not free:
                raise Rejected
            steps.append(f"{free[-1]} = {text} = {value}" if text else f"{free[-1]} = {value}")
            return free.pop()

        if len(x.deps) < 2:
            at, sofar = step(own[x.deps[0]] if x.deps else "", x.base), x.base
        else:
            at, sofar = own[x.deps[0]], nodes[x.deps[0]].v
            for j in x.deps[1:]:
                v = nodes[j].v
                value = sofar - v if x.how == "-" else sofar * v if x.how == "*" else sofar + v
                at, sofar = step(f"{at} {x.how} {own[j]} = {sofar} {x.how} {v}", value), value
        if x.mode:
            at = step(f"{x.c} {x.mode} {at} = {x.c} {x.mode} {sofar}", x.v)
        own[i] = at
        out.append(f"Define {x.name} as {at}; {'; '.join([*steps[:-1], 'so ' + steps[-1]])}.")
    return f"{' '.join(out)} Answer: {nodes[n - 1].v}."


def forward_problem(rng: random.Random, op: int, template: str, most: int) -> dict:
    nodes, n = drawn(rng, op, template, most, False)
    solution = worked(rng, nodes, n)
    return {"problem": told(rng, [x.statement(nodes) for x in nodes if not x.total]), "question": question(nodes[n - 1]), "solution": solution, "answer": nodes[n - 1].v, "graph": graph(nodes, n)}


def reverse_problem(rng: random.Random, op: int, template: str, most: int) -> dict:
    """The number of a node without operands is left out, and the last node's value given instead. Every node is a polynomial of the unknown; the
    last one's equation, linear or quadratic, has the number as its one positive whole solution."""
    nodes, n = drawn(rng, op, template, most, True)
    asked = max(i for i in range(n) if not nodes[i].deps)
    polys: list[Poly] = []
    for i in range(n):
        polys.append(Poly.x() if i == asked else Poly.of(nodes[i].folded(lambda j: polys[j])))
        if polys[-1].degree > 2:
            raise Rejected
    last = polys[-1]
    found = solve(last, nodes[n - 1].v)
    if asked == n - 1 or found["solutions"] != [nodes[asked].v]:
        raise Rejected
    lines = [x.statement(nodes) for i, x in enumerate(nodes) if not x.total and i != asked]
    given = f"{nodes[n - 1].called()} equals {nodes[n - 1].v}"
    steps = [f"Let x be {nodes[asked].called()}."] + [f"Then {nodes[i].called()} is {polys[i]}." for i in range(n) if nodes[i].deps]
    solution = " ".join([*steps, f"So {last} = {nodes[n - 1].v}.", *found["steps"], f"Answer: {nodes[asked].v}."])
    return {"problem": told(rng, [*lines, given[0].upper() + given[1:]]), "question": question(nodes[asked]), "solution": solution, "answer": nodes[asked].v, "degree": last.degree, "asked": asked, "graph": graph(nodes, n)}


GRAPH = "array<struct<name:string,total:boolean,deps:array<int>,how:string,mode:string,c:bigint,v:bigint,needed:boolean>>"


def graph(nodes: list[Node], n: int) -> list[dict]:
    return [{"name": x.name, "total": x.total, "deps": x.deps, "how": x.how, "mode": x.mode, "c": x.c, "v": x.v, "needed": i < n} for i, x in enumerate(nodes)]


def _generated(seeds: DataFrame, make: Callable[[random.Random, int, str, int], dict], schema: str, attempts: int, most: int) -> DataFrame:
    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seed, op, template in zip(frame["seed"], frame["op"], frame["template"], strict=True):
                for attempt in range(attempts):
                    try:
                        out.append({"seed": seed, "op": op, "template": template, "attempt": attempt} | make(random.Random(f"{seed}:{op}:{template}:{attempt}"), op, template, most))
                        break
                    except Rejected:
                        continue
            yield pd.DataFrame(out, columns=names)

    full = f"seed long, op int, template string, attempt int, {schema}"
    names = [c.split()[0] for c in full.split(", ")]
    some = seeds.select(F.col("seed").cast("long").alias("seed"), F.col("op").cast("int").alias("op"), "template").where(F.col("seed").isNotNull() & (F.col("op") >= 1) & F.col("template").isin(*TEMPLATES))
    return spread(some, "seed").mapInPandas(rows, full)


def forward(seeds: DataFrame, attempts: int = 100, most: int = 22) -> DataFrame:
    """A problem for each row of seeds (seed, op, template): problem, question, solution, answer and graph (needed nodes first), of exactly `op` operations.

    An attempt is rejected if a value leaves 1 .. LARGEST, if places or letters run out, or if so few nodes can't hold so many edges; a row all of
    whose attempts are rejected gives none, as do rows of a null, of op below 1 or of an unknown template. Equal rows come out alike; an empty table gives
    no rows. Constants lie in 1 .. most."""
    return _generated(seeds, forward_problem, f"problem string, question string, solution string, answer long, graph {GRAPH}", attempts, most)


def reverse(seeds: DataFrame, attempts: int = 300, most: int = 22) -> DataFrame:
    """As forward(), but a number is asked for that was left out and the last value is given; with degree, of the equation to solve (1 or 2), and asked, the
    node's number. Two operands may be multiplied. An attempt whose equation does not have the number as its only positive whole solution is rejected."""
    return _generated(seeds, reverse_problem, f"problem string, question string, solution string, answer long, degree int, asked int, graph {GRAPH}", attempts, most)


def filler(i, template) -> Column:
    """The i-th statement that says nothing of the problem's own things: of annexes, which no problem has, each number a constant or one more than the one before."""
    out = F.lit(None).cast("string")
    for name, (kinds, things, places, _) in TEMPLATES.items():
        word = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
        called = lambda k, w=word, a=kinds, b=things, c=places: F.concat_ws(" ", w(a, F.floor(k / 8)), w(b, k), F.lit("in"), w(c, F.floor(k / 32)), F.lit("annex"), F.floor(k / (32 * len(c))).cast("string"))
        rest = F.when(i % 3 == 0, (i % 22 + 1).cast("string")).otherwise(F.concat((i % 5 + 1).cast("string"), F.lit(" plus the number of "), called(i - 1)))
        out = F.when(template == name, F.concat(F.lit("The number of "), called(i), F.lit(" equals "), rest)).otherwise(out)
    return out


def in_context(problems: DataFrame, target: int, tokens: Callable[[Column], Column], least: int = 6) -> DataFrame:
    """problems (seed, template, problem, question, ..; seeds differ) with problem filled up by statements of other things until problem and question have `target` tokens
    or less than one statement fewer, and n_tokens. The problem's own statements keep their order; where each stands among the others is drawn from the seed.

    tokens: a text column -> its number of tokens; statements are counted one by one. least: tokens of a statement at least, which bounds how many are tried, so a
    problem's statements are no more than target / least and their running sum is one small group. A problem that is long enough stays as it is; rows of a null problem,
    question, seed or template go; an empty table gives no rows."""
    x = problems.where("seed is not null and template is not null and problem is not null and question is not null")
    x = x.withColumn("__own", tokens(F.col("problem")) + tokens(F.col("question")))
    tried = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.lit(target) - F.col("__own")) / least)).cast("int"))
    shift = F.pmod(F.xxhash64(F.lit("filler"), "seed"), F.lit(10_000))
    rows = x.select("seed", "template", "__own", F.explode(tried).alias("__i"))
    rows = rows.withColumn("__said", F.concat(filler(F.col("__i") + shift, F.col("template")), F.lit(".")))
    rows = rows.withColumn("__size", tokens(F.col("__said")))
    sofar = F.sum("__size").over(Window.partitionBy("seed").orderBy("__i"))
    kept = rows.withColumn("__sum", F.col("__own") + sofar).where(F.col("__sum") <= target)
    lines = kept.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("__i", "__said"))).alias("__more"), F.max("__sum").alias("__total"))
    # texts are estimated at a few bytes each: Spark would send all of them to the driver and to each task
    x = x.hint("merge").join(lines.hint("merge"), "seed", "left")
    more = F.coalesce(F.transform("__more", lambda m: m["__said"]), F.array().cast("array<string>"))
    own = F.transform(F.split(F.rtrim("problem", F.lit(".")), r"\. "), lambda s: F.concat(s, F.lit(".")))
    # places in 0 .. 1, ascending within either kind: own statements by sorted draws, the others evenly
    draws = F.array_sort(F.transform(own, lambda _, i: F.pmod(F.xxhash64(F.lit("stand"), "seed", i), F.lit(1 << 30)) / (1 << 30)))
    placed = F.concat(F.transform(own, lambda s, i: F.struct(F.get(draws, i).alias("at"), F.lit(0).alias("kind"), i.alias("i"), s.alias("s"))), F.transform(more, lambda s, i: F.struct(((i + 0.5) / F.size(more)).alias("at"), F.lit(1).alias("kind"), i.alias("i"), s.alias("s"))))
    text = F.array_join(F.transform(F.array_sort(placed), lambda p: p["s"]), " ")
    return x.withColumn("problem", text).withColumn("n_tokens", F.coalesce("__total", "__own").cast("int")).drop("__own", "__more", "__total")
