"""Symbolic tasks: a random tree of variables with values, lines that assign them among lines that lead nowhere, and the variables of a wanted value.

Draws are digits of sha256(seed:what:i), so any engine can repeat them; all is one projection a seed, with arrays over the variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names are V and six digits.
NAMES = 1_000_000
DELTAS = [("", 0), (" + 1", 1), (" - 1", -1)]


def draw(what: str, i: Column | int = 0) -> Column:
    """A number below 2^32 for the row's seed, a purpose and a place."""
    key = F.concat_ws(":", F.col("seed").cast("string"), F.lit(what), (F.lit(i) if isinstance(i, int) else i).cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i.cast("int"))


def tasks(seeds: DataFrame) -> DataFrame:
    """(seed, op, n, lines, context, wanted, answer, question, solution) of seeds (seed, op, n): op variables hang together in a tree whose root has a value of 0 to 10,
    each other one its parent's, that plus 1 or that less 1. n - op more form a tree whose root has no value, so none of theirs can be
    derived. wanted is a value some of the op have; answer names all that have it, in the order of their derivation.

    Names of a seed differ. Rows of a null, of op below 1, of n below op or above NAMES give none; equal rows come out alike; an empty table gives no rows."""
    x = seeds.select("seed", F.col("op").cast("int").alias("op"), F.col("n").cast("int").alias("n")).where(f"seed is not null and op >= 1 and n >= op and n <= {NAMES}")
    x = x.withColumn("all", F.sequence(F.lit(0), F.col("n") - 1)).withColumn("first", draw("name") % NAMES).withColumn("step", draw("step") % (NAMES // 10) * 10 + 7)
    # a step without a factor in common with the number of names meets none twice
    x = x.withColumn("name", F.transform("all", lambda i: F.concat(F.lit("V"), F.lpad(((F.col("first") + F.col("step") * i) % NAMES).cast("string"), 6, "0"))))
    tree = lambda i: F.when(i < F.col("op"), draw("parent", i) % F.greatest(i, F.lit(1))).otherwise(F.col("op") + draw("parent", i) % F.greatest(i - F.col("op"), F.lit(1)))
    x = x.withColumn("parent", F.transform("all", lambda i: F.when((i == 0) | (i == F.col("op")), -1).otherwise(tree(i)).cast("int")))
    x = x.withColumn("kind", F.transform("all", lambda i: (draw("delta", i) % 3).cast("int")))
    text, number = F.array(*[F.lit(s) for s, _ in DELTAS]), F.array(*[F.lit(d) for _, d in DELTAS])
    grown = lambda done, i: F.concat(done, F.array(F.get(done, at("parent", i)) + F.get(number, at("kind", i))))
    root = F.array((draw("root") % 11).cast("int"))
    x = x.withColumn("value", F.aggregate(F.slice("all", F.lit(2), F.greatest(F.col("op") - 1, F.lit(0))), root, grown))
    right = lambda i: F.concat(at("name", at("parent", i)), F.get(text, at("kind", i)))
    line = lambda i: F.concat(F.lit("assign "), at("name", i), F.lit(" = "), F.when(i == 0, at("value", i).cast("string")).otherwise(right(i)))
    keyed = F.transform(F.filter("all", lambda i: (i == 0) | (at("parent", i) >= 0)), lambda i: F.struct(draw("order", i).alias("h"), i.alias("i"), line(i).alias("line")))
    x = x.withColumn("lines", F.transform(F.array_sort(keyed), lambda k: k["line"]))
    x = x.withColumn("wanted", at("value", draw("wanted") % F.col("op")))
    inside = F.slice("all", F.lit(1), F.col("op"))
    x = x.withColumn("answer", F.transform(F.filter(inside, lambda i: at("value", i) == F.col("wanted")), lambda i: at("name", i)))
    derived = lambda i: F.concat(at("name", i), F.lit(" = "), F.when(i == 0, at("value", i).cast("string")).otherwise(F.concat(right(i), F.lit(" = "), F.when(at("kind", i) == 0, at("value", i).cast("string")).otherwise(F.concat(at("value", at("parent", i)).cast("string"), F.get(text, at("kind", i)), F.lit(" = "), at("value", i).cast("string"))))), F.lit(";"))
    context = F.array_join(F.transform("lines", lambda s: F.concat(s, F.lit("."))), " ")
    question = F.concat(F.lit("All these relations hold at once. Which variables whose values can be derived from them equal "), F.col("wanted").cast("string"), F.lit("? Show each step, then name them in one sentence."))
    solution = F.concat(F.lit("Derived one by one:\n"), F.array_join(F.transform(inside, derived), "\n"), F.lit("\nANSWER:\n"), F.array_join("answer", ", "))
    return x.select("seed", "op", "n", "lines", context.alias("context"), "wanted", "answer", question.alias("question"), solution.alias("solution"))
