"""Connected components and bucket resolution with DataFrame operations only."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, release

#: Of each id's buckets, so many say from which one of them a pair comes.
FEW = 16


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is the smallest id reachable.

    Alternating large-star and small-star rounds: each links neighbours to the smallest neighbour,
    by a minimum with map-side combine and an equi-join (whose hot vertices AQE splits). Edges are
    never collected; each round is a table in the shared folder. An empty input gives no rows."""
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        # a forest of stars: every vertex points once, and to one that points nowhere
        n, one = e.agg(F.count("a"), F.count_distinct("a")).first()
        if n == one and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = scratch.table(small.select("x.a", "x.b").where("a <> b").distinct(), "small")
        scratch.drop(large, e)
        e = new
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def differing(x: Column, y: Column) -> Column:
    """In how many bits two sketches (arrays of longs of one size) differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def dealt(rows: DataFrame, key: str, n: int) -> Iterator[DataFrame]:
    """rows in n parts by a hash of key, for rounds one after another; rows of one key stay together."""
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64(F.lit("round"), key), F.lit(n)) == k) if n > 1 else rows


def resolve(postings: DataFrame, marks: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column, Column, Column], Column], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, ratio: float, wide: int = 256, passes: int = 1) -> DataFrame:
    """(id, component) of all ids that link, where ids link only if they share a bucket and verify() keeps them.

    postings: (bucket, id, size), each once; one shuffle finds the buckets of several ids, and only ids with another of like size beside
    them there are written; a table of the shared folder goes then. Ids link only if the larger is `ratio` times the smaller at most. marks: DataFrame (id) -> (id, size, sketch) of these. may(size, size, sketch, sketch): False only
    for ids that can't link. verify: DataFrame (a, b) with a < b -> a table of those pairs that link.

    Each shared bucket first gives, for members of like size (a step of `ratio` or half a step further), the pairs of one of
    them, that which meets the most others for its size over all its buckets, with the rest: at most twice as many as it has
    members. In a group of near copies that member is a text in the middle of them. Where that leaves it in more than one component, all pairs of different components that
    may() lets pass follow. So every link between components is found, a group of copies costs a pair a member,
    and pairs of one component are not compared again, nor are buckets of two whose pair the first step had. A pair comes from the least of the
    buckets that the first FEW of both share, if any, not from each. A bucket of more than `wide` such members is dealt by
    a salt to as many tasks as it has times `wide`. Buckets are dealt by a hash to `passes` rounds, one after another, and
    whole each, and ids likewise, so that a round's shuffles hold that share of the rows; what is found does not hang on their number."""
    one = Window.partitionBy("bucket")
    by_size, most = one.orderBy("size"), ratio * (1 + 1e-9)

    def neighbours(part: DataFrame) -> DataFrame:
        part = part.withColumn("n", F.count("id").over(one).cast("int")).where("n > 1")
        part = part.withColumns({"below": F.lag("size").over(by_size), "above": F.lead("size").over(by_size)})
        return part.where((F.col("size") <= F.col("below") * most) | (F.col("above") <= F.col("size") * most)).select("bucket", "id", "size", "n")

    several = scratch.parts((neighbours(x) for x in dealt(postings, "bucket", passes)), "several")
    scratch.drop(postings)
    meets = several.groupBy("id").agg(F.sum("n").alias("meets"))
    marked = scratch.parts(dealt(marks(meets.select("id")), "id", passes), "marks")
    weights = meets.withColumnRenamed("meets", "weight")
    step = F.log("size") / math.log(ratio)
    classes = [Window.partitionBy("bucket", F.floor(step + shift)) for shift in (0.0, 0.5)]
    leads = [F.max(F.struct(F.col("weight") / F.col("size"), "id")).over(w)["id"] for w in classes]
    shared = scratch.parts((x.join(weights, "id").select("bucket", "id", *[x.alias(f"lead{i}") for i, x in enumerate(leads)]) for x in dealt(several, "bucket", passes)), "shared")
    scratch.drop(several)
    side = lambda c: marked.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    near_enough = may(F.col("size_a"), F.col("size_b"), F.col("sketch_a"), F.col("sketch_b"))
    star = shared.select("id", F.explode(F.array("lead0", "lead1")).alias("lead")).where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    pairs = scratch.table(star.join(side("a"), "a").join(side("b"), "b").where(near_enough).select("a", "b"), "pairs")
    release(scratch.spark)
    links = verify(pairs)
    found = scratch.table(components(links, scratch), "found")

    def crossing(part: DataFrame) -> DataFrame:
        named = part.join(found.withColumnRenamed("component", "c"), "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c"), "lead0", "lead1")
        paired = (F.count("c") == 2) & ((F.min("lead0") == F.max("lead0")) | (F.min("lead1") == F.max("lead1")))
        split = named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("c") / wide).cast("int").alias("salts"), paired.alias("paired")).where("lo < hi and not paired")
        named = named.join(split.select("bucket", "salts"), "bucket").select("bucket", "id", "c", "salts")
        few = named.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("bucket")), 1, FEW).alias("few"))
        named = named.join(few, "id").join(marked, "id")
        named = scratch.table(named, "named")
        release(scratch.spark)
        x = named.select("bucket", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.col("id").alias("a"), F.col("c").alias("c_a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"), F.col("few").alias("few_a"))
        y = named.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("c").alias("c_b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"), F.col("few").alias("few_b"))
        here = F.coalesce(F.array_min(F.array_intersect("few_a", "few_b")), x.bucket) == x.bucket
        cross = x.join(y, (x.bucket == y.bucket) & (x.salt == y.salt) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & near_enough & here).select("a", "b")
        out = scratch.table(cross.distinct(), "crossing")
        scratch.drop(named)
        release(scratch.spark)
        return out

    met = [crossing(x) for x in dealt(shared, "bucket", passes)]
    scratch.drop(shared)
    cross = scratch.table(functools.reduce(DataFrame.unionByName, met).distinct().join(pairs, ["a", "b"], "left_anti"), "cross")
    scratch.drop(*met, marked, pairs)
    release(scratch.spark)
    if not cross.isEmpty():
        more = verify(cross)
        if not more.isEmpty():
            found = scratch.table(components(links.unionByName(more), scratch), "found")
        scratch.drop(more)
    scratch.drop(cross, links)
    release(scratch.spark)
    return found
