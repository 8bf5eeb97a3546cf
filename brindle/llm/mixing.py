"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks; a source's target is an exact quota of blocks
of each pass, the last one trimmed to the word. The vector of quotas is split recursively between the
halves of the output shards by multivariate-hypergeometric draws; each shard then takes disjoint runs
of every source's permuted blocks and shuffles what it got locally."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Scratch

#: Blocks of all sources together: the one bound on what the driver holds, beside a row a source.
BLOCKS = 1 << 15
#: Parts by hash of a block in which a source's quota ends.
FINE = 1 << 12
#: Words of an output shard, about, and the least and largest number of shards: an eighth of the blocks, so that a shard draws several.
SHARD_WORDS, SHARDS = 1 << 24, (64, BLOCKS >> 3)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words of each source: share * sum(sizes) by weight; a target stops at most * size and the excess
    is shared anew by weight among the others, until none is above."""
    out, left, todo = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while todo and left > 0:
        weight = sum(weights[i] for i in todo)
        above = [i for i in sorted(todo) if left * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in todo:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in above)
        todo -= set(above)
    return out


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quota blocks of each source dealt to shards (rows: shards): every node splits what it has between
    its halves, each half's total in proportion to its shards, by one multivariate-hypergeometric draw."""
    out = np.zeros((shards, len(quota)), np.int64)

    def node(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1 or not have.sum():
            out[first] = have
            return
        mid, total = (first + last) // 2, int(have.sum())
        part = total * (mid - first) // (last - first)
        left = rng.multivariate_hypergeometric(have, part, method="marginals")
        node(first, mid, left)
        node(mid, last, have - left)

    if len(quota):
        node(0, shards, quota.astype(np.int64))
    return out


def plan(rows: list[tuple], weights, seed: int, shards: int) -> list[tuple]:
    """rows: (source, block, words). For each block: (source, block, full, trim, shard of each pass,
    source_size, target): `full` passes take all of it, and `trim` more words go to the boundary block.

    A source's quota is the number of its permuted blocks that reach its target, in each pass over them. The tree
    splits the quotas of all sources among the shards; then each shard draws its run of every source's permuted blocks, and
    the last block that is drawn of a source is trimmed to the target."""
    by_source: dict = {}
    for source, block, words in rows:
        by_source.setdefault(source, []).append((block, words))
    # code-point order, null last
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    sizes = [sum(w for _, w in by_source[s]) for s in order]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(order))])
    rng, taken = np.random.default_rng(seed), {}
    left = [int(round(g)) for g in goal]
    for _ in range(2):
        permuted, quota = [], np.zeros(len(order), np.int64)
        for i, source in enumerate(order):
            blocks = sorted(by_source[source])
            permuted.append([blocks[j] for j in rng.permutation(len(blocks))])
            reach = np.cumsum([w for _, w in permuted[i]])
            quota[i] = min(len(blocks), int(np.searchsorted(reach, left[i])) + 1) if left[i] > 0 else 0
        dealt, at = split_tree(quota, shards, rng), np.zeros(len(order), np.int64)
        for shard, run in enumerate(dealt):
            for i in np.flatnonzero(run):
                for block, words in permuted[i][at[i] : at[i] + run[i]]:
                    taken.setdefault((i, block), []).append((min(words, left[i]), shard))
                    left[i] -= min(words, left[i])
                at[i] += run[i]
    done = []
    for i, source in enumerate(order):
        for block, words in by_source[source]:
            turns = sorted(taken.get((i, block), []), key=lambda x: -x[0])
            to = [s for _, s in turns] + [None] * (2 - len(turns))
            done.append((source, block, sum(w == words for w, _ in turns), sum(w for w, _ in turns if w < words), to[0], to[1], sizes[i], goal[i]))
    return done


def mix(docs: DataFrame, weights=(5, 2, 1), seed: int = 17, shards: int | None = None, exact: bool = True) -> DataFrame:
    """Rows of docs with size, source_size, target, copies, part_words and shards.

    size: the text's words (null: 0). copies: whole copies that the mix takes, 0 to 2. part_words: the
    first words of one more copy, of the one document of a source where its quota ends (exact=False: that
    document is taken whole or not, whichever comes nearer). shards: of each copy the output shard, of as
    many as there are SHARD_WORDS in the mix, within SHARDS, if their number is not given.
    No copies * size + part_words is above 2 * size. Sources of no words have target 0; documents of
    no words have size 0 and no copies unless their block is taken whole. Rows that repeat a doc_id and
    text are dealt alike but trimmed one by one. Null sources are one source, last in order. The same
    rows give the same mix, however they are partitioned. Sources are few enough for a row each, and FINE more,
    on the driver. An empty table gives no rows. Columns of docs of the six names are replaced; others may have any names."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    made = ["size", "source_size", "target", "copies", "part_words", "shards"]
    docs = docs.drop(*made)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = scratch.table(docs.select("source", key.alias("key"), words.alias("size")), "sizes")
    total = {r.source: r.size for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    whole = max(1, sum(total.values()))
    counts = spark.createDataFrame([(s, max(1, round(BLOCKS * n / whole))) for s, n in total.items()], "s string, blocks long")
    same = F.col("source").eqNullSafe(F.col("s"))
    block = F.pmod(F.shiftrightunsigned("key", 17), F.col("blocks"))
    placed = sized.join(F.broadcast(counts), same).select("source", block.alias("b"), F.pmod("key", F.lit(FINE)).alias("fine"), "size")
    found = placed.groupBy("source", "b").agg(F.sum("size").alias("words")).collect()  # at most BLOCKS rows and a source's
    if shards is None:
        shards = min(max(SHARDS[0], math.ceil(1.5 * whole / SHARD_WORDS)), SHARDS[1])
    planned = plan([tuple(r) for r in found], weights, seed, shards)
    # where a source's quota ends within a block: of its FINE parts by hash the first are taken, one is cut
    ends = {(r[0], r[1]): r[3] for r in planned if r[3] > 0}
    edges = spark.createDataFrame([(s, b) for s, b in ends], "s string, e long")  # a row a source
    inside = placed.join(F.broadcast(edges), same & (F.col("b") == F.col("e"))).groupBy("source", "b", "fine").agg(F.sum("size").alias("words")).collect()
    cut: dict = {}
    for r in sorted(inside, key=lambda r: r.fine):
        room = ends[r.source, r.b] - cut.get((r.source, r.b), (0, 0, 0))[2]
        if room > 0:
            cut[r.source, r.b] = (r.fine, room, ends[r.source, r.b] - room + r.words)
    rows = [(*r, *cut.get((r[0], r[1]), (None, None))[:2]) for r in planned]
    schema = T._parse_datatype_string("s string, b long, full int, trim long, one int, two int, source_size long, target double, cut long, left long")
    table = spark.createDataFrame(rows, schema)
    scratch.drop(sized)
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "doc_id", "text", "source", key.alias("key"), words.alias("size"))
    dealt = row.join(F.broadcast(counts), same).withColumn("block", block).drop("s")
    # one row a block, at most BLOCKS and a source's: 3 MB
    dealt = dealt.join(F.broadcast(table), same & (F.col("block") == F.col("b")), "left").withColumn("fine", F.pmod("key", F.lit(FINE)))
    here = F.coalesce(F.col("fine") == F.col("cut"), F.lit(False))
    whole_too = F.coalesce(F.col("fine") < F.col("cut"), F.lit(False)).cast("int")
    inner = dealt.where(~here).withColumn("part_words", F.lit(0).cast("long")).withColumn("copies", F.coalesce("full", F.lit(0)) + whole_too)
    # the parts that are cut, one a source: documents by hash until the words that are left
    order = Window.partitionBy("source", "b").orderBy("key", "doc_id", "text")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    edge = dealt.where(here).withColumn("room", F.greatest(F.col("left") - F.coalesce(before, F.lit(0)), F.lit(0)))
    in_full = F.col("size") <= F.col("room") if exact else 2 * F.col("room") > F.col("size")
    edge = edge.withColumn("copies", F.col("full") + (in_full & (F.col("room") > 0)).cast("int"))
    edge = edge.withColumn("part_words", F.when(~in_full, F.col("room")).otherwise(0) if exact else F.lit(0).cast("long")).drop("room")
    out = inner.unionByName(edge)
    to = F.slice(F.array("one", "two"), 1, F.col("copies") + (F.col("part_words") > 0).cast("int"))
    return out.withColumn("shards", to).select("row.*", *made)


def shuffled(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The mix's rows, one a copy, with shard: each shard's rows together, shuffled by a hash within it.
    The last copy of a trimmed document holds its first part_words words only. A column named shard is replaced."""
    row = mixed.drop("shard").select(F.struct("*").alias("row"), F.posexplode("shards").alias("copy", "shard"))
    text = F.when(F.col("copy") < F.col("row.copies"), F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(F.col("row.part_words"), F.lit(1)).cast("int")), " "))
    row = row.withColumn("at", F.xxhash64(F.lit(seed + 1), "row.doc_id", "copy")).withColumn("row", F.col("row").withField("text", text))
    row = row.repartition("shard").sortWithinPartitions("shard", "at", "row.doc_id")
    return row.select("row.*", "shard")


def op2(docs: DataFrame) -> DataFrame:
    """Every document, the words of it that the mix takes, and the output shard of each copy."""
    mixed = mix(docs.select("doc_id", "text", "source"))
    taken = F.col("copies") * F.col("size") + F.col("part_words")
    return mixed.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "shards")
